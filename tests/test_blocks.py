"""Blocks of kinds hold every pair that shares a signal, with the pairs' own scores, and nothing is capped."""

import random

import pytest
from pyspark.sql import functions as F

from samewise.operators import blocks, disposition, kinds, matching, onboarding, orchestrator, scoring

from test_onboarding import scan


@pytest.fixture(scope="module")
def tables(spark):
    """Entities and more than 50 canonicals that share a signal with them; the best of them come late, and some are the entities' own."""
    names = ["atlas group", "boreal media", "cora", "atl", "boreal & sons", "zzz"]
    entities = [(f"E{i:03}", names[i % 6], "x", f"s{i}", "psa" if i % 2 else "accounting", "organization", None, None) for i in range(24)]
    others = ["atlas holdings", "boreal group", "coral", "groups at large", "b", "media boreal"]
    canon = [(f"C{i:03}", "t1", others[i % 6] + (" nova" if i % 5 == 0 else ""), "client", "organization") for i in range(140)]
    canon += [("C900", "t1", "atlas groupe", "client", "organization"), ("C901", "t1", "boreal medias", "client", "organization"), ("C902", "t1", "atlas groupe", "client", "organization")]
    aliases = [(f"C{i:03}", value, "x", "psa", None) for i in range(0, 140, 4) for value in ("cora", "boreal medial", "bm")] + [("C999", "atlas groups", "x", "psa", None)]
    refs = [("C900", "x", "psa", "s0", None), ("C001", "x", "psa", "s1", None), ("C007", "x", "psa", "s1", None)]
    return (
        spark.createDataFrame(entities, "entity_id string, normalized_name string, source string, source_id string, category string, entity_category string, email string, employee_id string"),
        spark.createDataFrame(canon, "canonical_id string, tenant_id string, canonical_name string, entity_type string, entity_category string"),
        spark.createDataFrame(aliases, "canonical_id string, value string, source string, category string, confidence double"),
        spark.createDataFrame(refs, "canonical_id string, source string, category string, external_id string, external_fields string"),
        spark.createDataFrame([("C900", "C902", "SAME_AS")], "source_node string, target_node string, relationship string"),
    )


@pytest.fixture(scope="module")
def every(tables):
    """All pairs that share a signal, but for own canonicals, scored one by one."""
    entities, canon, aliases, refs, edges = tables
    pairs = matching.signals(entities, canon, aliases).select("entity_id", "canonical_id").distinct()
    pairs = pairs.join(matching.own_canonicals(entities, refs), ["entity_id", "canonical_id"], "left_anti")
    return {(r.entity_id, r.canonical_id): r.score for r in scoring.score(pairs, entities, canon, aliases, edges).collect()}


@pytest.mark.parametrize("most_bytes", [kinds.BYTES, 0])
def test_blocks_hold_every_pair(monkeypatch, tables, every, most_bytes):
    entities, canon, aliases, refs, _ = tables
    small = kinds.small
    monkeypatch.setattr(kinds, "small", lambda df, size=most_bytes: small(df, most_bytes))
    for least in (0.4, 0.5):
        got = blocks.blocks(entities, canon, aliases, refs, least)
        rows = got.scores.join(got.left, "left").join(got.right, "right").select("entity_id", "canonical_id", "score").collect()
        want = {k: s for k, s in every.items() if s >= least}
        assert len(rows) == len(want) and {tuple(r)[:2]: r.score for r in rows} == want
        assert got.scores.count() < len(want)
        order = sorted(((e, -s, c) for (e, c), s in want.items()))
        best = [(e, c, -s) for e, s, c in order if [x[0] for x in order[: order.index((e, s, c))]].count(e) < 2]
        assert sorted(map(tuple, got.best(2).collect())) == sorted(best)


def test_no_candidate_is_capped(spark, tables, every):
    entities, canon, aliases, refs, edges = tables
    anchored = matching.deterministic(entities, canon, aliases, refs).where("canonical_id is not null").select("entity_id")
    left = entities.join(anchored, "entity_id", "left_anti")
    scores = spark.createDataFrame([(*k, s) for k, s in every.items()], "entity_id string, canonical_id string, score double")
    placed = disposition.dispose(left, scores.join(left.select("entity_id"), "entity_id", "left_semi"), edges, canon)
    want = {r.entity_id: (r.action, r.top_match) for r in placed.collect()}
    got = {r.entity_id: r for r in orchestrator.decided(entities, canon, aliases, refs, edges).collect()}
    assert len(got) == entities.count()
    for e, (action, top) in want.items():
        assert got[e].action == ("QUEUE_FOR_REVIEW" if action == "LLM_FALLBACK" else action) and (action == "NO_MATCH" or got[e].canonical_id == top)
        assert got[e].match_type == {"NO_MATCH": "new", "LLM_FALLBACK": "llm"}.get(action, "scored")
    # the first 50 canonicals by id don't hold the best
    assert got["E006"].canonical_id == "C900" and got["E000"].canonical_id == "C902"
    capped = matching.candidates(entities, canon, aliases, refs)
    assert capped.where("entity_id = 'E006' and canonical_id = 'C900'").count() == 0
    total = {(r.kind, r.name): r.n for r in orchestrator.counts(orchestrator.decided(entities, canon, aliases, refs, edges)).collect()}
    assert total["total", "entities"] == entities.count()


def test_match_counts_has_no_cap_in_its_sql():
    from samewise.plans import queries

    import __spark_entry__  # noqa: F401

    assert "<= 50" not in queries.ORACLES["match_counts"] and "<= 50" in queries.ORACLES["match_results"]


def test_centres_of_blocks_equal_the_scan(spark):
    rng = random.Random(7)
    for n_a, n_b, n_blocks in ((4, 4, 9), (12, 9, 60), (6, 20, 50)):
        first = {f"c:{rng.randint(0, 999):03}": rng.randrange(n_a) for _ in range(5 * n_a)}
        second = {f"e:{rng.randint(0, 999):03}": rng.randrange(n_b) for _ in range(5 * n_b)}
        met = {(rng.randrange(n_a), rng.randrange(n_b)): rng.choice([0.4, 0.5, 0.6, rng.random()]) for _ in range(n_blocks)}
        weight = {k: float(rng.randint(0, 3)) for k in (*first, *second) if rng.random() < 0.7}
        pairs = [(x, y, met[a, b]) for x, a in first.items() for y, b in second.items() if (a, b) in met]
        of = lambda d: spark.createDataFrame(list(d.items()), "node string, kind long")
        rows = onboarding.centred_blocks(of(first), of(second), spark.createDataFrame([(*k, s) for k, s in met.items()], "a long, b long, score double"),
            spark.createDataFrame(list(weight.items()), "node string, weight double")).collect()
        want = scan(pairs, weight)
        assert {r.node: r.centre for r in rows} == want and len(rows) == len(want)
        score = {(x, y): s for x, y, s in pairs} | {(y, x): s for x, y, s in pairs}
        assert all(r.score == score.get((r.node, r.centre)) for r in rows)
    assert onboarding.centred_blocks(of({"c:1": 1}), of({"e:1": 1}), spark.createDataFrame([], "a long, b long, score double"), spark.createDataFrame([], "node string, weight double")).count() == 0


def test_onboarding_has_every_candidate(spark):
    import __spark_entry__ as entry

    from samewise.functions.names import normalize, split_rejects
    from samewise.plans.derive import frame

    sf = "/root/testdata/sf0.001"
    entities = split_rejects(normalize(frame(spark, sf, "incoming")))[0]
    canon, aliases, refs, edges = (frame(spark, sf, n) for n in ("canon", "aliases", "refs", "edges"))
    pairs = matching.signals(entities, canon, aliases).select("entity_id", "canonical_id").distinct().join(matching.own_canonicals(entities, refs), ["entity_id", "canonical_id"], "left_anti")
    scored = [(f"c:{r.canonical_id}", f"e:{r.entity_id}", r.score) for r in scoring.score(pairs, entities, canon, aliases, edges).collect() if r.score >= onboarding.LEAST]
    volume = {f"c:C{r[0]:08}": r[1] for r in spark.read.parquet(f"{sf}/orders.parquet").groupBy("o_custkey").agg(F.sum("o_totalprice")).collect()}
    volume |= {f"e:S{r[0]:08}": r[1] for r in spark.read.parquet(f"{sf}/lineitem.parquet").groupBy("l_suppkey").agg(F.sum("l_extendedprice")).collect()}
    want: dict = {}
    for centre in scan(scored, volume).values():
        want[centre] = want.get(centre, 0) + 1
    assert {r.cluster: r.n_members for r in entry.queries()["onboarding_clusters"](spark, sf).collect()} == want
