import pytest
from pyspark.sql import functions as F

from samewise.operators import disposition, evidence, graph, kinds, matching, registry, scoring


@pytest.fixture(scope="module")
def sides(spark):
    """Many rows of few names: 60 entities of 3 names, 90 canonicals of 4, with an alias of a third."""
    names, others = ["atlas group", "boreal  group", "cora"], ["atlas media", "boreal group", "cora group", "zeta"]
    entities = spark.createDataFrame([(f"E{i:03}", names[i % 3]) for i in range(60)] + [("E900", " ")], "entity_id string, normalized_name string")
    canon = spark.createDataFrame([(f"C{i:03}", "t1", others[i % 4]) for i in range(90)], "canonical_id string, tenant_id string, canonical_name string")
    aliases = spark.createDataFrame([(f"C{i:03}", "cora atlas", None) for i in range(0, 90, 3)], "canonical_id string, value string, confidence double")
    return entities, canon, aliases, matching.met(entities, canon, aliases)


def _shared(sides, mark):
    entities, canon, aliases, _ = sides
    return matching.signals(entities, canon, aliases).where(F.startswith("signal", F.lit(mark))).groupBy("entity_id", "canonical_id").agg(F.count("*").alias("n"))


def _rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def test_pairs_by_kinds(sides):
    entities, canon, aliases, met = sides
    want = _rows(_shared(sides, "token:"), "entity_id", "canonical_id", "n")
    assert want and _rows(met.keys(), "entity_id", "canonical_id", "n") == want
    # the names meet, not the rows that have them
    assert met.pairs.count() <= 3 * 8 < len(want)
    trigrams = matching.met(entities, canon, aliases, matching.trigram_marks)
    assert _rows(trigrams.keys(), "entity_id", "canonical_id", "n") == _rows(_shared(sides, "trigram:"), "entity_id", "canonical_id", "n")
    counts = dict(_rows(met.counts(), "entity_id", "n_met"))
    assert counts == {e: sum(x[0] == e for x in want) for e in {x[0] for x in want}}
    only = entities.where("entity_id < 'E004'").select("entity_id")
    assert _rows(met.keys(only=only), "entity_id", "canonical_id", "n") == [x for x in want if x[0] < "E004"]


def test_without_broadcast(sides, monkeypatch):
    entities, canon, aliases, met = sides
    want = _rows(met.keys(), "entity_id", "canonical_id", "n")
    monkeypatch.setattr(kinds, "small", lambda df, most_bytes=0: df)
    assert _rows(matching.met(entities, canon, aliases).keys(), "entity_id", "canonical_id", "n") == want


def test_ranks_without_pairs(sides):
    met = sides[3]
    number = lambda c: F.substring(c, 2, 9).cast("long")
    left, right = number("entity_id") * 3 % 7, number("canonical_id") * 2 % 7
    score = lambda a, b: ((a + b) % 7).cast("double") / 7
    scores = _shared(sides, "token:").select("entity_id", "canonical_id", score(left, right).alias("score"))
    columns = ("entity_id", "canonical_id", "score", "position")
    want = _rows(disposition.ranked(scores), *columns)
    got = met.ranked(left, right, score, 7)
    assert _rows(got, *columns) == want
    # pairs are neither shuffled nor sorted by entity
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(entity_id" not in plan
    best = disposition.ranked(met.first(right, 2).select("entity_id", "canonical_id", score(left, right).alias("score")))
    assert _rows(best.where("position <= 2"), *columns) == [r for r in want if r[3] <= 2]
    # of each mark only the first: at most two of seven marks an entity
    assert met.first(right, 2).groupBy("entity_id").count().agg(F.max("count")).first()[0] <= 14


def test_signals_by_kinds(sides):
    entities, canon, aliases, met = sides
    columns = ("entity_id", "canonical_id", "signal")
    want = matching.signals(entities, canon, aliases).where("signal like 'token:%'")
    assert _rows(met.signals(), *columns) == _rows(want, *columns)


def test_evidence_in_the_scores_own_columns(spark):
    own = spark.createDataFrame([("E1", "C1", 0.8, 1, 2, 0, 1, 20, 9), ("E2", "C1", 0.95, 1, 2, 0, 1, 20, 9)],
        "entity_id string, canonical_id string, score double, " + ", ".join(f"{c} int" for c in evidence.RAW))
    joined = evidence.boosted(own.select("entity_id", "canonical_id", "score"), own)
    assert _rows(evidence.boosted(own), "entity_id", "score", "boost", "items") == _rows(joined, "entity_id", "score", "boost", "items")


def test_orphans_are_looked_for_once(spark):
    canon = spark.createDataFrame([("C1", "t1", "a", "client", "organization")], "canonical_id string, tenant_id string, canonical_name string, entity_type string, entity_category string")
    aliases = spark.createDataFrame([("C1", "b", "x")], "canonical_id string, value string, source string")
    refs = spark.createDataFrame([("C1", "x", "1")], "canonical_id string, source string, external_id string")
    edges = spark.createDataFrame([("C1", "C9")] * 50, "source_node string, target_node string")
    found = registry.violations(canon, aliases, refs, edges)
    assert [tuple(r) for r in found.collect()] == [("edge_orphan", "C9")]
    lines = [x.strip(" :+-|") for x in found._jdf.queryExecution().optimizedPlan().toString().splitlines()]
    joins = [i for i, x in enumerate(lines) if x.startswith("Join LeftAnti")]
    # a hub's rows become one before they are sorted and joined
    assert len(joins) == 4 and all(lines[i + 1].startswith("Aggregate") for i in joins)


@pytest.mark.parametrize("most_bytes", [64 << 20, 0])
def test_candidates_by_kinds(spark, sides, most_bytes):
    entities, canon, aliases, _ = sides
    records = entities.withColumn("source", F.lit("x")).withColumn("source_id", F.col("entity_id"))
    # own canonicals: two of E000, one of them its first candidate
    refs = spark.createDataFrame([("C000", "x", "E000"), ("C001", "x", "E000"), ("C003", "x", "E001")], "canonical_id string, source string, external_id string")
    shared = {}
    for e, c, s in _rows(matching.signals(entities, canon, aliases), "entity_id", "canonical_id", "signal"):
        shared.setdefault(e, {}).setdefault(c, []).append(s)
    own = {("E000", "C000"), ("E000", "C001"), ("E001", "C003")}
    want = [(e, c, sorted(of[c])) for e, of in shared.items() for c in sorted(c for c in of if (e, c) not in own)[:7]]
    got = matching.candidates(records, canon, aliases, refs, most=7, most_bytes=most_bytes)
    assert _rows(got, "entity_id", "canonical_id", "blocking_signals") == sorted(want)
    # pairs of keys are not ranked against each other, an entity takes its kind's list
    assert "Window" not in got._jdf.queryExecution().optimizedPlan().toString()


def test_scores_by_kinds(spark, sides):
    entities, canon, aliases, met = sides
    rows = entities.withColumn("category", F.when(F.col("entity_id") < "E030", "psa"))
    edges = spark.createDataFrame([], "source_node string, target_node string, relationship string")
    got = scoring.score(met.keys(), rows, canon, aliases, edges)
    each = [r for e in ("E000", "E031", "E059") for r in _rows(scoring.score(met.keys(), rows.where(F.col("entity_id") == e), canon, aliases, edges), *got.columns)]
    assert each and [r for r in _rows(got, *got.columns) if r[0] in ("E000", "E031", "E059")] == each
    assert got.count() == met.keys().count()
    # names are measured before pairs of keys come, and don't go with them
    assert "category#" not in got.select("entity_id", "score")._jdf.queryExecution().optimizedPlan().toString().split("Join")[0]
    assert "kind" in got._jdf.queryExecution().optimizedPlan().toString()


def test_vectors_that_are_alike_are_scanned_once(spark, monkeypatch):
    rows = [(i, [float(i % 4), 1.0, float(i % 3)]) for i in range(40)] + [(90, None), (91, [0.0, 0.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id int, v array<double>")
    asked = df.where("vec_id % 5 = 0").withColumnRenamed("vec_id", "query_id")
    want = _rows(graph.cosine_top(asked.withColumnRenamed("v", "embedding"), df.withColumnRenamed("v", "embedding"), 4), "query_id", "vec_id", "cosine", "position")
    flat, seen = graph.cosine_top, []
    monkeypatch.setattr(graph, "cosine_top", lambda q, v, k: seen.append((q.count(), v.count())) or flat(q, v, k))
    assert want and _rows(graph.alike_top(asked, df, "v", lambda c: c, 4), "query_id", "vec_id", "cosine", "position") == want
    assert seen[0][1] == 14 and seen[0][0] <= 9


def test_evidence_keeps_a_pair_one_row(spark):
    pairs = spark.createDataFrame([(f"E{i % 5}", f"C{i % 7}") for i in range(70)], "entity_id string, canonical_id string")
    codes = spark.createDataFrame([(f"E{i % 4}", f"CEN-AB{i % 6}-x") for i in range(20)], "entity_id string, code string")
    memos = spark.createDataFrame([(f"C{i % 6}", f"for cen, ab{i % 5}1 ab{i % 4}") for i in range(30)], "canonical_id string, memo string")
    at = lambda rows, key: spark.createDataFrame(rows, f"{key} string, period string, amount double, seen string").withColumn("seen", F.col("seen").cast("date"))
    left = at([(f"E{i % 4}", f"p{i % 3}" if i % 7 else None, 100.0 * (i % 3), f"2024-01-{i % 9 + 1:02}") for i in range(24)], "entity_id")
    right = at([(f"C{i % 6}", f"p{i % 4}", 100.0 * (i % 4), f"2024-02-{i % 9 + 1:02}") for i in range(24)], "canonical_id")
    sums = lambda df, key: {(r[0], r[1]): r[2] for r in df.where("period is not null").groupBy(key, "period").agg(F.sum("amount")).collect()}
    here, there = sums(left, "entity_id"), sums(right, "canonical_id")
    words = lambda df: {k: {w for r in df.collect() if r[0] == k for w in r[1].upper().replace("-", " ").replace(",", " ").split() if len(w) >= 3} for k in {r[0] for r in df.collect()}}
    of, held = words(codes), words(memos)
    want = {(e, c): (len(of.get(e, set()) & held.get(c, set())), sum(abs(x - there[c, p]) <= min(500, 0.02 * there[c, p]) for (k, p), x in here.items() if k == e and (c, p) in there))
        for e, c in {tuple(r) for r in pairs.collect()}}
    got = evidence.raw_counts(pairs, codes, memos, left, right)
    assert {(r[0], r[1]): (r[2], r[3]) for r in got.collect()} == want and got.count() == len(want)
    days = {(r[0], r[1]): r[2] for r in evidence.days_apart(pairs, left, right).collect()}
    assert {(r[0], r[1]): r[4] for r in got.collect()} == days and days["E4", "C0"] is None
    # no row for each fragment or period of a pair: what follows the pairs are joins by one key
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan and plan.count("Aggregate") == 1
