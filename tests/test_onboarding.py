"""Onboarding clusters against the scan itself."""

from __future__ import annotations

import random

from samewise.operators import onboarding


def scan(pairs: list[tuple], weight: dict) -> dict:
    best: dict = {}
    for a, b, s in pairs:
        if a is not None and b is not None and s is not None and a != b:
            k = (min(a, b), max(a, b))
            best[k] = max(s, best.get(k, s))
    centre: dict = {}
    for (a, b), _ in sorted(best.items(), key=lambda x: (-x[1], x[0])):
        if a not in centre and b not in centre:
            c = b if weight.get(b, 0) > weight.get(a, 0) else a
            centre[a] = centre[b] = c
        elif centre.get(a) == a and b not in centre:
            centre[b] = a
        elif centre.get(b) == b and a not in centre:
            centre[a] = b
    return centre


def run(spark, pairs, weight):
    df = spark.createDataFrame(pairs, "a string, b string, score double")
    rows = onboarding.centred(df, spark.createDataFrame(list(weight.items()), "node string, weight double")).collect()
    assert len({r.node for r in rows}) == len(rows)
    return {r.node: r.centre for r in rows}


def test_centres_equal_the_scan(spark):
    rng = random.Random(4)
    for n, m in ((12, 30), (60, 90), (40, 200)):
        pairs = [(f"n{rng.randint(0, n)}", f"n{rng.randint(0, n)}", rng.choice([0.4, 0.5, 0.6, 0.7, rng.random()])) for _ in range(m)] + [(None, "n1", 0.9), ("n1", "n2", None)]
        weight = {f"n{i}": float(rng.randint(0, 3)) for i in range(0, n, 2)}
        assert run(spark, pairs, weight) == scan(pairs, weight)


def test_a_chain_of_weak_links_is_not_one_cluster(spark):
    chain = [(f"n{i:02d}", f"n{i + 1:02d}", 0.45) for i in range(12)]
    got = run(spark, chain, {"n00": 1.0})
    assert got == scan(chain, {"n00": 1.0}) and len(set(got.values())) >= 4
    star = [("hub", f"m{i}", 0.9 - i / 100) for i in range(20)]
    assert set(run(spark, star, {"hub": 5.0}).values()) == {"hub"}


def test_proposals(spark):
    pairs = [("a1", "b1", 0.95), ("a1", "b2", 0.80), ("a2", "b3", 0.50), ("a3", "b4", 0.30), ("a4", "b5", 0.75)]
    nodes = [("a1", "acme inc", "accounting", 50.0), ("b1", "acme", "psa", 70.0), ("b2", "acme", "psa", 10.0), ("a2", "beta", "accounting", 900.0), ("b3", "beta gmbh", "psa", 1.0), ("a4", None, None, 2.0)]
    rows = onboarding.proposals(spark.createDataFrame(pairs, "a string, b string, score double"), spark.createDataFrame(nodes, "node string, name string, category string, volume double")).orderBy("priority").collect()
    got = [(r.cluster, r.proposed_name, r.aliases, r.n_members, round(r.confidence, 3), r.n_assess, r.action, r.volume, r.priority) for r in rows]
    # b1 has most transactions of the best pair, so it is the centre that a1 joins, and b2, which is linked to a1 alone, is in none
    assert got == [
        ("a2", "beta", ["psa: beta gmbh"], 2, 0.5, 1, "assess", 901.0, 1),
        ("b1", "acme", ["accounting: acme inc"], 2, 0.95, 0, "confirm", 120.0, 2),
        ("a4", None, [], 2, 0.75, 0, "review", 2.0, 3),
    ]
    assert onboarding.proposals(spark.createDataFrame([], "a string, b string, score double"), spark.createDataFrame(nodes, "node string, name string, category string, volume double")).count() == 0
