"""Quality of a grouping against all pairs of items."""

from __future__ import annotations

import random
from itertools import combinations

import pytest

from samewise.operators import evaluation


def brute(found: dict, truth: dict) -> tuple:
    items = sorted(truth)
    f = {i: ("alone", i) if found.get(i) is None else found[i] for i in items}
    t = {i: ("alone", i) if truth[i] is None else truth[i] for i in items}
    pairs = list(combinations(items, 2))
    a, b = sum(f[x] == f[y] for x, y in pairs), sum(t[x] == t[y] for x, y in pairs)
    both = sum(f[x] == f[y] and t[x] == t[y] for x, y in pairs)
    shared = lambda i, g: sum(f[j] == f[i] and t[j] == t[i] for j in items) / sum(g[j] == g[i] for j in items)
    n = len(items)
    return n, a, b, both, both / a if a else None, both / b if b else None, sum(shared(i, f) for i in items) / n if n else None, sum(shared(i, t) for i in items) / n if n else None


@pytest.mark.parametrize("seed", range(3))
def test_quality_equals_all_pairs(spark, seed):
    rng = random.Random(seed)
    truth = {f"i{k}": rng.choice(["a", "b", "c", "d", None]) for k in range(40)}
    found = {f"i{k}": rng.choice([truth.get(f"i{k}"), "x", None, "i3"]) for k in range(3, 45)}
    rows = lambda d: spark.createDataFrame([*d.items(), (None, "a"), ("i3", d["i3"])], "item string, group string")
    got = tuple(evaluation.quality(rows(found), rows(truth)).first())
    assert got == pytest.approx(brute(found, truth))


def test_quality_of_nothing_and_of_a_giant_group(spark):
    none = spark.createDataFrame([], "item string, group string")
    assert tuple(evaluation.quality(none, none).first()) == (0, 0, 0, 0, None, None, None, None)
    n = 300_000
    big = spark.range(n).selectExpr("cast(id as string) as item", "'g' as group")
    assert tuple(evaluation.quality(big, big).first()) == (n, n * (n - 1) // 2, n * (n - 1) // 2, n * (n - 1) // 2, 1, 1, 1, 1)


def test_by_kind(spark):
    truth = spark.createDataFrame([("1", "a", "k"), ("2", "b", "k"), ("3", "c", "l"), ("4", None, "l")], "item string, group string, kind string")
    found = spark.createDataFrame([("1", "a"), ("2", "c"), ("4", "d")], "item string, group string")
    assert sorted(map(tuple, evaluation.by_kind(found, truth).collect())) == [("k", 2, 2, 1), ("l", 2, 1, 0)]
