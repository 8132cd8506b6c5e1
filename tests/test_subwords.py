"""Vectors of names: grams, weights and cosines by hand."""

from __future__ import annotations

import hashlib
import math

import pytest
from pyspark.sql import functions as F

from samewise.functions import subwords as S
from samewise.operators import graph


def slow_grams(name):
    marked = [f"<{w}>" for w in (name or "").split()]
    return set(marked) | {m[i : i + n] for m in marked for n in (3, 4, 5) for i in range(len(m) - n + 1)}


def slow_vector(grams, weights):
    x = [0.0] * S.SIZE
    for g in grams:
        code = hashlib.md5(g.encode()).hexdigest()
        x[int(code[:6], 16) % S.SIZE] += 1 if code[6] < "8" else -1
    x = [a * w for a, w in zip(x, weights)]
    norm = math.sqrt(sum(a * a for a in x))
    return [a / norm for a in x] if norm else None


NAMES = ["pacific rim technologies international", "meridian capital group", "a", "", "   ", None, "élan 中文", "beck and howell", "capital group"]


def test_grams_weights_and_vectors(spark):
    df = spark.createDataFrame([(i, n) for i, n in enumerate(NAMES)], "id int, name string")
    got = df.select("id", S.grams(F.col("name")).alias("g"), F.transform(S.grams(F.col("name")), S.dimension).alias("d"), F.transform(S.grams(F.col("name")), S.sign).alias("s")).collect()
    for r in got:
        assert set(r.g) == slow_grams(NAMES[r.id]) and len(set(r.g)) == len(r.g)
        assert [(d, s) for d, s in zip(r.d, r.s)] == [S.place(g) for g in r.g]
    weights = S.fitted(df.select("name"))
    held = {n for n in NAMES if n is not None}
    used = {d: sum(any(S.place(g)[0] == d for g in slow_grams(n)) for n in held) for d in (0, 7, S.SIZE - 1, S.place("<capital>")[0])}
    assert len(weights) == S.SIZE and all(weights[d] == pytest.approx(math.log((1 + len(held)) / (1 + n))) for d, n in used.items())
    grams = graph.written(df.select("id", S.grams(F.col("name")).alias("grams")))
    for r in grams.select("id", S.vector(F.col("grams"), weights).alias("v")).collect():
        want = slow_vector(slow_grams(NAMES[r.id]), weights)
        assert r.v is None if want is None else r.v == pytest.approx(want)
    assert S.fitted(df.select("name").where("false")) == [0.0] * S.SIZE


def test_an_abbreviation_is_near_its_full_name(spark):
    canon = spark.createDataFrame([(f"C{i}", n) for i, n in enumerate(["pacific rim technologies international", "meridian capital group", "oslo fish market", "luminos ai", "harbor trust"])], "canonical_id string, value string")
    asked = spark.createDataFrame([("E1", "pacrim tech"), ("E2", "meridian cap"), ("E3", ""), ("E4", None)], "entity_id string, normalized_name string")
    weights = S.fitted(canon.select(F.col("value").alias("name")))
    own = S.vector(F.col("grams"), weights).alias("embedding")
    found = graph.cosine_top(graph.written(S.of_entities(asked)).select("query_id", own), graph.written(graph.written(S.of_registry(canon)).select("vec_id", own)), 1).collect()
    assert {r.query_id: r.vec_id for r in found} == {"E1": "C0", "E2": "C1"}


def test_cosine_top_in_parts_with_odd_vectors(spark):
    import random

    rng = random.Random(3)
    rows = [(i, [float(rng.randint(-2, 2)) for _ in range(rng.choice([3, 3, 4]))]) for i in range(120)] + [(200, None), (201, [None, 1.0, 1.0]), (202, [0.0, 0.0, 0.0]), (203, [])]
    df = spark.createDataFrame(rows, "vec_id int, embedding array<double>").repartition(5)
    got = graph.cosine_top(df.withColumnRenamed("vec_id", "query_id"), df, 4, most_bytes=900)
    good = {i: v for i, v in rows if v and None not in v and any(v)}
    norm = lambda v: math.sqrt(sum(a * a for a in v))
    want = []
    for i, v in good.items():
        near = sorted((-round(sum(a * b for a, b in zip(v, w)) / norm(v) / norm(w), 9), j) for j, w in good.items() if j != i and len(w) == len(v))
        want += [(i, j, k + 1) for k, (_, j) in enumerate(near[:4])]
    assert sorted((r.query_id, r.vec_id, r.position) for r in got.collect()) == sorted(want)
