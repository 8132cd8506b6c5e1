"""Fuzzy search against a scan of all names."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from samewise.functions.similarity import partial
from samewise.operators import lookup


def distance(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def brute(names: list[tuple], searches: list[tuple], k: int) -> list[tuple]:
    most = lambda w: 0 if len(w) <= 3 else 1 if len(w) <= 7 else 2
    known = {(c, v.strip().lower()) for c, v in names if v}
    best: dict = {}
    for s, t in searches:
        words = (t or "").strip().lower().split()
        for c, v in known if words else ():
            if all(any(distance(w, x) <= most(w) for x in v.split()) for w in words):
                score = round(partial(" ".join((t or "").strip().lower().split(" ")), v), 6)
                best[s, c] = min(best.get((s, c), (1, "")), (-score, v))
    out = []
    for s in {s for s, _ in best}:
        rows = sorted((v[0], c, v[1]) for (s2, c), v in best.items() if s2 == s)
        out += [(s, c, v, -score, i + 1) for i, (score, c, v) in enumerate(rows[:k])]
    return sorted(out)


def noisy(rng: random.Random, w: str) -> str:
    for _ in range(rng.choice([0, 0, 1, 1, 2, 3])):
        i = rng.randint(0, len(w))
        w = rng.choice([w[:i] + rng.choice("abcxyz") + w[i:], w[:i] + w[i + 1 :], w[:i] + "q" + w[i + 1 :]])
    return w


def test_search_equals_a_scan(spark):
    rng = random.Random(5)
    stems = ["meridian", "capital", "group", "pacific", "rim", "technologies", "ab", "beck", "howell", "consultinggroupofoslo", "o", "élan", "grup"]
    names = [(f"C{i % 90}", " ".join(noisy(rng, rng.choice(stems)) for _ in range(rng.randint(1, 4)))) for i in range(220)]
    names += [("C1", None), ("C2", ""), ("C3", "  "), ("C4", "Meridian CAPITAL"), ("C5", "meridian capital"), ("C6", "group"), ("C6", "group")]
    searches = [(i, " ".join(noisy(rng, rng.choice(stems)) for _ in range(rng.randint(1, 3)))) for i in range(70)] + [(100, None), (101, " "), (102, "GROUP group"), (103, "nothing like it"), (3, "meridian")]
    index = lookup.Names(spark.createDataFrame(names, "canonical_id string, value string"))
    got = index.search(spark.createDataFrame(searches, "search_id int, text string"), 4)
    found = sorted((r.search_id, r.canonical_id, r.value, round(r.score, 6), r.position) for r in got.collect())
    assert found == brute(names, searches, 4) and len(found) > 60
    assert lookup.Names(spark.createDataFrame([], "canonical_id string, value string")).search(spark.createDataFrame(searches, "search_id int, text string")).count() == 0


def test_deletions_meet_for_all_words_within_reach(spark):
    rng = random.Random(6)
    pairs = []
    for _ in range(600):
        a = "".join(rng.choices("abc", k=rng.randint(1, 14)))
        pairs.append((a, noisy(rng, a)))
    df = spark.createDataFrame(pairs, "asked string, word string").where("word <> ''")
    reach = lookup.edits(F.length("word") + 2 - (F.length("word") < 6).cast("int"))
    met = F.arrays_overlap(lookup.deletions(F.col("asked"), lookup.edits(F.length("asked"))), lookup.deletions(F.col("word"), reach))
    rows = df.select("asked", "word", met.alias("met"), (F.levenshtein("asked", "word") <= lookup.edits(F.length("asked"))).alias("near")).collect()
    assert all(r.met for r in rows if r.near) and sum(r.near for r in rows) > 200


def test_no_join_of_all_pairs(spark):
    names = spark.range(50).selectExpr("concat('C', id) as canonical_id", "concat('name ', id) as value")
    rows = lookup.Names(names).search(spark.range(5).selectExpr("id as search_id", "concat('name ', id) as text"))
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert "Join Cross" not in plan and "Join Inner\n" not in plan


def test_a_text_is_looked_up_once(spark):
    names = [(f"C{i:03}", v) for i in range(60) for v in (["atlas group", "atlas media"][i % 2], "boreal")]
    searches = [(f"S{i}", ["atlas", "boreal", "atlas group"][i % 3]) for i in range(30)] + [("S0", "boreal")]
    index = lookup.Names(spark.createDataFrame(names, "canonical_id string, value string"))
    got = index.search(spark.createDataFrame(searches, "search_id string, text string"), 7)
    rows = sorted((r.search_id, r.canonical_id, r.value, round(r.score, 6), r.position) for r in got.collect())
    assert rows == brute(names, searches, 7)
    # what is measured is stored by text before searches come
    assert "ArrowEvalPython" not in got._jdf.queryExecution().optimizedPlan().toString()
