"""Ranked search against scores of all documents by the formula."""

from __future__ import annotations

import math
import random
from collections import Counter

from samewise.llm import search


def brute(docs: list[tuple], items: list[tuple], k: int) -> list[tuple]:
    own = [(i, search.terms_of(t)) for i, t in docs]
    own = [(i, Counter(t), len(t)) for i, t in own if t]
    n_docs, n_terms = len(own), sum(n for _, _, n in own)
    df = Counter(t for _, c, _ in own for t in c)
    asked: dict = {}
    for i, t in items:
        asked.setdefault(i, set()).update(search.terms_of(t))
    out = []
    for item, terms in asked.items():
        scores = []
        for i, c, n in own:
            m = 100 - 50 + (50 * n * n_docs) // n_terms
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 20 * m)) for t in terms if t in c)
            if s > 0:
                scores.append((-s, i is None, i or 0, i))
        out += [(item, r + 1, i, -s) for r, (s, _, _, i) in enumerate(sorted(scores)[:k])]
    return sorted(out, key=repr)


def corpus(rng: random.Random, n: int) -> list[tuple]:
    words = [f"w{int(rng.paretovariate(0.7)) % 400}" for _ in range(400)] + ["Él", "ÉL", "él", "THE", "the", "x-y", "a_b", "中文", "ÀB"]
    rows = [(rng.randint(0, n), " ".join(rng.choice(words) for _ in range(rng.choice([0, 1, 3, 30, 30, 200])))) for _ in range(n)]
    return rows + rows[:5] + [(None, rows[7][1]), (None, None), (3, None), (4, ""), (5, " -- "), (6, "w1 " * 20_000)]


def frames(spark, docs, items):
    return spark.createDataFrame([(i, t, 1, 2) for i, t in docs], "doc_id long, text string, item_id int, SCORE int"), spark.createDataFrame([(i, t, 3) for i, t in items], "item_id long, text string, doc_id int")


def test_search_equals_brute_force(spark):
    rng = random.Random(3)
    docs = corpus(rng, 300)
    items = [(i, " ".join(rng.choice(docs)[1].split()[:12] if rng.random() < 0.8 else ["the", "w1", "nowhere"])) for i in range(25)] + [(1, "w2 w3"), (1, "w2 w3"), (30, None), (31, ""), (32, "nowhere"), (None, "the w5")]
    got = sorted((tuple(r) for r in search.search(*frames(spark, docs, items), k=7).collect()), key=repr)
    assert got == brute(docs, items, 7)


def test_lists_in_slices_and_items_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(search, "SLICE", 11)
    monkeypatch.setattr(search, "BROADCAST", 3)
    rng = random.Random(4)
    docs = corpus(rng, 120)
    items = [(i, docs[i][1][:60]) for i in range(20)]
    got = sorted((tuple(r) for r in search.search(*frames(spark, docs, items), k=3, block=300).collect()), key=repr)
    assert got == brute(docs, items, 3)


def test_search_of_nothing(spark):
    docs, items = frames(spark, [(1, "a b"), (2, None)], [(1, "a"), (2, "zz")])
    assert [tuple(r) for r in search.search(docs, items).collect()] == brute([(1, "a b")], [(1, "a")], 50)
    assert search.search(docs.where("false"), items).count() == search.search(docs, items.where("false")).count() == 0
