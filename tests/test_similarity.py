import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from samewise.functions import similarity as S

words = st.text("abc d", max_size=14)


def slow_lcs(a, b):
    t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
    return t[-1][-1]


@settings(max_examples=300, deadline=None)
@given(words, words)
def test_lcs(a, b):
    assert S.lcs(a, b) == slow_lcs(a, b)


@settings(max_examples=200, deadline=None)
@given(words, words)
def test_partial_by_all_windows(a, b):
    short, long = sorted((a, b), key=len)
    if not short:
        return
    best = lambda s, t: max(S.ratio(s, t[max(0, i) : i + len(s)]) for i in range(1 - len(s), len(t)))
    want = max(best(short, long), best(long, short)) if len(a) == len(b) else best(short, long)
    assert S.partial(a, b) == pytest.approx(want)


def test_known_scores():
    assert S.token_sort("b a", "a b") == 100 and S.token_set("a b c", "a b") == 100 and S.token_set("", "a") == 0
    assert round(S.jaro_winkler("martha", "marhta"), 4) == 0.9611 and S.jaro_winkler("", "a") == 0


def test_jaro_winkler_against_duckdb():
    import duckdb

    rng = random.Random(1)
    pairs = [("".join(rng.choices("abcde ", k=rng.randint(1, 12))), "".join(rng.choices("abcde ", k=rng.randint(1, 12)))) for _ in range(300)]
    for a, b in pairs:
        assert S.jaro_winkler(a, b) == pytest.approx(duckdb.execute("select jaro_winkler_similarity(?, ?)", [a, b]).fetchone()[0])
    pairs += [("", ""), ("", "a"), ("a", ""), ("é😀x", "é😀y"), ("aaaa", "aa")]
    assert S.jaro_winkler_all(*zip(*pairs)).tolist() == pytest.approx([S.jaro_winkler(a, b) for a, b in pairs])
    assert S.jaro_winkler_all([], []).tolist() == [] and S.jaro_winkler_all(["", ""], ["", ""]).tolist() == [1, 1]


def test_columns(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([("ibm", "ibm"), ("ab", "ab"), (None, "x"), ("abcd", "abce")], "a string, b string")
    got = [r[0] for r in df.select(S.trigram_jaccard(F.col("a"), F.col("b"))).collect()]
    assert got == [1.0, 0.0, 0.0, pytest.approx(2 / 6)]
    assert df.select(S.string_metrics()("a", "b").alias("m")).collect()[2].m.token_set == 0
    assert [r[0] for r in spark.sql("select 0.125d as x union all select 0.645d").select(S.two_places("x")).collect()] == ["0.12", "0.65"]


def test_all_pairs_at_once():
    rng = random.Random(2)
    make = lambda: "".join(rng.choices("abcd  é😀", k=rng.choice((0, 1, 2, 5, 12, 12, 20, 63, 64, 65, 90))))
    pairs = [(make(), make()) for _ in range(1500)] + [("", ""), ("", "a"), ("a", ""), ("a b", "b a"), ("\0a", "a\0"), ("ab", "ab" * 900), (" ", "  ")]
    pairs += [(x, x[::-1]) for x, _ in pairs[:50]] + [(x, f"{x} d") for x, _ in pairs[:50]]
    a, b = map(list, zip(*pairs))
    assert S.lcs_all(a, b).tolist() == [S.lcs(x, y) for x, y in pairs]
    # to the last bit
    for all_, one in ((S.token_sort_all, S.token_sort), (S.token_set_all, S.token_set), (S.partial_all, S.partial)):
        assert all_(a, b).tolist() == [one(x, y) for x, y in pairs]
        assert all_([], []).tolist() == []


def test_many_pairs_take_less_than_each():
    import time

    rng = random.Random(3)
    a, b = ([" ".join("".join(rng.choices("abcdefgh", k=6)) for _ in range(3)) for _ in range(4000)] for _ in range(2))
    began = time.process_time()
    S.partial_all(a, b)
    once = time.process_time() - began
    began = time.process_time()
    for x, y in zip(a[:400], b[:400]):
        S.partial(x, y)
    assert once < 10 * (time.process_time() - began) / 4
