"""String similarity: LCS-based ratios and Jaro-Winkler in Arrow-batched UDFs, and trigram Jaccard in Catalyst.

A UDF measures only what is asked and gets each distinct pair of names once; LCS is bit-parallel, a word for each pair of a batch (over
Python integers for strings beyond 64 characters), and Jaro-Winkler steps over arrays of all pairs of a batch."""

from __future__ import annotations

from collections.abc import Sequence
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

WIDTH = 3
METRICS = ("token_sort", "token_set", "partial", "jaro_winkler")


def lcs(a: str, b: str) -> int:
    """Length of the longest common subsequence (Hyyrö's bit vectors)."""
    if not a or not b:
        return 0
    masks: dict[str, int] = {}
    for i, c in enumerate(a):
        masks[c] = masks.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for c in b:
        hits = row & masks.get(c, 0)
        row = ((row + hits) | (row - hits)) & full
    return len(a) - row.bit_count()


def ratio(a: str, b: str) -> float:
    return 200.0 * lcs(a, b) / (len(a) + len(b)) if a or b else 100.0


def token_sort(a: str, b: str) -> float:
    return ratio(" ".join(sorted(a.split())), " ".join(sorted(b.split())))


def token_set(a: str, b: str) -> float:
    left, right = set(a.split()), set(b.split())
    if not left or not right:
        return 0.0
    both = left & right
    if both and (left <= right or right <= left):
        return 100.0
    x, y = " ".join(sorted(left - right)), " ".join(sorted(right - left))
    s = len(" ".join(sorted(both)))
    la, lb = s + (s > 0) + len(x), s + (s > 0) + len(y)
    best = 100.0 - 100.0 * (len(x) + len(y) - 2 * lcs(x, y)) / (la + lb)
    if both:
        best = max(best, 100.0 - 100.0 * (1 + len(x)) / (s + la), 100.0 - 100.0 * (1 + len(y)) / (s + lb))
    return best


def _windows(short: str, long: str) -> float:
    n, best = len(short), 0.0
    for start in range(1 - n, len(long)):
        part = long[max(0, start) : start + n]
        # 200 * n / (n + len(part)) bounds the ratio of a shorter window
        if part and 200.0 * min(n, len(part)) / (n + len(part)) > best:
            best = max(best, ratio(short, part))
    return best


def partial(a: str, b: str) -> float:
    if not a or not b:
        return 100.0 if a == b else 0.0
    short, long = sorted((a, b), key=len)
    best = _windows(short, long)
    return max(best, _windows(long, short)) if len(a) == len(b) and best < 100 else best


def jaro(a: str, b: str) -> float:
    if not a or not b:
        return 1.0 if a == b else 0.0
    reach = max(0, max(len(a), len(b)) // 2 - 1)
    taken, left = [False] * len(b), []
    for i, c in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if not taken[j] and b[j] == c:
                taken[j] = True
                left.append(c)
                break
    if not left:
        return 0.0
    right = [c for c, t in zip(b, taken) if t]
    m, swaps = len(left), sum(x != y for x, y in zip(left, right)) // 2
    return (m / len(a) + m / len(b) + (m - swaps) / m) / 3


def jaro_winkler(a: str, b: str) -> float:
    s = jaro(a, b)
    if s <= 0.7:
        return s
    prefix = 0
    while prefix < min(4, len(a), len(b)) and a[prefix] == b[prefix]:
        prefix += 1
    return s + 0.1 * prefix * (1 - s)


def jaro_winkler_all(a: Sequence[str], b: Sequence[str]) -> np.ndarray:
    """jaro_winkler of many pairs at once: a step for each place of the longest left string, over all pairs."""
    size_a, size_b = (np.array([len(s) for s in x], np.int64) for x in (a, b))
    left, right = _padded(a, size_a), _padded(b, size_b)
    n, places = len(size_a), np.arange(right.shape[1])
    reach = np.maximum(0, np.maximum(size_a, size_b) // 2 - 1)
    hit, taken = np.zeros(left.shape, bool), np.zeros(right.shape, bool)
    inside = places[None] < size_b[:, None]
    for i in range(left.shape[1]):
        near = inside & (np.abs(places[None] - i) <= reach[:, None]) & (right == left[:, i : i + 1]) & ~taken
        rows = np.flatnonzero(near.any(1) & (i < size_a))
        taken[rows, near[rows].argmax(1)] = True
        hit[rows, i] = True
    m = hit.sum(1)
    # both sides have as many matched characters in each pair, so they lie side by side
    unlike = np.bincount(np.nonzero(hit)[0], left[hit] != right[taken], n)
    with np.errstate(divide="ignore", invalid="ignore"):
        score = (m / size_a + m / size_b + (m - unlike // 2) / m) / 3
    score = np.where((size_a == 0) | (size_b == 0), (size_a == size_b).astype(float), np.where(m == 0, 0.0, score))
    head = min(4, left.shape[1], right.shape[1])
    alike = (left[:, :head] == right[:, :head]) & (np.arange(head)[None] < np.minimum(size_a, size_b)[:, None])
    prefix = np.minimum.accumulate(alike, 1).sum(1) if head else np.zeros(n)
    return np.where(score > 0.7, score + 0.1 * prefix * (1 - score), score)


def _padded(x: Sequence[str], size: np.ndarray) -> np.ndarray:
    """Code points, a row for each string, 0 behind its end."""
    out = np.zeros((len(size), int(size.max(initial=0))), np.uint32)
    out[np.arange(out.shape[1])[None] < size[:, None]] = np.frombuffer("".join(x).encode("utf-32-le", "surrogatepass"), "<u4")
    return out


#: Longest string of which all pairs of a batch are measured at once (a bit for each character), and pairs of a step.
BITS, STEP = 64, 500


def _hits(a: np.ndarray, size_a: np.ndarray, b: np.ndarray, size_b: np.ndarray) -> np.ndarray:
    """For each place of b a word with a bit for each equal character of a."""
    out = np.zeros(b.shape, np.uint64)
    for i in range(a.shape[1]):
        out |= ((b == a[:, i : i + 1]) & (i < size_a)[:, None]).astype(np.uint64) << np.uint64(i)
    return np.where(np.arange(b.shape[1])[None] < size_b[:, None], out, np.uint64(0))


def _lcs_windows(a: Sequence[str], b: Sequence[str], windows: bool) -> np.ndarray:
    """lcs of all pairs, or the highest ratio of a and a window of b as long as a, cut at the ends; no string of a is empty or beyond BITS."""
    size_a, size_b = (np.array([len(s) for s in x], np.int64) for x in (a, b))
    longest, full = int(size_a.max(initial=0)), (~np.uint64(0) >> (BITS - size_a).astype(np.uint64))[:, None]
    hits = _hits(_padded(a, size_a), size_a, _padded(b, size_b), size_b)
    if windows:
        n_starts, steps = longest - 1 + hits.shape[1], longest
        hits = np.pad(hits, ((0, 0), (longest - 1, longest)))
        at = lambda k: np.where((k < size_a)[:, None], hits[:, k : k + n_starts], np.uint64(0))
    else:
        n_starts, steps, at = 1, hits.shape[1], lambda k: hits[:, k : k + 1]
    row = np.repeat(full, n_starts, 1)
    for k in range(steps):
        # what is carried beyond a's bits meets no hit and is cut off at the end
        both = row & at(k)
        row = (row + both) | (row - both)
    found = size_a[:, None] - np.bitwise_count(row & full).astype(np.int64)
    if not windows:
        return found[:, 0]
    start = np.arange(n_starts)[None] - (longest - 1)
    part = np.maximum(0, np.minimum(start + size_a[:, None], size_b[:, None]) - np.maximum(0, start))
    return (200.0 * found / (size_a[:, None] + part)).max(1)


def _stepwise(a: list[str], b: list[str], windows: bool, plain) -> np.ndarray:
    """_lcs_windows in steps of pairs of like sizes; `plain` measures the pairs whose a is beyond BITS; 0 for an empty a or b."""
    out = np.zeros(len(a), float if windows else np.int64)
    fit = [i for i, (x, y) in enumerate(zip(a, b)) if x and y]
    for i in (i for i in fit if len(a[i]) > BITS):
        out[i] = plain(a[i], b[i])
    fit = sorted((i for i in fit if len(a[i]) <= BITS), key=lambda i: (len(a[i]), len(b[i])))
    for k in range(0, len(fit), STEP):
        now = fit[k : k + STEP]
        # a long b takes a step by itself
        parts = [now] if max(len(b[i]) for i in now) <= 16 * BITS else [[i] for i in now]
        for of in parts:
            out[of] = _lcs_windows([a[i] for i in of], [b[i] for i in of], windows)
    return out


def lcs_all(a: Sequence[str], b: Sequence[str]) -> np.ndarray:
    """lcs of many pairs at once."""
    turned = [(x, y) if len(x) <= len(y) else (y, x) for x, y in zip(a, b)]
    return _stepwise([x for x, _ in turned], [y for _, y in turned], False, lcs)


def token_sort_all(a: Sequence[str], b: Sequence[str]) -> np.ndarray:
    """token_sort of many pairs at once."""
    put = {s: " ".join(sorted(s.split())) for s in {*a, *b}}
    x, y = [put[s] for s in a], [put[s] for s in b]
    size = np.array([len(s) + len(t) for s, t in zip(x, y)], np.int64)
    return np.where(size > 0, 200.0 * lcs_all(x, y) / np.maximum(size, 1), 100.0)


def token_set_all(a: Sequence[str], b: Sequence[str]) -> np.ndarray:
    """token_set of many pairs at once."""
    words = {s: frozenset(s.split()) for s in {*a, *b}}
    out, rest = np.zeros(len(a)), []
    for i, (s, t) in enumerate(zip(a, b)):
        left, right = words[s], words[t]
        if left and right:
            both = left & right
            if both and (left <= right or right <= left):
                out[i] = 100.0
            else:
                rest.append((i, len(" ".join(both)), " ".join(sorted(left - right)), " ".join(sorted(right - left))))
    found = lcs_all([x for _, _, x, _ in rest], [y for _, _, _, y in rest]).tolist()
    for (i, s, x, y), n in zip(rest, found):
        la, lb = s + (s > 0) + len(x), s + (s > 0) + len(y)
        best = 100.0 - 100.0 * (len(x) + len(y) - 2 * n) / (la + lb)
        out[i] = max(best, 100.0 - 100.0 * (1 + len(x)) / (s + la), 100.0 - 100.0 * (1 + len(y)) / (s + lb)) if s else best
    return out


def partial_all(a: Sequence[str], b: Sequence[str]) -> np.ndarray:
    """partial of many pairs at once."""
    turned = [(x, y) if len(x) <= len(y) else (y, x) for x, y in zip(a, b)]
    short, long = [x for x, _ in turned], [y for _, y in turned]
    out = _stepwise(short, long, True, _windows)
    again = [i for i, (x, y) in enumerate(turned) if len(x) == len(y) and out[i] < 100]
    out[again] = np.maximum(out[again], _stepwise([long[i] for i in again], [short[i] for i in again], True, _windows))
    return np.where([not x and not y for x, y in turned], 100.0, out)


PAIRWISE = {"token_sort": token_sort_all, "token_set": token_set_all, "partial": partial_all, "jaro_winkler": lambda a, b: 100.0 * jaro_winkler_all(a, b)}


@cache
def string_metrics(*which: str):
    """A function of two columns that gives a struct of the metrics named (0 to 100); nulls count as empty."""
    which = which or METRICS

    @F.pandas_udf(T.StructType([T.StructField(k, T.DoubleType()) for k in which]))
    def measured(a: pd.Series, b: pd.Series) -> pd.DataFrame:
        left, right = a.fillna("").tolist(), b.fillna("").tolist()
        return pd.DataFrame({k: PAIRWISE[k](left, right) for k in which}, columns=list(which), dtype=float)

    return measured


@F.pandas_udf(T.StringType())
def two_places(score: pd.Series) -> pd.Series:
    """A score with two places as Python rounds them: ties of the binary value, not of its shortest decimal form."""
    return score.map(lambda x: None if x is None or x != x else f"{x:.2f}")


def trigrams(s: Column) -> Column:
    """The trigrams of '^', s, '$' in order; none for null or ''."""
    marked = F.concat(F.lit("^"), s, F.lit("$"))
    return F.when(F.length(s) > 0,
        F.transform(F.sequence(F.lit(1), F.length(s)), lambda i: F.substring(marked, i, F.lit(WIDTH)))).otherwise(F.array()
        .cast("array<string>"))


def grams(s: Column) -> Column:
    """The distinct trigrams of the trimmed string; none if it is shorter than a trigram."""
    x = F.trim(F.coalesce(s, F.lit("")))
    return F.when(F.length(x) >= WIDTH, F.array_distinct(trigrams(x))).otherwise(F.array().cast("array<string>"))


def grams_jaccard(left: Column, right: Column) -> Column:
    """Jaccard of two arrays of grams(); 0 if either is empty."""
    both = F.size(F.array_intersect(left, right))
    return F.when((F.size(left) > 0) & (F.size(right) > 0), both / (F.size(left) + F.size(right) - both)).otherwise(F.lit(0.0))


def trigram_jaccard(a: Column, b: Column) -> Column:
    """Jaccard of distinct trigrams; 0 if either trimmed string is shorter than a trigram."""
    return grams_jaccard(grams(a), grams(b))


def tokens(s: Column) -> Column:
    return F.filter(F.split(F.coalesce(s, F.lit("")), r"(?U)\s+"), lambda t: t != "")
