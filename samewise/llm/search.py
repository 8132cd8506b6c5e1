"""Ranked lexical search by three-phase uniform thresholds (TPUT) over postings that are partitioned by term.

A posting holds what a term adds to a document's score, its impact, so a score is a sum over lists, and the lists of all items are one
table: dealt by term, long lists in slices, each sorted by falling impact. An item of m terms is answered in three phases:

1. The heads of its lists give partial sums. The documents of the best sums are looked up, and the k-th best of their scores is a lower
   bound of the k-th best of all.
2. A document that reaches the bound has an impact of an m-th of it in some list at least. So every list is read down to that one
   threshold. A document goes if its sum, with just less than the threshold for each list it wasn't met in, is below the bound.
3. The rest are looked up in whole, and the k best stay.

Scores are 64-bit integers, so bounds are exact and every document that could reach the k-th place is looked up."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import partial, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from samewise.llm.common import bounded_batches, cut, discard

#: What a term is, the scale of weights and of scores, the share of a document's length in its norm.
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
WEIGHT, SCALE, HALF = 1_000, 1_000_000_000, 50
#: Latin capitals alone are lower-cased.
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SLICE = 20_000  # postings of a list that one task sorts, about
BLOCK = 4_000_000  # characters of items that are answered together
CELLS, POSTINGS = 2_000_000, 20_000  # sums of documents and items, and postings, that a task works on at once
BROADCAST = 1_000_000  # candidates that are broadcast at most, as pairs of numbers


def lowered(term: str) -> str:
    return term.lower() if term.isascii() else term.translate(LOWER)


def terms_of(text: str | None) -> list[str]:
    return [lowered(t) for t in re.findall(TERM, text)] if text else []


def _vectors(batches: Iterator[pa.RecordBatch], wanted) -> Iterator[pa.RecordBatch]:
    """n, and the wanted terms with their counts, of every text."""
    known, find = wanted.value, re.compile(TERM).findall
    kind = pa.list_(pa.struct([("term", pa.int32()), ("tf", pa.int64())]))
    for b in batches:
        sizes, found = [], []
        for t in b.column(0).to_pylist():
            own = find(t or "")
            sizes.append(len(own))
            counts: Counter = Counter()
            for w, n in Counter(own).items():
                if (k := known.get(lowered(w))) is not None:
                    counts[k] += n
            found.append([{"term": k, "tf": n} for k, n in counts.items()])
        yield pa.RecordBatch.from_arrays([b.column(1), pa.array(sizes, pa.int64()), pa.array(found, kind)], names=["doc_id", "n", "terms"])


class _Plan:
    """The items of each term, and what holds for each item: terms, bound and threshold."""

    def __init__(self, items: list, known: dict[str, int], bounds: list[int]):
        pairs = np.array(sorted((known[t], i) for i, (_, own) in enumerate(items) for t in own), np.int64).reshape(-1, 2)
        self.items, self.starts = pairs[:, 1], np.searchsorted(pairs[:, 0], np.arange(len(known) + 1))
        self.m, self.bound = np.array([len(own) for _, own in items], np.int64), np.array(bounds, np.int64)
        self.least = np.maximum(1, -(-self.bound // self.m))
        self.floors = np.minimum.reduceat(self.least[self.items], self.starts[:-1])

    def possible(self, doc: np.ndarray, term: np.ndarray, impact: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Documents (numbered from 0) and items whose bound the documents' postings, and less than the threshold for each list that lacks, can reach."""
        n, size = self.starts[term + 1] - self.starts[term], len(self.m)
        each = np.repeat(np.arange(len(term)), n)
        item = self.items[np.repeat(self.starts[term] - np.cumsum(n) + n, n) + np.arange(len(each))]
        over = impact[each] >= self.least[item]
        each, item = each[over], item[over]
        cell, cells = doc[each] * size + item, (int(doc[-1]) + 1) * size
        seen = np.bincount(cell, impact[each], cells).astype(np.int64).reshape(-1, size)  # sums far below 2^53, so exact
        lists = np.bincount(cell, minlength=cells).reshape(-1, size)
        return np.nonzero((lists > 0) & (seen + (self.m - lists) * (self.least - 1) >= self.bound))


def _possible(batches: Iterator[pa.RecordBatch], plan: _Plan) -> Iterator[pa.RecordBatch]:
    """item, row of what plan.possible() leaves; postings come by row, and a batch's last document waits for the next batch."""
    docs_at_once = max(1, CELLS // len(plan.m))
    held = [np.zeros(0, np.int64)] * 3

    def done(row, term, impact):
        first = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]])[: len(row)])
        a = 0
        while a < len(first):
            b = min(len(first), a + docs_at_once, max(a + 1, int(np.searchsorted(first, first[a] + POSTINGS, "right")) - 1))
            lo, hi = first[a], first[b] if b < len(first) else len(row)
            doc, item = plan.possible(np.repeat(np.arange(b - a), np.diff(np.append(first[a:b], hi))), term[lo:hi], impact[lo:hi])
            yield pa.RecordBatch.from_arrays([pa.array(item, pa.int32()), pa.array(row[first[a + doc]], pa.int64())], names=["item", "row"])
            a = b

    for b in batches:
        held = [np.concatenate([h, c.to_numpy(zero_copy_only=False).astype(np.int64)]) for h, c in zip(held, b.columns)]
        if len(held[0]):
            to = int(np.searchsorted(held[0], held[0][-1]))
            yield from done(*(h[:to] for h in held))
            held = [h[to:] for h in held]
    yield from done(*held)


def _blocks(items: DataFrame, block: int) -> Iterator[list]:
    """Items with their terms, about `block` characters of their texts at a time: what the driver holds at once."""
    rows = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).distinct()
    n = max(1, -(-(rows.agg(F.sum(F.length("text"))).first()[0] or 0) // block))
    for k in range(n):
        terms: dict = {}
        for r in rows.where(F.pmod(F.xxhash64("item_id"), F.lit(n)) == k).collect():
            terms.setdefault(r["item_id"], set()).update(terms_of(r["text"]))
        if any(terms.values()):
            yield [(i, sorted(t)) for i, t in terms.items() if t]


def search(docs: DataFrame, items: DataFrame, k: int = 50, depth: int | None = None, block: int = BLOCK) -> DataFrame:
    """item_id, rank (from 1), doc_id, score: for each item the k documents of the highest scores above 0, ties by ascending doc_id.

    docs: doc_id, text. items: item_id, text. depth: postings of each slice that count as its head, k or more.
    A null or empty text holds no term: such a document counts nowhere, such an item has no rows. Texts that share an item_id, null
    too, are one item of all their terms. Documents that share a doc_id are ranked apart, null ids after all others of their score.
    Extra columns are ignored, whatever their names; an empty table gives no rows."""
    spark = docs.sparkSession
    bounded_batches(spark)
    texts = docs.select(F.col("text").cast("string").alias("text"), F.col("doc_id").cast("long").alias("doc_id")).where("text is not null and text <> ''")
    found = [_answer(texts, own, k, max(k, depth or 4 * k)) for own in _blocks(items, block)]
    return reduce(DataFrame.unionByName, found) if found else spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")


def _answer(texts: DataFrame, items: list, k: int, depth: int) -> DataFrame:
    """search() for one block of items: pairs of item_id and terms."""
    spark = texts.sparkSession
    known = {t: i for i, t in enumerate(sorted({t for _, own in items for t in own}))}
    asked = F.broadcast(spark.createDataFrame([(i, known[t], len(own)) for i, (_, own) in enumerate(items) for t in own], "item int, term int, m int"))
    names = F.broadcast(spark.createDataFrame([(i, name) for i, (name, _) in enumerate(items)], "item int, item_id long"))
    run = partial(_vectors, wanted=spark.sparkContext.broadcast(known))
    vectors = texts.mapInArrow(run, "doc_id long, n long, terms array<struct<term int, tf long>>").where("n > 0")
    vectors = cut(vectors.withColumn("row", F.monotonically_increasing_id()), "vectors")  # fixed by the write
    n_docs, n_terms = vectors.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    df = vectors.select(F.explode("terms.term").alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    # a row for each term of the items, so as bounded as they are
    weights = F.broadcast(cut(df.select("term", "df", F.floor(F.lit(float(WEIGHT)) * F.log((2.0 * n_docs + 2.0) / (2.0 * F.col("df") + 1.0))).cast("long").alias("w")), "weights"))
    norm = f"(100 - {HALF} + ({HALF} * n * {n_docs}L) div {max(n_terms, 1)}L)"

    def exploded(rows: DataFrame, *keys: str) -> DataFrame:
        """The keys, term, df and impact of each term of the rows' documents, impacts of 0 left out."""
        each = rows.select(*keys, "n", F.explode("terms").alias("t")).select(*keys, "n", "t.term", "t.tf").join(weights, "term")
        return each.select(*keys, "term", "df", F.expr(f"w * ({SCALE} * tf div (1000 * tf + 20 * {norm}))").alias("impact")).where("impact > 0")

    def looked_up(candidates: DataFrame, most: int | None = None) -> DataFrame:
        """item, row, doc_id, score of candidates (item, row), of which there are `most` at most, where that is known."""
        few = (most if most is not None else candidates.limit(BROADCAST + 1).count()) <= BROADCAST
        rows = vectors.join(F.broadcast(candidates) if few else candidates, "row")
        own = exploded(rows, "item", "row", "doc_id").join(asked, ["item", "term"])
        return own.groupBy("item", "row").agg(F.first("doc_id").alias("doc_id"), F.sum("impact").alias("score"))

    def best(rows: DataFrame, most: int, *order) -> DataFrame:
        return rows.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*order))).where(F.col("rank") <= most)

    # the lists: long ones in slices, each sorted by falling impact and numbered
    part = F.pmod(F.xxhash64("row"), F.ceil(F.col("df") / SLICE)).cast("int")
    place = F.row_number().over(Window.partitionBy("term", "slice").orderBy(F.desc("impact"), "row"))
    lists = exploded(vectors, "row").withColumn("slice", part).select("term", "slice", "row", "impact").repartition("term", "slice").withColumn("place", place)
    lists = cut(lists, "postings")
    # phase 1: a bound of the k-th best score, 0 where fewer documents were met
    heads = lists.where(F.col("place") <= depth).join(asked, "term").groupBy("item", "row").agg(F.sum("impact").alias("seen"))
    probes = cut(best(heads, 4 * k, F.desc("seen"), "row").select("item", "row"), "probes")
    kth = best(looked_up(probes, len(items) * 4 * k), k, F.desc("score"), "row").where(F.col("rank") == k).select("item", "score")
    bounds = dict(map(tuple, kth.collect()))  # a number for each item
    # phase 2: each list down to the least threshold of the items that hold its term; what a document adds up to is seen where its postings meet
    plan = _Plan(items, known, [bounds.get(i, 0) for i in range(len(items))])
    least = F.broadcast(spark.createDataFrame([(t, int(x)) for t, x in enumerate(plan.floors)], "term int, least long"))
    met = lists.join(least, "term").where(F.col("impact") >= F.col("least")).select("row", "term", "impact").repartition("row").sortWithinPartitions("row")
    candidates = cut(met.mapInArrow(partial(_possible, plan=plan), "item int, row long"), "candidates")
    discard(lists)
    # phase 3
    ranked = best(looked_up(candidates), k, F.desc("score"), F.asc_nulls_last("doc_id"), "row")
    return ranked.join(names, "item").select("item_id", "rank", "doc_id", "score")
