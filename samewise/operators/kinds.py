"""Which names share a signal, worked out once for all keys of the same names, and what can be said of the keys from that.

Keys that have the same names share the same signals. So kinds (sets of names) meet instead of keys: their number grows with the
different names, not with the rows. Pairs of keys come only at the end, in the tasks that write them: they are never shuffled,
sorted or made distinct. Tables of kinds and keys that fit are broadcast, by their bytes; others are joined by shuffles."""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from samewise.operators.graph import written

#: Bytes of a table that is broadcast.
BYTES = 64 << 20


def small(df: DataFrame, most_bytes: int = BYTES) -> DataFrame:
    """df, marked for a broadcast if its rows as JSON take no more than `most_bytes`; it is counted, so it should be a written one."""
    size = df.agg(F.coalesce(F.sum(F.length(F.to_json(F.struct(*df.columns))) + 32), F.lit(0))).first()[0]
    return F.broadcast(df) if size <= most_bytes else df


def beside(df: DataFrame, most_bytes: int = BYTES) -> DataFrame:
    """small(), but what doesn't fit is marked to be merged: a file's size says little of repeated values, so Spark would broadcast them."""
    out = small(df, most_bytes)
    return df.hint("merge") if out is df else out


def parts(df: DataFrame) -> int:
    """Partitions for rows that will grow where they are; a number asked for isn't cut down as that of a small shuffle is."""
    spark = df.sparkSession
    return max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))


#: Keys of a list at most.
LISTED = 1024


def listed(rows: DataFrame, kind: str, key: str) -> DataFrame:
    """kind, of: lists of at most LISTED of a kind's keys; a kind of many keys has several."""
    nth = F.row_number().over(Window.partitionBy(kind).orderBy(key))
    return rows.withColumn("at", F.floor((nth - 1) / LISTED)).groupBy(kind, "at").agg(F.collect_list(key).alias("of")).drop("at")


class Met:
    """Keys of two sides (left, right: a key and a name, any number of names each) that share a signal of `marks`, an array of a name.

    left, right: key, kind; asked, held: kind, signal. All are written once, and so are the pairs of kinds when they are asked for."""

    def __init__(self, left: DataFrame, right: DataFrame, marks: Callable[[Column], Column]):
        (self.left_key, a), (self.right_key, b) = left.columns, right.columns
        self.left, self.asked = self._kinds(left, self.left_key, a, "left_kind", marks)
        self.right, self.held = self._kinds(right, self.right_key, b, "right_kind", marks)
        self.n = parts(self.held)

    @cached_property
    def pairs(self) -> DataFrame:
        """left_kind, right_kind, n: the kinds that meet and how many signals they share."""
        # a kind's signals lie together, so that they are counted where they meet
        both = self.held.repartition(self.n, "right_kind").join(small(self.asked), "signal")
        return written(both.groupBy("right_kind", "left_kind").agg(F.count("*").alias("n")))

    @staticmethod
    def _kinds(rows: DataFrame, key: str, name: str, kind: str, marks: Callable[[Column], Column]) -> tuple[DataFrame, DataFrame]:
        """(key, kind), (kind, signal), written; keys without a name have no kind."""
        named = written(rows.where(F.trim(name) != "").groupBy(key).agg(F.array_sort(F.collect_set(name)).alias("names")))
        kinds = written(named.select("names").distinct().withColumn(kind, F.monotonically_increasing_id()))
        signals = kinds.select(kind, F.explode(F.array_distinct(F.flatten(F.transform("names", marks)))).alias("signal"))
        return written(named.join(beside(kinds), "names").select(key, kind)), written(signals)

    def keys(self, columns: tuple = (), right: tuple = (), only: DataFrame | None = None) -> DataFrame:
        """left key, right key, n and more columns of the left or right key, each pair once; `only`: left keys to keep."""
        left = self.left if only is None else self.left.join(only, self.left_key, "left_semi")
        return self._keys(self.pairs.repartition(self.n, "right_kind"), written(left.select(self.left_key, "left_kind", *columns)), *right)

    def signals(self) -> DataFrame:
        """left key, right key, signal: each that they share."""
        return self._keys(self.held.repartition(self.n, "right_kind").join(small(self.asked), "signal"), self.left)

    def _keys(self, pairs: DataFrame, left: DataFrame, *right: Column) -> DataFrame:
        own = self.right.select(self.right_key, "right_kind", *right)
        rows = pairs.join(own.repartition(self.n, "right_kind").hint("shuffle_hash"), "right_kind").drop("right_kind")
        if set(left.columns) != {self.left_key, "left_kind"}:
            return rows.join(small(left), "left_kind").drop("left_kind")
        # a kind's left keys come as lists: a right key looks them up once, and they are written out one after another
        rows = rows.join(small(written(listed(left, "left_kind", self.left_key))), "left_kind")
        return rows.select(*(c for c in rows.columns if c not in ("left_kind", "of")), F.explode("of").alias(self.left_key))

    def counts(self) -> DataFrame:
        """left key, n_met: how many right keys it meets; none for those that meet none."""
        sizes = self.right.groupBy("right_kind").agg(F.count("*").alias("size"))
        met = self.pairs.join(sizes, "right_kind").groupBy("left_kind").agg(F.sum("size").alias("n_met"))
        return self.left.join(met, "left_kind").select(self.left_key, "n_met")

    def ranked(self, left_mark: Column, right_mark: Column, score: Callable[[Column, Column], Column], n_marks: int) -> DataFrame:
        """left key, right key, score, position (by score, then right key), where the score depends on marks of both keys alone.

        Marks of right keys are 0 to n_marks - 1, and of one left key no two of them score the same. A position is then how many
        right keys of better marks there are, counted for each left kind and mark, and the place among those of the own mark, which
        only the left kind decides."""
        left = written(self.left.select(self.left_key, "left_kind", left_mark.alias("left_mark")))
        own = written(self.right.select(self.right_key, "right_kind", right_mark.cast("int").alias("right_mark")))
        near = written(self.pairs.groupBy("right_kind").agg(F.collect_list("left_kind").alias("left_kinds")))
        # keys of one mark lie together, so that places are counted without a shuffle of pairs
        rows = own.repartitionByRange(max(self.n, n_marks), "right_mark").join(small(near, 2 * BYTES), "right_kind").select(self.right_key, "right_mark",
            F.explode("left_kinds").alias("left_kind"))
        rows = rows.withColumn("place", F.row_number().over(Window.partitionBy("left_kind", "right_mark").orderBy(self.right_key)))
        sizes = own.groupBy("right_kind", "right_mark").agg(F.count("*").alias("size"))
        sizes = written(self.pairs.join(sizes, "right_kind").groupBy("left_kind", "right_mark").agg(F.sum("size").alias("size")))
        marked = left.select("left_kind", "left_mark").distinct().join(sizes, "left_kind").withColumn("score", score(F.col("left_mark"), F.col("right_mark")))
        better = Window.partitionBy("left_kind", "left_mark").orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, -1)
        marked = marked.withColumn("better", F.coalesce(F.sum("size").over(better), F.lit(0)))
        by_mark = F.map_from_entries(F.collect_list(F.struct("right_mark", "better")))
        held = marked.groupBy("left_kind", "left_mark").agg(by_mark.alias("m")).select("left_kind", "left_mark",
            F.transform(F.sequence(F.lit(0), F.lit(n_marks - 1)), lambda i: F.col("m")[i]).alias("better"))
        left = written(left.join(held, ["left_kind", "left_mark"]))
        return rows.join(small(left, 4 * BYTES), "left_kind").select(self.left_key, self.right_key, score(F.col("left_mark"), F.col("right_mark")).alias("score"),
            (F.col("better")[F.col("right_mark")] + F.col("place")).alias("position"))

    def first(self, right_mark: Column, most: int) -> DataFrame:
        """left key, right key: of the right keys of each mark that a left key meets, the first `most` by key.

        Where a score depends on marks, the best `most` are among them. Only the first of each kind meet, as the first of a union
        are among the first of its parts."""
        met = self._first(right_mark, most).select("left_kind", F.explode(f"keys.{self.right_key}").alias(self.right_key))
        return self.left.join(met, "left_kind").select(self.left_key, self.right_key)

    def top(self, left_mark: Column, right_mark: Column, score: Callable[[Column, Column], Column], most: int) -> DataFrame:
        """left key, right key, score: the `most` best by score, then right key, where the score depends on marks of both keys alone.

        Left keys of one kind and mark have the same best, which are looked for once: no row comes for each mark that a left key meets."""
        left = written(self.left.select(self.left_key, "left_kind", left_mark.alias("left_mark")))
        asked = left.select("left_kind", "left_mark").distinct().repartition(self.n, "left_kind").hint("shuffle_hash")
        met = self._first(right_mark, most).select("left_kind", "right_mark", F.explode(f"keys.{self.right_key}").alias(self.right_key))
        # a left kind's rows lie together, so that they are sorted where they meet
        nth = F.row_number().over(Window.partitionBy("left_kind", "left_mark").orderBy(F.desc("score"), self.right_key))
        best = met.join(asked, "left_kind").withColumn("score", score(F.col("left_mark"), F.col("right_mark"))).withColumn("nth", nth).where(F.col("nth") <= most)
        best = written(best.select(F.col("left_kind").alias("kind"), F.col("left_mark").alias("mark"), self.right_key, "score"))
        rows = left.join(beside(best), (F.col("left_kind") == F.col("kind")) & F.col("left_mark").eqNullSafe(F.col("mark")))
        return rows.select(self.left_key, self.right_key, "score")

    def _first(self, right_mark: Column, most: int) -> DataFrame:
        """left_kind, right_mark, keys (structs of the right key): the first `most` of a mark that a left kind meets; a left kind's rows lie together."""
        nth = F.row_number().over(Window.partitionBy("signal", "right_mark").orderBy(self.right_key))
        own = self.right.join(beside(self.held), "right_kind").select("signal", self.right_key, right_mark.alias("right_mark"))
        own = written(own.withColumn("nth", nth).where(F.col("nth") <= most).drop("nth"))
        met = self.asked.repartition(self.n, "left_kind").join(beside(own), "signal")
        return met.groupBy("left_kind", "right_mark").agg(F.slice(F.sort_array(F.collect_set(F.struct(self.right_key))), 1, most).alias("keys"))

    def lists(self, most: int) -> DataFrame:
        """left_kind, ids (the first `most` right keys that a left kind meets, ascending), signals (those shared with each).

        The first n keys of a union of kinds are keys of the n kinds whose own first keys come first, and the first n kinds of a union of
        signals are among the first n of each. So only the first kinds of each signal meet, and only the first keys of a kind are looked at."""
        first = lambda rows, by, c: rows.withColumn("nth", F.row_number().over(Window.partitionBy(by).orderBy(c))).where(F.col("nth") <= most)
        heads = written(first(self.right.distinct(), "right_kind", self.right_key))
        begin = written(heads.where("nth = 1").select("right_kind", F.col(self.right_key).alias("begin")))
        held = written(first(self.held.join(beside(begin), "right_kind"), "signal", "begin").drop("nth"))
        met = written(first(beside(self.asked).join(held, "signal").select("left_kind", "right_kind", "begin").distinct(), "left_kind", "begin"))
        keys = written(first(beside(met.select("left_kind", "right_kind")).join(heads.drop("nth"), "right_kind"), "left_kind", self.right_key).drop("nth"))
        of = lambda rows, kind, name: rows.groupBy(kind).agg(F.collect_set("signal").alias(name))
        theirs = of(self.held.join(keys.select("right_kind").distinct(), "right_kind", "left_semi"), "right_kind", "held")
        met = keys.select("left_kind", "right_kind").distinct().join(of(self.asked, "left_kind", "asked"), "left_kind").join(theirs, "right_kind")
        met = met.select("left_kind", "right_kind", F.array_sort(F.array_intersect("asked", "held")).alias("signals"))
        rows = keys.join(met, ["left_kind", "right_kind"]).groupBy("left_kind").agg(
            F.array_sort(F.collect_list(F.struct(self.right_key, "signals"))).alias("of"))
        return rows.select("left_kind", F.col(f"of.{self.right_key}").alias("ids"), F.col("of.signals").alias("signals"))
