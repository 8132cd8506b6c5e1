"""Clusters of candidate pairs for a cold start, and embedding candidates."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; where none is set, a temporary one on a single machine, and an error on a cluster."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="samewise-"))
        base = spark.sparkContext.getCheckpointDir()
    return base.rstrip("/")


def written(df: DataFrame) -> DataFrame:
    """df as a Parquet table in the shared folder, so that a lost executor costs no recomputation.

    The table goes when the application ends, or earlier by discard()."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/samewise-{uuid.uuid4().hex}"
    df.write.parquet(path)
    files, at = _place(spark, path)
    files.deleteOnExit(at)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_at = path
    return out


def _place(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def discard(df: DataFrame) -> None:
    """Removes a table of written() that nothing reads any more; other frames are left alone."""
    if path := getattr(df, "written_at", None):
        files, at = _place(df.sparkSession, path)
        files.delete(at, True)


def clusters(pairs: DataFrame, rounds: int = 60, write: Callable[[DataFrame, str], DataFrame] = lambda df, _: written(df)) -> DataFrame:
    """node, cluster (least node reached) of every end of pairs (a, b): least labels with pointer jumping.

    Each round is written, by written() or as `write` does, so that a lost executor costs one round. Null ends and loops are ignored."""
    links = pairs.where("a <> b").select("a", "b")
    both = write(links.union(links.select("b", "a")).distinct(), "edges")
    now = write(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("b"))
        .select("node", F.least("node", "b").alias("cluster")), "labels")
    before = now
    for _ in range(rounds):
        near = both.join(now.select(F.col("node").alias("b"), "cluster"),
            "b").groupBy(F.col("a").alias("node")).agg(F.min("cluster").alias("m"))
        step = now.join(near, "node").select("node", F.col("cluster").alias("old"), F.least("cluster", "m").alias("new"))
        beyond = now.select(F.col("node").alias("new"), F.col("cluster").alias("next"))
        after = write(step.join(beyond, "new", "left")
            .select("node", "old", F.least("new", F.coalesce("next", "new")).alias("cluster")), "labels")
        discard(before)
        before, now = after, after.select("node", "cluster")
        if after.where("old <> cluster").limit(1).count() == 0:
            return now
    raise RuntimeError(f"clusters haven't settled in {rounds} rounds")


def cold_start(scores: DataFrame, least: float = 0.40) -> DataFrame:
    """cluster, n_pairs, n_canonicals, confidence (mean score): groups of entities and canonicals whose pairs score `least` or more."""
    pairs = scores.where(F.col("score") >= least).select(F.concat(F.lit("e:"), "entity_id").alias("a"),
        F.concat(F.lit("c:"), "canonical_id").alias("b"), "canonical_id", "score")
    named = pairs.join(clusters(pairs), pairs["a"] == F.col("node"))
    return named.groupBy("cluster").agg(F.count("*").alias("n_pairs"), F.countDistinct("canonical_id").alias("n_canonicals"),
        F.avg("score").alias("confidence"))


#: Queries and vectors that a task compares at once, and bytes of queries that are broadcast together.
QUERIES, VECTORS, BYTES = 512, 2048, 64 << 20


def cosine_top(queries: DataFrame, vectors: DataFrame, k: int = 5, most_bytes: int = BYTES) -> DataFrame:
    """query_id, vec_id, cosine, position: the k nearest vectors of each query, itself left out; a flat scan.

    queries: query_id, embedding. They are broadcast in parts of about `most_bytes`, a scan of the vectors each, so that neither a task nor
    the driver holds more. Each task keeps the k best of its own vectors for each query, and only these leave it. Cosines are compared
    with twelve places, ties by vec_id. Zero vectors, nulls and those that hold nulls have no neighbour; vectors of other lengths are
    no neighbours."""
    spark = vectors.sparkSession
    asked = written(queries.where("embedding is not null").select("query_id", F.col("embedding").cast("array<double>").alias("q")))
    held = vectors.where("embedding is not null").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    schema = f"query_id {asked.schema['query_id'].dataType.simpleString()}, vec_id {held.schema['vec_id'].dataType.simpleString()}, cosine double"
    size = asked.agg(F.coalesce(F.sum(F.size("q") * 8 + 64), F.lit(0))).first()[0]
    parts = max(1, -(-size // most_bytes))
    scored = None
    for part in range(parts):
        rows = asked.where(F.pmod(F.xxhash64("query_id"), F.lit(parts)) == part).toArrow()
        block = spark.sparkContext.broadcast(_Block(rows))
        own = held.mapInArrow(lambda batches, block=block: _nearest(batches, block.value, k), schema)
        scored = own if scored is None else scored.unionByName(own)
    order = Window.partitionBy("query_id").orderBy(F.desc("cosine"), "vec_id")
    return scored.withColumn("position", F.row_number().over(order)).where(F.col("position") <= k)


def alike_top(queries: DataFrame, vectors: DataFrame, on: str, embed: Callable[[Column], Column], k: int = 5) -> DataFrame:
    """cosine_top() of queries (query_id) and vectors (vec_id) whose embedding depends on a column `on` alone, each distinct one scanned once.

    A kind of vectors is named by its least id, so that the k nearest ids are among the first k of the k nearest kinds; one more of each
    is taken, as a query may be among the vectors."""
    queries, vectors = written(queries.select("query_id", on)), written(vectors.select("vec_id", on))
    asked = written(queries.select(on).distinct().withColumn("kind", F.concat(F.lit("\0"), F.monotonically_increasing_id().cast("string"))))
    held = written(vectors.groupBy(on).agg(F.min("vec_id").alias("begin")))
    # small files, but much work for each of their rows
    spread = held.repartition(4 * vectors.sparkSession.sparkContext.defaultParallelism)
    known = written(spread.select(F.col("begin").alias("vec_id"), embed(F.col(on)).alias("embedding")))
    near = cosine_top(asked.select(F.col("kind").alias("query_id"), embed(F.col(on)).alias("embedding")), known, k + 1)
    near = near.select(F.col("query_id").alias("kind"), F.col("vec_id").alias("begin"), "cosine")
    first = lambda rows, by, *order: rows.withColumn("position", F.row_number().over(Window.partitionBy(by).orderBy(*order)))
    heads = first(vectors.join(held, on).select("begin", "vec_id"), "begin", "vec_id").where(F.col("position") <= k + 1).drop("position")
    best = first(near.join(heads, "begin"), "kind", F.desc("cosine"), "vec_id").where(F.col("position") <= k + 1).select("kind", "vec_id", "cosine")
    own = queries.join(asked, on).select("query_id", "kind").join(written(best), "kind").where("query_id <> vec_id")
    return first(own.select("query_id", "vec_id", "cosine"), "query_id", F.desc("cosine"), "vec_id").where(F.col("position") <= k)


def embedding_signals(nearest: DataFrame) -> DataFrame:
    """entity_id, canonical_id, signal (embed:<rank>), cosine of cosine_top()'s rows, to go with the signals of names."""
    return nearest.select(F.col("query_id").alias("entity_id"), F.col("vec_id").alias("canonical_id"),
        F.concat(F.lit("embed:"), F.col("position").cast("string")).alias("signal"), "cosine")


def _by_size(ids: pa.Array, vectors: pa.Array) -> Iterator[tuple[int, pa.Array, np.ndarray]]:
    """length, ids and unit vectors of what has a direction: no null and not all zero."""
    sizes = pc.fill_null(pc.list_value_length(vectors), 0).to_numpy(zero_copy_only=False)
    for size in np.unique(sizes[sizes > 0]).tolist():
        at = np.flatnonzero(sizes == size)
        some = vectors.take(pa.array(at))
        flat = some.flatten()
        x = pc.fill_null(flat, float("nan")).to_numpy(zero_copy_only=False).astype(float).reshape(-1, size)
        length = np.sqrt((x * x).sum(1))
        good = length > 0  # false for NaN
        if good.any():
            yield size, ids.take(pa.array(at[good])), x[good] / length[good, None]


class _Block:
    """Queries by length of their vectors: ids and unit vectors."""

    def __init__(self, rows: pa.Table):
        rows = rows.combine_chunks()
        ids, vectors = (c.chunk(0) if c.num_chunks else pa.array([], c.type) for c in rows.columns)
        self.kind = ids.type
        self.by_size = {size: (own, x) for size, own, x in _by_size(ids, vectors)}


class _Best:
    """The k best vectors of each query so far, by cosine, then id; what is held depends on the queries and k, not on the vectors met."""

    def __init__(self, names: pa.Array, queries: np.ndarray, k: int):
        self.queries, self.k = queries, k
        self.cosine, self.ids = np.full((len(queries), k), -np.inf), np.full((len(queries), k), None, object)
        self.places: dict = {}
        for place, name in enumerate(names.to_pylist()):
            self.places.setdefault(name, []).append(place)

    def meet(self, ids: np.ndarray, x: np.ndarray) -> None:
        order = np.argsort(pd.factorize(ids, sort=True)[0], kind="stable")
        ids, x = ids[order], x[order]
        own = np.array([(q, v) for v, name in enumerate(ids.tolist()) for q in self.places.get(name, ())], np.int64).reshape(-1, 2)
        for at in range(0, len(self.queries), QUERIES):
            cosine = np.round(self.queries[at : at + QUERIES] @ x.T, 12)
            here = own[(own[:, 0] >= at) & (own[:, 0] < at + QUERIES)]
            cosine[here[:, 0] - at, here[:, 1]] = -np.inf  # a query is left out of its own neighbours
            kth = min(self.k, cosine.shape[1])
            least = np.maximum(np.partition(cosine, -kth, 1)[:, -kth], self.cosine[at : at + QUERIES, -1])
            near = (cosine >= least[:, None]) & (cosine > -np.inf)
            # of many that tie for the last place the first by id stand
            for q in np.flatnonzero(near.sum(1) > kth):
                above = cosine[q] > least[q]
                near[q] = above
                near[q, np.flatnonzero(cosine[q] == least[q])[: max(0, kth - above.sum())]] = True
            q, v = np.nonzero(near)
            if len(q):
                self._add(at, q, cosine[q, v], ids[v])

    def _add(self, at: int, q: np.ndarray, cosine: np.ndarray, ids: np.ndarray) -> None:
        rows = np.unique(q)
        held = self.cosine[at + rows] > -np.inf
        q = np.concatenate([np.repeat(rows, held.sum(1)), q])
        cosine, ids = np.concatenate([self.cosine[at + rows][held], cosine]), np.concatenate([self.ids[at + rows][held], ids])
        order = np.lexsort((pd.factorize(ids, sort=True)[0], -cosine, q))
        q, cosine, ids = q[order], cosine[order], ids[order]
        place = np.arange(len(q)) - np.searchsorted(q, q)
        best = place < self.k
        self.cosine[at + q[best], place[best]], self.ids[at + q[best], place[best]] = cosine[best], ids[best]


def _nearest(batches: Iterator[pa.RecordBatch], block: _Block, k: int) -> Iterator[pa.RecordBatch]:
    """The k best of all the batches' vectors for each query."""
    best = {size: _Best(names, queries, k) for size, (names, queries) in block.by_size.items()}
    kind = None
    for rows in batches:
        kind = rows.column(0).type
        for at in range(0, rows.num_rows, VECTORS):
            some = rows.slice(at, VECTORS)
            for size, ids, x in _by_size(some.column(0), some.column(1)):
                if size in best:
                    best[size].meet(np.array(ids.to_pylist(), object), x)
    for size, held in best.items():
        names = block.by_size[size][0]
        for at in range(0, len(names), QUERIES * 8):
            q, place = np.nonzero(held.cosine[at : at + QUERIES * 8] > -np.inf)
            if len(q):
                yield pa.RecordBatch.from_arrays(
                    [names.take(pa.array(at + q)), pa.array(held.ids[at + q, place].tolist(), kind), pa.array(held.cosine[at + q, place], pa.float64())],
                    names=["query_id", "vec_id", "cosine"]
                )
