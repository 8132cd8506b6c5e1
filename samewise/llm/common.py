"""Shared helpers: tables, written cuts in the cluster's shared folder, and column guards."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from samewise.operators.graph import discard  # noqa: F401  goes with cut()


def tidy(run: Callable, *caches) -> Callable:
    """run, and then the worker's memory given back: workers outlive a stage, and the next one's share the executor's memory."""

    def wrapped(batches):
        try:
            yield from run(batches)
        finally:
            release(*caches)

    return wrapped


def release(*caches) -> None:
    import pyarrow as pa

    for c in caches:
        c.clear()
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        pass  # another C library


def bounded_batches(spark: SparkSession, rows: int = 1_000) -> None:
    """Arrow batches of `rows` rows at most, as texts are long: a worker holds a batch of whole texts at a time."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(name, "10000")) > rows:
        spark.conf.set(name, str(rows))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bounded_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; where that is unset, a temporary one on a single machine, and an error on a cluster."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        at = tempfile.mkdtemp(prefix="samewise-")
        spark.sparkContext.setCheckpointDir(at)
        at = spark.sparkContext.getCheckpointDir()
    return at


def cut(df: DataFrame, label: str) -> DataFrame:
    """df as a written Parquet table in the shared folder: lineage ends there, so a lost executor costs no recomputation.

    The table goes when the application ends, or earlier by discard()."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/samewise-{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(at)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_at = path
    return out


def put_shared(spark: SparkSession, name: str, content: bytes) -> str:
    """Writes a file of some megabytes into the shared folder; returns its path. It goes when the application ends."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark).rstrip('/')}/{uuid.uuid4().hex}/{name}")
    files = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    out = files.create(at)
    try:
        for i in range(0, len(content), 1 << 20):
            out.write(bytearray(content[i : i + (1 << 20)]))
    finally:
        out.close()
    files.deleteOnExit(at.getParent())
    return files.makeQualified(at).toString()


def free_name(df: DataFrame, name: str) -> str:
    """The name, or with a number, that isn't a column of df, whatever its case."""
    taken = {c.lower() for c in df.columns}
    return next(n for n in [name, *(f"{name}_{i}" for i in range(len(taken) + 1))] if n not in taken)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def crc_mod(column: str, n: int):
    """crc32 of the id as text, modulo n; null ids count as the text ''."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % n
