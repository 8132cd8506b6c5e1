"""Append-only tables of files to which a batch is added once: written aside, then put in place by one rename under the batch's key.

A run that is stopped before the rename leaves nothing that readers see; one that is run again after it finds its key and adds nothing. Two
runs of one key at a time are told apart by the rename, which fails where the key is there (on HDFS and file systems; a store without
such a rename needs a table format)."""

from __future__ import annotations

import uuid
from urllib.parse import quote

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

STAGING = "_staging"  # readers pass over names that begin so


def _hadoop(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def has_batch(spark: SparkSession, folder: str, key: str) -> bool:
    at, files = _hadoop(spark, f"{folder}/batch={quote(key, safe='')}")
    return files.exists(at)


def append_once(rows: DataFrame, folder: str, key: str) -> bool:
    """Adds rows as the batch `key` of the folder, all or none; False, and nothing added, if that batch is there."""
    spark = rows.sparkSession
    if has_batch(spark, folder, key):
        return False
    aside = f"{folder}/{STAGING}/{uuid.uuid4().hex}"
    rows.write.parquet(aside)
    return _commit(spark, aside, f"{folder}/batch={quote(key, safe='')}")


def _commit(spark: SparkSession, aside: str, to: str) -> bool:
    jvm, gateway = spark.sparkContext._jvm, spark.sparkContext._gateway
    at, files = _hadoop(spark, to)
    source, _ = _hadoop(spark, aside)
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(files.getUri(), spark.sparkContext._jsc.hadoopConfiguration())
    none = gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
    try:
        context.rename(source, at, none)
    except Py4JJavaError:
        if not files.exists(at):
            raise
        files.delete(source, True)
        return False
    return True


def committed(spark: SparkSession, folder: str, schema: T.StructType | str) -> DataFrame:
    """The rows of all batches, with the batch's key as `batch`; none where there is no batch yet."""
    known = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    whole = T.StructType([*known.fields, T.StructField("batch", T.StringType())])
    at, files = _hadoop(spark, folder)
    if not files.exists(at) or not any(s.getPath().getName().startswith("batch=") for s in files.listStatus(at)):
        return spark.createDataFrame([], whole)
    return spark.read.schema(whole).parquet(folder)


def latest(changes: DataFrame, keys: list[str], order: list[str], removed: str = "false") -> DataFrame:
    """The last row of each key in the order of columns `order` (nulls first), but of keys whose last row is `removed`.

    A maximum, so that rows of a hot key are combined before they move; rows equal in keys and order count as one (any of them)."""
    rest = [c for c in changes.columns if c not in keys]
    last = changes.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("last"))
    return last.select(*keys, "last.*").where(f"not coalesce({removed}, false)")
