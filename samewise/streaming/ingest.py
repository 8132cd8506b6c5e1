"""Normalization of arriving records, and windowed counts with late data: an extension, the batch functions over streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from samewise.functions.names import normalize
from samewise.sources.commits import append_once


def arriving(spark: SparkSession, path: str, schema) -> DataFrame:
    return spark.readStream.schema(schema).parquet(path)


def normalized(stream: DataFrame) -> DataFrame:
    """Normalization holds no state, so it runs on a stream as it is."""
    return normalize(stream)


def counts(events: DataFrame, late: str = "1 hour", width: str = "1 day") -> DataFrame:
    """Events and their value by window and kind, for events at most `late` behind."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("value")).select(
        F.col("w.start").alias("start"), "event_type", "n", "value"
    )


def append(stream: DataFrame, path: str, checkpoint: str):
    """Appends a stream to a Parquet table, each row once."""
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def once(stream: DataFrame, at: str, ids: list[str], late: str) -> DataFrame:
    """A stream without repeats of `ids` within `late` of event time; rows further behind than that are left out."""
    return stream.withWatermark(at, late).dropDuplicatesWithinWatermark(ids)


def sync(stream: DataFrame, folder: str, checkpoint: str, name: str):
    """Adds what has arrived to an append-only table of batches (sources.commits), a batch each; a batch that is replayed adds nothing.

    `name` is the stream's own in that folder: it must stay the same for a checkpoint, and differ from that of other streams."""

    def put(rows: DataFrame, batch: int) -> None:
        append_once(rows, folder, f"{name}-{batch:012d}")

    return stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def marks(changes: DataFrame, connector: str, at: str, ids: str) -> DataFrame:
    """connector, high_water (the latest time), n (different ids): where each connector's next pull begins."""
    return changes.groupBy(F.col(connector).alias("connector")).agg(F.max(at).alias("high_water"), F.countDistinct(ids).alias("n"))
