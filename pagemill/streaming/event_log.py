"""The event log as a stream: appended in batches of files, read as they come, nothing dropped."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.events import EVENT


def append(events: DataFrame, path: str) -> None:
    """Adds events to the log."""
    events.write.mode("append").parquet(path)


def snapshot(spark: SparkSession, path: str) -> DataFrame:
    """All events so far."""
    return spark.read.schema(EVENT).parquet(path)


def stream(spark: SparkSession, path: str, files_per_batch: int = 1000) -> DataFrame:
    """The events as a stream."""
    return spark.readStream.schema(EVENT).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def subscribe(spark: SparkSession, path: str, handle: Callable[[DataFrame, int], None], checkpoint: str, available_now: bool = False) -> StreamingQuery:
    """Calls ``handle`` with every batch of new events, each event once; ``available_now`` ends when all there are were handled."""
    writer = stream(spark, path).writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def counts_by_window(events: DataFrame, width: str = "1 minute", late: str = "10 minutes") -> DataFrame:
    """(start, kind, n) of a stream or a table of events; in a stream, events later than ``late`` are left out."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), "kind").agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), "kind", "n")
