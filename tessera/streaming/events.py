"""Streaming extensions over timestamped events; each transformation also runs on a batch DataFrame."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def event_stream(spark: SparkSession, folder: str, schema, files_per_trigger: int = 16) -> DataFrame:
    """A stream over the Parquet files of a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def windowed(events: DataFrame, at: str, size: str, slide: str | None, keys: list[str], value: str, late: str = "10 minutes") -> DataFrame:
    """Counts and sums per tumbling (slide None) or sliding window; rows later than `late` are dropped by the watermark of a stream."""
    e = events.withWatermark(at, late) if events.isStreaming else events
    w = F.window(at, size, slide) if slide else F.window(at, size)
    out = e.groupBy(w, *keys).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total"))
    return out.select(F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), *keys, "n", "total")


def sessions(events: DataFrame, at: str, gap: str, keys: list[str], late: str = "10 minutes") -> DataFrame:
    """Sessions per key that end after a gap without events."""
    e = events.withWatermark(at, late) if events.isStreaming else events
    out = e.groupBy(F.session_window(at, gap), *keys).agg(F.count(F.lit(1)).alias("n"))
    return out.select(F.col("session_window.start").alias("session_start"), F.col("session_window.end").alias("session_end"), *keys, "n")


def once_per_id(events: DataFrame, at: str, ids: list[str], late: str = "10 minutes") -> DataFrame:
    """Drops repeated deliveries; a stream keeps ids for as long as the watermark allows."""
    return events.withWatermark(at, late).dropDuplicatesWithinWatermark(ids) if events.isStreaming else events.dropDuplicates(ids)


def run_to_end(stream: DataFrame, each: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append") -> None:
    """Reads what is there and stops; `each` gets every micro-batch with its number, and may see a batch again after a failure."""
    q = stream.writeStream.outputMode(mode).foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
