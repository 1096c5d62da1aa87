"""Streams.  The library's batch operators need none; these are extensions over ``events``-shaped sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EVENTS = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


def read_events(spark: SparkSession, folder: str) -> DataFrame:
    """New Parquet files of a folder, a bounded number of them in each trigger."""
    return spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", 16).parquet(folder)


def windowed(events: DataFrame, window: str = "1 hour", late: str | None = "10 minutes") -> DataFrame:
    """window_start, event_type, n, total in tumbling windows; state is dropped ``late`` behind the newest event.

    ``late`` is None where the stream has a watermark already.
    """
    seen = events.withWatermark("ts", late) if events.isStreaming and late else events
    each = seen.groupBy(F.window("ts", window).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return each.select(F.col("w.start").alias("window_start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str | None = "10 minutes") -> DataFrame:
    """user_id, start, end, n: a user's events without a pause of ``gap``."""
    seen = events.withWatermark("ts", late) if events.isStreaming and late else events
    each = seen.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n"))
    return each.select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def once(events: DataFrame, key: str = "event_id", late: str = "10 minutes") -> DataFrame:
    """Each event once, however often it is sent within the watermark."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark([key]) if events.isStreaming else events.dropDuplicates([key])
