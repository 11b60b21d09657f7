"""Windowed summaries of event streams; the same functions work on batch tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _timed(events: DataFrame, late: str) -> DataFrame:
    x = events.withColumn("ts", F.col("ts").cast("timestamp"))
    return x.withWatermark("ts", late) if x.isStreaming else x


def window_counts(events: DataFrame, width: str = "1 hour", late: str = "2 hours", slide: str | None = None) -> DataFrame:
    """start, end, event_type, n, total: events and values by event-time window. On a stream, rows later than ``late``
    behind the latest are dropped by the watermark, which also bounds the state."""
    x = _timed(events, late)
    w = F.window("ts", width, slide) if slide else F.window("ts", width)
    y = x.groupBy(w.alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return y.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    """user_id, start, end, n: runs of a user's events with no pause of ``gap`` or more."""
    x = _timed(events, late)
    y = x.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n"))
    return y.select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")
