"""Event-time windows and duplicate removal; the same functions take batch and streaming DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def late(events: DataFrame, delay: str = "1 hour") -> DataFrame:
    """A watermark, where the table is a stream."""
    return events.withWatermark("ts", delay) if events.isStreaming else events


def windowed(events: DataFrame, length: str, slide: str | None = None, delay: str = "1 hour") -> DataFrame:
    w = F.window("ts", length, slide) if slide else F.window("ts", length)
    g = late(events, delay).groupBy(w.alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return g.select(F.col("w.start").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str, delay: str = "1 hour") -> DataFrame:
    g = late(events, delay).groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return g.select("user_id", F.col("w.start").alias("start"), "n", "total")


def first_events(events: DataFrame, delay: str = "1 hour") -> DataFrame:
    """One row of each event_id."""
    if events.isStreaming:
        return events.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["event_id"])
    return events.dropDuplicates(["event_id"])
