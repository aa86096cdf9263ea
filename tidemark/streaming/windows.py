"""Event-time windows (G1-G3): the same functions serve streams and batches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def event_time(events: DataFrame, ts: str = "ts") -> DataFrame:
    """Watermarks need a timestamp with a zone."""
    return events.withColumn(ts, F.col(ts).cast("timestamp"))


def _marked(events: DataFrame, ts: str, delay: str) -> DataFrame:
    rows = event_time(events, ts)
    return rows.withWatermark(ts, delay) if rows.isStreaming else rows


def window_counts(events: DataFrame, size: str = "1 hour", slide: str | None = None, delay: str = "10 minutes", ts: str = "ts") -> DataFrame:
    """Counts and sums by event type in tumbling (or, with slide, sliding) windows."""
    w = F.window(ts, size, slide) if slide else F.window(ts, size)
    rows = _marked(events, ts, delay).groupBy(w.alias("w"), "event").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return rows.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "event", "n", "total")


def sessionized(events: DataFrame, gap: str = "30 minutes", delay: str = "10 minutes", ts: str = "ts") -> DataFrame:
    """Runs of a user's events with no gap as long as that."""
    rows = _marked(events, ts, delay).groupBy(F.session_window(ts, gap).alias("w"), "user_id").agg(F.count("*").alias("n"))
    return rows.select("user_id", F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "n")


def deduplicated(events: DataFrame, keys: list[str], delay: str = "10 minutes", ts: str = "ts") -> DataFrame:
    """One event for each key; a stream forgets keys once the watermark has passed them."""
    rows = _marked(events, ts, delay)
    return rows.dropDuplicatesWithinWatermark(keys) if rows.isStreaming else rows.dropDuplicates(keys)
