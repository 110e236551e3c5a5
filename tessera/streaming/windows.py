"""An extension without counterpart: windows over event streams, the same for batch frames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def tumbling(events: DataFrame, width: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Count and sum by window and type; ``late`` events are dropped in a stream."""
    if events.isStreaming:
        events = events.withWatermark("ts", late)
    return events.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(
        F.col("w.start").alias("start"), "event_type", "n", "total"
    )


def sliding(events: DataFrame, width: str = "2 days", step: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Count and sum by overlapping windows and type."""
    if events.isStreaming:
        events = events.withWatermark("ts", late)
    return events.groupBy(F.window("ts", width, step).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(
        F.col("w.start").alias("start"), "event_type", "n", "total"
    )


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Runs of one user's events with less than ``gap`` between neighbours."""
    if events.isStreaming:
        events = events.withWatermark("ts", late)
    return events.groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(
        "user_id", F.col("w.start").alias("start"), "n", "total"
    )
