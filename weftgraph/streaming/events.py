"""Windowed aggregates of an event stream, the same plan in batch and streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def activity(events: DataFrame, width: str = "1 day", late: str | None = None) -> DataFrame:
    """``day, event_type, n, total``: events in windows of ``width``; with ``late`` a watermark lets a
    streaming query drop the state of windows that are that far past."""
    events = events.withColumn("ts", F.col("ts").cast("timestamp"))
    if late:
        events = events.withWatermark("ts", late)
    found = events.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return found.select(F.col("w.start").alias("day"), "event_type", "n", "total")
