"""Run states as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def activity_stream(events: DataFrame, late: str = "10 minutes", window: str = "1 hour") -> DataFrame:
    """begin, event_type, n_events of a streaming (or plain) table of events by event-time windows; rows later than `late` are left out."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return timed.groupBy(F.window("ts", window), "event_type").agg(F.count(F.lit(1)).alias("n_events")).select(F.col("window.start").alias("begin"), "event_type", "n_events")
