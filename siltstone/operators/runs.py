"""Run logs: current states, activity, queue depth."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def latest_status(events: DataFrame) -> DataFrame:
    """user_id, status, n_events: the last event's type of each user (of equal times that of larger id)."""
    return events.groupBy("user_id").agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("status"), F.count(F.lit(1)).alias("n_events"))


def activity(events: DataFrame) -> DataFrame:
    """day, event_type, n_events, n_users."""
    return events.groupBy(F.to_date("ts").alias("day"), "event_type").agg(F.count(F.lit(1)).alias("n_events"), F.countDistinct("user_id").alias("n_users"))


def queue_depth(events: DataFrame) -> DataFrame:
    """event_id, depth: a user's views less their clicks so far, in order of time and id.

    Sums run over a user's days first, then within a day, so that a user with many events is spread over tasks.
    """
    step = F.when(F.col("event_type") == "view", 1).when(F.col("event_type") == "click", -1).otherwise(0)
    stepped = events.select("event_id", "user_id", "ts", F.to_date("ts").alias("day"), step.cast("long").alias("step"))
    daily = stepped.groupBy("user_id", "day").agg(F.sum("step").alias("total"))
    before = Window.partitionBy("user_id").orderBy("day").rowsBetween(Window.unboundedPreceding, -1)
    daily = daily.select(F.col("user_id").alias("u"), F.col("day").alias("d"), F.coalesce(F.sum("total").over(before), F.lit(0)).alias("earlier"))
    joined = stepped.join(daily, stepped["user_id"].eqNullSafe(F.col("u")) & stepped["day"].eqNullSafe(F.col("d")))
    order = Window.partitionBy("user_id", "day").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    return joined.select("event_id", (F.col("earlier") + F.sum("step").over(order)).cast("long").alias("depth"))
