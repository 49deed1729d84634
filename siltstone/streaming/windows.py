"""Event-time streams: windows, sessions, repeats and an interval join; the watermark evicts what is over."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _timed(events: DataFrame, late: str) -> DataFrame:
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """user_id, begin, end, n_events of each session, `end` being `gap` after its last event. A stream appends a session once the watermark has passed its end; null times are of none."""
    grouped = _timed(events, late).groupBy(F.session_window("ts", gap).alias("s"), "user_id").agg(F.count(F.lit(1)).alias("n_events"))
    return grouped.select("user_id", F.col("s.start").alias("begin"), F.col("s.end").alias("end"), "n_events")


def without_repeats(events: DataFrame, keys: list[str], late: str = "1 hour") -> DataFrame:
    """The first row of each key; state goes once the watermark has passed it, so repeats are known for `late` and a key can return afterwards."""
    return _timed(events, late).dropDuplicatesWithinWatermark(keys)


def followed_by(firsts: DataFrame, seconds: DataFrame, within: int = 600, late: str = "1 hour") -> DataFrame:
    """user_id, first_id, second_id, first_ts, second_ts: pairs of a row of `firsts` and one of `seconds` of its user, at its time or up to `within` seconds after.

    Both are event streams (event_id, ts, user_id). Rows meet by user and a slice of time as long as `within`: a first row is in its own slice and the
    next, so a user of any number of events is spread over slices. State of both sides goes by the watermarks. Null users and times meet nothing.
    """
    length = F.expr(f"interval {within} seconds")
    slice_of = lambda ts: F.floor(F.unix_seconds(ts) / within)
    left = _timed(firsts, late).select(F.col("event_id").alias("first_id"), F.col("ts").alias("first_ts"), "user_id", F.explode(F.array(slice_of(F.col("ts")), slice_of(F.col("ts")) + 1)).alias("slice"))
    right = _timed(seconds, late).select(F.col("event_id").alias("second_id"), F.col("ts").alias("second_ts"), F.col("user_id").alias("u"), slice_of(F.col("ts")).alias("s"))
    near = (F.col("second_ts") >= F.col("first_ts")) & (F.col("second_ts") <= F.col("first_ts") + length)
    return left.join(right, (F.col("user_id") == F.col("u")) & (F.col("slice") == F.col("s")) & near).select("user_id", "first_id", "second_id", "first_ts", "second_ts")
