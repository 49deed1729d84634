"""Running values within groups of any size: a group can lie in several ranges, and what the ranges before hold is carried to the next."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import written

PART = "_part"


def in_parts(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """`df` in ranges of keys and order, written, with `_part`, the number of a row's range. Rows that tie in all of these may fall in any order."""
    ranged = df.repartitionByRange(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys, *order)
    return written(ranged.withColumn(PART, F.spark_partition_id()), "parts")


def running(parts: DataFrame, keys: list[str], order: list[str], how: str, column: Column, name: str, current: bool = True) -> DataFrame:
    """`parts` (of `in_parts`) with `name`: of the rows up to this one (`current`) or before it in its group the `sum`, `max` or `last` of `column`, nulls aside; null of none.

    Windows run within a range. Of a group in several ranges, the values of the ranges are carried on; a border of two ranges divides one group at most, so
    what is carried has fewer than twice as many rows as there are ranges, and is broadcast.
    """
    inner = Window.partitionBy(*keys, PART).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0 if current else -1)
    outer = Window.partitionBy(*keys).orderBy(PART)
    before = outer.rowsBetween(Window.unboundedPreceding, -1)
    place = F.when(column.isNotNull(), F.struct(*order))
    total = {"sum": F.sum(column), "max": F.max(column), "last": F.max_by(column, place)}[how].alias("_total")
    totals = parts.groupBy(*keys, PART).agg(total).withColumn("_parts", F.count(F.lit(1)).over(Window.partitionBy(*keys))).where("_parts > 1")
    carry = {"sum": F.sum("_total"), "max": F.max("_total"), "last": F.last("_total", ignorenulls=True)}[how].over(before)
    carried = totals.select(*(F.col(k).alias(f"_key_{k}") for k in keys), F.col(PART).alias("_key"), carry.alias("_carried"))
    same = [F.col(k).eqNullSafe(F.col(f"_key_{k}")) for k in keys] + [F.col(PART) == F.col("_key")]
    local = {"sum": F.sum(column), "max": F.max(column), "last": F.last(column, ignorenulls=True)}[how].over(inner)
    joined = parts.withColumn("_local", local).join(F.broadcast(carried), same, "left")
    local, carried_ = F.col("_local"), F.col("_carried")
    value = {"sum": F.coalesce(local + carried_, local, carried_), "max": F.greatest(local, carried_), "last": F.coalesce(local, carried_)}[how]
    return joined.withColumn(name, value).drop("_local", "_carried", "_key", *(f"_key_{k}" for k in keys))


def ranked(df: DataFrame, keys: list[str], order: list[str], name: str = "rank") -> DataFrame:
    """`df` with `name`, a row's place in its group from 0 on."""
    return running(in_parts(df, keys, order), keys, order, "sum", F.lit(1).cast("long"), name).withColumn(name, F.col(name) - 1).drop(PART)


def as_of(left: DataFrame, right: DataFrame, by: list[str], time: str, tie: str, take: list[str], prefix: str = "last_") -> DataFrame:
    """Each row of `left` with the columns `take` (named with `prefix`) of the last row of `right` of equal `by` at or before its `time`; of equal times that of largest `tie`. Null if there is none.

    Both sides are merged in order and the last right row is carried along, so neither is joined to all of the other, and a key of any number of rows is
    spread over ranges. Rows of null `by` meet each other; rows of null `time` are never at or before another.
    """
    columns = [c for c in left.columns if c not in (*by, time, tie)]
    payload = F.struct(*(F.col(c).alias(f"{prefix}{c}") for c in take))
    rights = right.where(F.col(time).isNotNull()).select(*by, time, tie, F.lit(0).alias("_side"), payload.alias("_right"))
    lefts = left.select(*by, time, tie, F.lit(1).alias("_side"), F.struct(F.lit(0).alias("_none"), *columns).alias("_left"))
    order = [time, "_side", tie]
    both = in_parts(lefts.unionByName(rights, allowMissingColumns=True), by, order)
    found = running(both, by, order, "last", F.col("_right"), "_found").where("_side = 1")
    hit = F.when(F.col(time).isNotNull(), F.col("_found"))
    return found.withColumn("_hit", hit).select(*by, time, tie, *(F.col(f"_left.{c}") for c in columns), *(F.col(f"_hit.{prefix}{c}") for c in take))


def attached(turns: DataFrame, by: str, order: str, header: Column, take: list[str], look_back: int = 2) -> DataFrame:
    """Rows that aren't headers, with `opener` (the `order` of the last header before them in their group, null if none), `place` (from 1 on after it) and `before`, an array of the structs `take` of up to `look_back` rows before, oldest first.

    `by` may be null (one group); equal `order` values may come in any order. A group of any number of rows is spread over ranges.
    """
    columns = turns.columns
    parts = in_parts(turns.withColumn("_header", F.coalesce(header, F.lit(False))), [by], [order])
    found = running(parts, [by], [order], "last", F.when(F.col("_header"), F.struct(F.col(order).alias("at"))), "_opener")
    found = running(found, [by], [order], "sum", F.lit(1).cast("long"), "_row")
    found = running(found, [by], [order], "last", F.when(F.col("_header"), F.col("_row")), "_opened")
    earlier, column = [], F.struct(*take)
    for k in range(look_back):
        # the value of the row before, in a struct so that a first row's null is a value too
        found = running(found, [by], [order], "last", F.struct(column.alias("value")), f"_back{k}", current=False)
        column = F.col(f"_back{k}.value")
        earlier.append(column)
    place = F.when(F.col("_opener").isNotNull(), F.col("_row") - F.col("_opened"))
    return found.where(~F.col("_header")).select(*columns, F.col("_opener.at").alias("opener"), place.alias("place"), F.array_compact(F.array(*earlier[::-1])).alias("before"))
