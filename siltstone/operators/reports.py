"""What reports show: findings in the order of the plan with capped evidence, lists with a remainder, counts before the newest row, totals by grouping sets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import facts, rules
from .checks import findings

# How long a fix takes; records of evidence shown.
EFFORT_LABELS = {"quick": "under an hour", "medium": "half a day", "project": "a day or more"}
SHOWN = 12


def capped(rows: DataFrame, keys: list[str], order: list[str], shown: str, most: int) -> DataFrame:
    """keys, `first` (array of the first `most` values of `shown` by order), `more` (how many others there are); a group's other rows are counted, not gathered."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    first = rows.select(*keys, shown, place.alias("_place")).where(F.col("_place") <= most).groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("_place", shown))).alias("_first"))
    counted = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
    met = counted.join(first.withColumnsRenamed({k: f"_{k}" for k in keys}), same, "left")
    return met.select(*keys, F.transform("_first", lambda x: x[shown]).alias("first"), (F.col("_n") - F.size("_first")).alias("more"))


def wire_findings(view: DataFrame, page_facts: DataFrame, failed: DataFrame) -> DataFrame:
    """host, position, id, area, severity, effort, effort_label, points, pages (paths of the first SHOWN pages that break the rule, by page_id), more of each failed check, in the order of the plan."""
    broken = rules.page_findings(view).select("page_id", "host", "rule").unionByName(findings(page_facts, ["page_id", "host"], facts.DESIGN_CHECKS).select("page_id", "host", "rule"))
    paths = view.select(F.col("page_id").alias("_id"), F.col("host").alias("_host"), "path")
    named = broken.join(paths, F.col("page_id").eqNullSafe(F.col("_id")) & (F.col("host") == F.col("_host")))
    shown = capped(named.select("host", "rule", "page_id", "path"), ["host", "rule"], ["page_id", "path"], "path", SHOWN)
    plan = rules.fix_plan(failed).join(failed.select("host", "rule", "area", "severity"), ["host", "rule"]).join(shown, ["host", "rule"], "left")
    points = F.when(F.col("area") == "design", rules.DESIGN_SIGN).otherwise(rules.weight(F.col("severity"))).cast("long")
    label = F.element_at(F.create_map(*(F.lit(x) for kv in EFFORT_LABELS.items() for x in kv)), F.col("effort"))
    return plan.select("host", "position", F.col("rule").alias("id"), "area", "severity", "effort", label.alias("effort_label"), points.alias("points"), F.array_join("first", "\n").alias("pages"), F.coalesce("more", F.lit(0)).cast("long").alias("more"))


def newest(rows: DataFrame, keys: list[str], time: str, tie: str, most: int) -> DataFrame:
    """The `most` newest rows of each group, newest first (`place` from 1); of equal times that of larger `tie` is newer. Null times are oldest. Ranks are limited before the shuffle too."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(F.col(time).desc_nulls_last(), F.desc(tie)))
    return rows.withColumn("place", place).where(F.col("place") <= most)


def before_newest(rows: DataFrame, keys: list[str], time: str, days: tuple[int, ...]) -> DataFrame:
    """keys, `last_<n>` (rows at most n days before the newest row of all), `days` and `months` (distinct ones with rows), of each group. Null times count nowhere.

    The newest time is one row, brought to all; days are made distinct by group before they are counted.
    """
    timed = rows.where(F.col(time).isNotNull())
    top = timed.agg(F.max(time).alias("_newest"))
    age = F.unix_micros(F.col("_newest").cast("timestamp")) - F.unix_micros(F.col(time).cast("timestamp"))
    near: list[Column] = [F.sum((F.col("_age") <= F.lit(n) * F.lit(86_400_000_000).cast("long")).cast("long")).alias(f"last_{n}") for n in days]
    by_day = timed.crossJoin(F.broadcast(top)).withColumn("_age", age).groupBy(*keys, F.to_date(time).alias("_day")).agg(*near)
    return by_day.groupBy(*keys).agg(*(F.sum(f"last_{n}").alias(f"last_{n}") for n in days), F.count(F.lit(1)).alias("days"), F.count_distinct(F.trunc("_day", "month")).alias("months"))


def totals(rows: DataFrame, keys: list[str], value: Column) -> DataFrame:
    """keys, `level` (bits of the keys that a row sums over, the first the highest), n, total: sums over all subsets of the keys."""
    return rows.cube(*keys).agg(F.grouping_id().cast("long").alias("level"), F.count(F.lit(1)).alias("n"), F.sum(value).alias("total"))
