"""Names made unique within a group by numbers, as if rows were named one after the other."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import written
from .ordered import PART, in_parts, ranked, running


def _numbered(base: Column, index: Column) -> Column:
    return F.when(index == 0, base).otherwise(F.concat(base, (index + 1).cast("string")))


def unique_names(rows: DataFrame, group: str, order: str, base: str, name: str = "name") -> DataFrame:
    """`group`, `order`, `base` and `name`: base for the first row of a group (by `order`, unique in it) that wants it, else the first of base2, base3, ... that no earlier row of the group has.

    A row of the k-th rank among those of its base takes the k-th of its names unless another base has it, which needs that base to be this one and
    digits more. Rows of such bases settle in rounds: each name stays with the earliest row that asks for it, a row that loses asks for its next, and rows of its
    base behind it for later ones; nothing moves once no name is asked for twice. All other rows are named by rank alone, so neither a group nor a base of
    any size is one task. Null bases and groups are values like others, a null base reads as empty.
    """
    wanted = ranked(rows.select(group, order, F.coalesce(base, F.lit("")).alias(base)), [group, base], [order], "_rank")
    bases = wanted.groupBy(group, base).agg(F.count(F.lit(1)).alias("_n"))
    digits = F.regexp_extract(base, r"(\d{1,18})$", 1)
    longer = bases.where(digits != "").select(group, F.col(base).alias("_long"), F.explode(F.sequence(F.lit(1), F.length(digits))).alias("_cut"))
    longer = longer.select(group, "_long", F.expr("left(_long, length(_long) - _cut)").alias("_short"), F.expr("right(_long, _cut)").alias("_digits")).where("_digits not like '0%'")
    met = longer.join(bases.select(F.col(group).alias("_group"), F.col(base).alias("_base")), F.col(group).eqNullSafe(F.col("_group")) & (F.col("_short") == F.col("_base")))
    related = met.select(group, F.explode(F.array("_long", "_short")).alias(base)).distinct()
    related = written(related.select(F.col(group).alias("_group"), F.col(base).alias("_base")), "related")
    same = F.col(group).eqNullSafe(F.col("_group")) & (F.col(base) == F.col("_base"))
    if related.isEmpty():
        return wanted.select(group, order, base, _numbered(F.col(base), F.col("_rank")).alias(name))
    wanted = written(wanted, "ranked")
    alone = wanted.join(related, same, "left_anti").select(group, order, base, _numbered(F.col(base), F.col("_rank")).alias(name))
    asked = wanted.join(related, same, "left_semi").withColumn("_index", F.col("_rank"))
    while True:
        asked = asked.withColumn("_name", _numbered(F.col(base), F.col("_index")))
        first = F.min(order).over(Window.partitionBy(group, "_name"))  # rows of several bases, one of each
        asked = written(asked.withColumn("_lost", F.col(order) > first), "asked")
        if asked.where("_lost").isEmpty():
            return alone.unionByName(asked.select(group, order, base, F.col("_name").alias(name)))
        parts = in_parts(asked, [group, base], ["_rank"])
        ahead = running(parts, [group, base], ["_rank"], "max", F.col("_index") + F.col("_lost").cast("long") - F.col("_rank"), "_ahead")
        asked = ahead.withColumn("_index", F.col("_ahead") + F.col("_rank")).drop("_ahead", "_lost", "_name", PART)
