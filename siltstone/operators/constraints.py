"""Checks, not-null columns and foreign keys of tables: each row with what it violates, counts, and good and bad rows apart."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ..sources.tables import written


@dataclass(frozen=True)
class Rules:
    """Columns that can't be null; checks by name, as SQL that must not be false (null passes, as in SQL); foreign keys by column, as table and column."""

    not_null: tuple[str, ...] = ()
    checks: dict[str, str] = field(default_factory=dict)
    foreign: dict[str, tuple[str, str]] = field(default_factory=dict)

    @property
    def names(self) -> list[str]:
        return [*(f"{c} not null" for c in self.not_null), *self.checks, *(f"{c} in {t}.{k}" for c, (t, k) in self.foreign.items())]


def violations(table: DataFrame, rules: Rules, tables: dict[str, DataFrame]) -> DataFrame:
    """`table` with `violations`, the names of the rules that a row breaks, in order; one pass over it, and a join for each foreign key.

    The keys of the other side are made distinct first, so a join repeats no row; a null key refers to nothing and passes.
    """
    broken: list[Column] = [F.when(F.col(c).isNull(), F.lit(f"{c} not null")) for c in rules.not_null]
    broken += [F.when(~F.expr(check), F.lit(name)) for name, check in rules.checks.items()]
    for k, (column, (other, key)) in enumerate(rules.foreign.items()):
        known = tables[other].select(F.col(key).alias(f"_key{k}")).where(F.col(key).isNotNull()).distinct()
        table = table.join(known, F.col(column) == F.col(f"_key{k}"), "left")
        broken.append(F.when(F.col(column).isNotNull() & F.col(f"_key{k}").isNull(), F.lit(f"{column} in {other}.{key}")))
    return table.withColumn("violations", F.array_compact(F.array(*broken))).drop(*(f"_key{k}" for k in range(len(rules.foreign))))


def counted(table: DataFrame, rules: Rules, tables: dict[str, DataFrame]) -> DataFrame:
    """rule, n_rows, n_bad of each rule, also of those that no row breaks; partial counts are made where rows lie."""
    found = violations(table, rules, tables)
    counts = found.agg(F.count(F.lit(1)).alias("n_rows"), *(F.count_if(F.array_contains("violations", n)).alias(f"_{k}") for k, n in enumerate(rules.names)))
    pairs = F.array(*(F.struct(F.lit(n).alias("rule"), F.col(f"_{k}").alias("n_bad")) for k, n in enumerate(rules.names)))
    return counts.select("n_rows", F.inline(pairs)).select("rule", "n_rows", "n_bad")


def quarantined(table: DataFrame, rules: Rules, tables: dict[str, DataFrame]) -> tuple[DataFrame, DataFrame, dict[str, int]]:
    """Good rows, bad rows (with `violations`), and the numbers of rows and of violations by rule, observed while the judged rows are written once."""
    seen = Observation()
    counts = [F.count(F.lit(1)).alias("rows"), *(F.count_if(F.array_contains("violations", n)).alias(n) for n in rules.names)]
    judged = written(violations(table, rules, tables).observe(seen, *counts), "judged")
    bad = F.size("violations") > 0
    return judged.where(~bad).drop("violations"), judged.where(bad), seen.get
