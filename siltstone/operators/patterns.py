"""Texts that hold a pattern's words in a row, by an index of each pattern's rarest run of words."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.tables import written

#: Words of a run that stands for a pattern; shorter patterns are runs of their own length.
RUN = 5
#: A table with at most so many rows, counted first, is broadcast.
SMALL = 200_000


def words(text: Column) -> Column:
    """Lower-case words of ASCII white space; none of a null or blank text."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[\x20\x09-\x0D]+"), lambda w: w != "")


def _runs(column: str, width: int) -> Column:
    """Hashes of each `width` words in a row, in order."""
    spots = F.sequence(F.lit(1), F.size(column) - width + 1)
    return F.when(F.size(column) >= width, F.transform(spots, lambda k: F.xxhash64(F.lit(width), F.array_join(F.slice(column, k, width), " ")))).otherwise(F.array().cast("array<long>"))


def _if_small(df: DataFrame) -> DataFrame:
    return df.hint("broadcast") if df.limit(SMALL + 1).count() <= SMALL else df


def holding(docs: DataFrame, patterns: DataFrame, doc_id: str, pattern_id: str, text: str = "text", run: int = RUN) -> DataFrame:
    """`pattern_id`, `doc_id`, n_found: texts of `docs` that hold all words of a pattern in a row, ignoring case and the kind of white space, and at how many places.

    Runs of `run` words of the patterns are counted in all texts, and each pattern is looked up by its rarest one alone; only where that
    run stands is the whole pattern compared. Runs of words are joined by equality and only with those of patterns, so a common word makes no large group; a run that is
    common in itself is one of few keys, whose many places lie where their texts lie while the index is broadcast, if it has at most SMALL rows, else adaptive
    joins split them. Patterns without words are in no text. Rows of one id are texts of their own with the places summed; null ids are ids like others.
    """
    listed = patterns.select(F.col(pattern_id).alias("_pattern"), words(F.col(text)).alias("_words")).where(F.size("_words") > 0)
    listed = written(listed.withColumn("_n", F.least(F.size("_words"), F.lit(run))), "patterns")
    widths = sorted(r[0] for r in listed.select("_n").distinct().collect())  # run numbers at most
    read = docs.select(F.col(doc_id).alias("_doc"), words(F.col(text)).alias("_words"), F.xxhash64(text).alias("_text"))
    pairs = []
    for width in widths:
        own = listed.where(F.col("_n") == width).select("_pattern", "_words", F.posexplode(_runs("_words", width)).alias("_offset", "_run"))
        index = written(own.select("_pattern", "_offset", "_run"), "runs")
        spots = read.select("_doc", "_text", F.posexplode(_runs("_words", width)).alias("_place", "_run"))
        spots = written(spots.join(_if_small(index.select("_run").distinct()), "_run", "left_semi"), "spots")
        counts = spots.groupBy("_run").agg(F.count(F.lit(1)).alias("_count"))
        rarest = index.join(counts, "_run").groupBy("_pattern").agg(F.min_by(F.struct("_run", "_offset"), F.struct("_count", "_offset")).alias("_best"), F.count(F.lit(1)).alias("_met"))
        # a pattern with a run that stands nowhere stands nowhere
        whole = index.groupBy(F.col("_pattern").alias("_p")).agg(F.count(F.lit(1)).alias("_runs"))
        rarest = written(rarest.join(whole, (F.col("_p").eqNullSafe(F.col("_pattern"))) & (F.col("_runs") == F.col("_met"))).select("_pattern", "_best.*"), "rarest")
        pairs.append(spots.join(_if_small(rarest), "_run").where(F.col("_place") >= F.col("_offset")).select("_pattern", "_doc", "_text", (F.col("_place") - F.col("_offset")).alias("_start")))
    if not pairs:
        return docs.select(F.lit(None).cast(patterns.schema[pattern_id].dataType).alias(pattern_id), doc_id, F.lit(0).cast("long").alias("n_found")).where("false")
    candidates = pairs[0]
    for more in pairs[1:]:
        candidates = candidates.unionByName(more)
    # rows of one id and text are one candidate, and counted as often as they stand below
    candidates = _if_small(written(candidates.distinct(), "candidates"))
    copies = read.select("_doc", "_text", "_words").withColumnsRenamed({"_doc": "_d", "_text": "_t"})
    texts = copies.join(candidates, F.col("_doc").eqNullSafe(F.col("_d")) & F.col("_text").eqNullSafe(F.col("_t"))).drop("_d", "_t")
    full = texts.join(listed.select(F.col("_pattern").alias("_q"), F.col("_words").alias("_all")), F.col("_pattern").eqNullSafe(F.col("_q")))
    there = F.slice("_words", F.col("_start") + 1, F.size("_all")) == F.col("_all")
    found = full.where(there).groupBy("_pattern", "_doc").agg(F.count(F.lit(1)).alias("n_found"))
    return found.select(F.col("_pattern").alias(pattern_id), F.col("_doc").alias(doc_id), "n_found")
