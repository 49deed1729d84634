"""Line dedup by spread: lines on many distinct sites are boilerplate."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import small_or_not, written

SPACES = " \t\n\x0b\f\r"
#: log2 of the sketches' registers, and the relative standard error that follows.
LG_K = 10
ERROR = 1.04 / math.sqrt(2**LG_K)


def _hashes(line: Column) -> list[Column]:
    """128 bits of a line, from two seeds."""
    return [F.xxhash64(F.lit(1), line).alias("h1"), F.xxhash64(F.lit(2), line).alias("h2")]


def line_keys(docs: DataFrame) -> DataFrame:
    """doc_id, key, pos, site, h1, h2 of each line with a character other than white space; lines are compared without white space at their ends."""
    lines = docs.select("doc_id", F.xxhash64("text").alias("key"), F.col("site"), F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))
    trimmed = F.btrim("line", F.lit(SPACES))
    return lines.where(trimmed != "").select("doc_id", "key", "pos", "site", *_hashes(trimmed))


def spread_lines(keys: DataFrame, least_sites: int) -> DataFrame:
    """h1, h2 of the lines on `least_sites` distinct sites or more.

    One sketch a line hash is built by partial aggregation, merged and estimated. Estimates further than five standard errors (one site at
    least) from the threshold decide; the lines between are counted exactly, which again aggregates distinct (line, site) before it shuffles.
    """
    estimate = F.hll_sketch_estimate(F.hll_sketch_agg("site", F.lit(LG_K)))
    band = max(1.0, 5 * ERROR * least_sites)
    seen = keys.where(F.col("site").isNotNull())
    likely = written(seen.groupBy("h1", "h2").agg(estimate.alias("sites")).where(F.col("sites") >= least_sites - band), "spread")
    sure = likely.where(F.col("sites") > least_sites + band).select("h1", "h2")
    near = small_or_not(likely.where(F.col("sites") <= least_sites + band).select("h1", "h2"))
    exact = seen.join(near, ["h1", "h2"]).groupBy("h1", "h2").agg(F.count_distinct("site").alias("sites")).where(F.col("sites") >= least_sites)
    return written(sure.unionByName(exact.select("h1", "h2")), "boilerplate")


def remove_boilerplate(docs: DataFrame, least_sites: int = 10, id_col: str = "doc_id", text_col: str = "text", site_col: str = "source") -> DataFrame:
    """`docs` with the text cleared of lines that occur on `least_sites` distinct sites or more, and n_lines, n_removed.

    All occurrences go; lines of white space only stay and are never counted. Only line hashes are shuffled.
    Where lines or positions to remove are few they are broadcast to the scan, else joined by a shuffle that adaptive
    execution splits where one line or text is very common.

    Null text stays null, with no lines. A null site is no site, but its documents are cleared too. Repeated
    rows are cleared alike; equal lines tie in nothing. A text may become empty; its row stays. A very long text is cut in time
    linear in its lines, but held whole in a row. An empty table gives no rows. Other columns are carried along, whatever
    their names; those named n_lines or n_removed are replaced.
    """
    keys = written(line_keys(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(site_col).cast("string").alias("site"))), "lines")
    lines = small_or_not(spread_lines(keys, least_sites))
    same = F.coalesce(F.col("doc_id").cast("string"), F.lit("-"))
    # equal rows have equal positions, so a set of them is one row's
    cuts = keys.join(lines, ["h1", "h2"]).groupBy(same.alias("id"), "key").agg(F.collect_set("pos").alias("cut"))
    cuts = small_or_not(written(cuts, "cuts"))
    # the row travels in a struct, so its columns can't clash with those of the join
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.coalesce(F.col(id_col).cast("string"), F.lit("-")).alias("id"), F.xxhash64(text_col).alias("key"))
    joined = rows.join(cuts, ["id", "key"], "left")
    text, cut = F.col("row").getField(text_col), F.col("cut")
    parts = F.split(text, "\n", -1)
    stay = F.array_except(F.sequence(F.lit(0), F.size(parts) - 1), cut)
    left = F.array_join(F.transform(stay, lambda k: F.get(parts, k)), "\n")
    return joined.select(
        *(F.when(cut.isNull(), text).otherwise(left).alias(c) if c == text_col else F.col("row").getField(c).alias(c) for c in docs.columns if c not in ("n_lines", "n_removed")),
        F.when(text.isNull(), 0).otherwise(F.size(parts)).cast("long").alias("n_lines"),
        F.when(cut.isNull(), 0).otherwise(F.size(cut)).cast("long").alias("n_removed"),
    )


def digests(docs: DataFrame, **options) -> DataFrame:
    """doc_id, n_lines, n_removed, kept_sha256 of remove_boilerplate, whose odd cases hold; a null text's digest is that of an empty one."""
    return remove_boilerplate(docs, **options).select("doc_id", "n_lines", "n_removed", F.sha2(F.encode(F.coalesce("text", F.lit("")), "UTF-8"), 256).alias("kept_sha256"))


#: The same with exact counts, in DuckDB's SQL.
SPREAD_SQL = """
WITH d AS (SELECT doc_id, source, text, string_split(text, chr(10)) AS parts FROM {docs}),
t AS (SELECT *, list_transform(parts, lambda x: trim(x, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))) AS trimmed FROM d),
l AS (SELECT source, unnest(trimmed) AS line FROM t),
b AS (SELECT coalesce(list(line), []) AS lines FROM (SELECT line FROM l WHERE line <> '' GROUP BY line HAVING count(DISTINCT source) >= {least})),
k AS (SELECT t.*, list_filter(parts, lambda x, i: NOT list_contains(b.lines, trimmed[i])) AS kept FROM t, b)
SELECT doc_id, coalesce(len(parts), 0)::BIGINT AS n_lines, coalesce(len(parts) - len(kept), 0)::BIGINT AS n_removed,
  sha256(coalesce(array_to_string(kept, chr(10)), '')) AS kept_sha256 FROM k
"""
