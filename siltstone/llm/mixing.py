"""Mixing sources to target weights by Pareto order sampling."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .store import small_or_not, written
from .words import word_count

#: Documents of a source that share one bin of the ranking, on average.
BIN_ROWS = 1024


def uniform(key: Column, seed: int) -> Column:
    """A number in (0, 1) fixed by the key: the first 52 bits of md5(key|seed), centred in its cell."""
    head = F.substring(F.md5(F.concat_ws("|", F.coalesce(key.cast("string"), F.lit("")), F.lit(str(seed)))), 1, 13)
    return (F.conv(head, 16, 10).cast("double") + 0.5) / F.lit(float(2**52))


def _turns(sizes: DataFrame, n_weights: int) -> DataFrame:
    """source, source_size, turn: the place of each source in code-point order, null last, modulo `n_weights`.

    A range partition orders the sources; a place is the one in its partition plus the rows of the partitions before.
    """
    ordered = sizes.repartitionByRange(F.col("source").asc_nulls_last()).sortWithinPartitions(F.col("source").asc_nulls_last())
    ordered = written(ordered.select("source", "source_size", F.spark_partition_id().alias("part"), (F.monotonically_increasing_id() % 2**33).alias("at")), "sources")
    # one row a partition
    before, rows = 0, []
    for r in ordered.groupBy("part").count().sort("part").collect():
        rows.append((r["part"], before))
        before += r["count"]
    starts = sizes.sparkSession.createDataFrame(rows, "part int, start long")
    return ordered.join(F.broadcast(starts), "part").select("source", "source_size", ((F.col("start") + F.col("at")) % n_weights).cast("int").alias("turn"))


def source_targets(sizes: DataFrame, weights: tuple[int, ...], share: float, cap: float) -> DataFrame:
    """source, source_size -> target.

    Sources in code-point order, null last, have `weights` in turn and divide `share` times all sizes.
    A target stops at `cap` times its source's size and the excess is divided anew by weight until none
    is above: of a level, sources with cap/weight up to it are full and the others get the level times their weight.
    Each round is one sum over the sources, however many they are, and raises the level until no more are full.
    """
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), F.col("turn") + 1)
    ranked = _turns(sizes, len(weights)).select("source", "source_size", weight.alias("weight"), (F.col("source_size") * F.lit(float(cap))).alias("most"))
    ranked = written(ranked.withColumn("ratio", F.col("most") / F.col("weight")), "weights")
    total, level, last = 0.0, -1.0, None
    while level != last:
        last, full = level, F.col("ratio") <= F.lit(level)
        r = ranked.agg(F.sum("source_size"), F.sum(F.when(full, F.col("most"))), F.sum(F.when(~full, F.col("weight")))).first()
        total = float(share) * (r[0] or 0)
        level = (total - (r[1] or 0.0)) / r[2] if r[2] else math.inf
    target = F.when(F.col("ratio") <= F.lit(level), F.col("most")).otherwise(F.lit(level) * F.col("weight"))
    return ranked.select("source", "source_size", F.round(target, 6).alias("target"))


def levels(sized: DataFrame, sources: DataFrame, cap: float) -> DataFrame:
    """`sources` (source, target, ...) with level: a document expects the smaller of `cap` and level times its importance.

    What the cap cuts off goes to the others of the source: each round sums, source by source, what is full and the weight that is
    open, and raises the levels until no more documents are full. Without documents of any importance the level is 0.
    """
    level = F.when(F.col("weighted") > 0, F.col("target") / F.col("weighted")).otherwise(0.0)
    known, raised = written(sources.withColumn("level", level), "levels"), 1
    while raised:
        joined = sized.alias("d").join(small_or_not(known).alias("t"), F.col("d.source").eqNullSafe(F.col("t.source")))
        full = F.col("importance") * F.col("level") >= F.lit(float(cap))
        sums = joined.groupBy(F.col("d.source").alias("of")).agg(
            F.coalesce(F.sum(F.when(full, F.col("size"))), F.lit(0)).alias("full"), F.coalesce(F.sum(F.when(~full, F.col("size") * F.col("importance"))), F.lit(0.0)).alias("open")
        )
        rest = F.col("target") - F.col("full") * F.lit(float(cap))
        up = F.when((F.col("open") > 0) & (rest / F.col("open") > F.col("level") * (1 + 1e-12)), rest / F.col("open"))
        known = written(known.join(small_or_not(written(sums, "sums")), F.col("source").eqNullSafe(F.col("of")), "left").select(*sources.columns, F.coalesce(up, "level").alias("level"), up.isNotNull().alias("up")), "levels")
        raised = known.where("up").count()
        known = known.drop("up")
    return known


def decisions(
    docs: DataFrame,
    weights: tuple[int, ...] = (5, 2, 1),
    share: float = 1.5,
    cap: float = 2.0,
    seed: int = 20,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    importance: Column | None = None,
) -> DataFrame:
    """doc_id, source, size, source_size, target, copies, taken of each row.

    Each document expects target / source_size copies, in proportion to its `importance` (1 by default, so all words of
    a source count alike) but `cap` at most, the excess going to the others of its source (`levels`). Whole copies are certain. The fraction left is the document's inclusion
    probability p; documents are ranked by odds(u) / odds(p), u being fixed by the id, and the first
    ones of their source are taken until the words reach what the whole copies leave of the target,
    to within half of the document on the line.

    The running sum never passes a whole source through one task: the rank is cut into bins of about
    BIN_ROWS documents, the bins are summed, and only the bin on the line is ordered row by row.

    Null text has size 0. A null source is a source of its own, last in order. Null ids are ranked as
    an empty id. Rows with equal id tie and are ranked in order of size; those of equal id and size are taken alike. A null importance is 1, one below 0 is 0; if a source's importances are all 0 nothing of it is taken. A very
    long text is counted whole. An empty table gives no rows. Other columns are ignored, whatever their names.
    """
    equal = importance is None
    importance = F.lit(1.0) if equal else F.greatest(F.coalesce(importance.cast("double"), F.lit(1.0)), F.lit(0.0))
    sized = written(
        docs.select(
            F.col(id_col).alias("doc_id"),
            F.col(source_col).alias("source"),
            word_count(F.col(text_col)).alias("size"),
            importance.alias("importance"),
        ),
        "sizes",
    )
    sources = sized.groupBy("source").agg(
        F.sum("size").alias("source_size"),
        F.sum(F.col("size") * F.col("importance")).alias("weighted"),
        F.count(F.lit(1)).alias("n_docs"),
    )
    targets = source_targets(sources.select("source", "source_size"), weights, share, cap)
    sources = written(sources, "source-sums")
    targets = targets.alias("t").join(sources.alias("s"), F.col("t.source").eqNullSafe(F.col("s.source"))).select(
        "t.*", "s.weighted", F.greatest(F.lit(1), F.ceil(F.col("s.n_docs") / BIN_ROWS)).alias("n_bins")
    )
    # of equal importance nothing is above the cap, as no target is
    level = F.when(F.col("weighted") > 0, F.col("target") / F.col("weighted")).otherwise(0.0)
    targets = small_or_not(written(targets.withColumn("level", level), "targets") if equal else levels(sized, targets, cap))
    u = uniform(F.col("doc_id"), seed)
    expects = F.col("level") * F.col("importance")
    chance = F.col("expects") - F.col("whole")
    rank = (F.col("u") / (1 - F.col("u"))) / (chance / (1 - chance))
    ranked = (
        sized.alias("d")
        .join(targets.alias("t"), F.col("d.source").eqNullSafe(F.col("t.source")))
        .select("d.doc_id", "d.size", "t.*", F.least(expects, F.lit(float(cap))).alias("expects"), u.alias("u"))
        .withColumn("whole", F.floor("expects"))
        .withColumn("rank", F.when(chance > 0, rank))
        .withColumn("bin", F.floor(F.col("rank") / (1 + F.col("rank")) * F.col("n_bins")))
    )
    by_bin = ranked.groupBy("source", "bin").agg(
        F.sum("size").alias("words"),
        F.sum(F.col("size") * F.col("whole")).alias("certain"),
        F.first("target").alias("target"),
    )
    run = Window.partitionBy("source").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    lines = (
        by_bin.withColumn("rest", F.col("target") - F.sum("certain").over(Window.partitionBy("source")))
        .where(F.col("bin").isNotNull())
        .withColumn("all", F.sum("words").over(Window.partitionBy("source")))
        .withColumn("start", F.coalesce(F.sum("words").over(run), F.lit(0)))
        # a rest of more than all ranked words takes them all: the line is in the last bin
        .withColumn("rest", F.least("rest", "all"))
        .where((F.col("start") <= F.col("rest")) & (F.col("rest") <= F.col("start") + F.col("words")))
        .groupBy("source")
        .agg(F.min_by(F.struct("bin", "start", "rest"), "bin").alias("line"))
    )
    lines = small_or_not(written(lines, "lines"))
    placed = ranked.alias("r").join(lines.alias("l"), F.col("r.source").eqNullSafe(F.col("l.source")), "left").select("r.*", "line")
    # whole bins are decided by their number, so only the bins on the line are ever ordered, rows of one id and size as one
    decided = placed.where(F.col("rank").isNull() | F.col("line").isNull() | (F.col("bin") != F.col("line.bin"))).withColumn(
        "extra", F.coalesce((F.col("bin") < F.col("line.bin")).cast("long"), F.lit(0).cast("long"))
    )
    on_line = placed.where(F.col("rank").isNotNull() & (F.col("bin") == F.col("line.bin")))
    order = Window.partitionBy("source").orderBy("rank", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    tied = on_line.groupBy("source", "rank", "doc_id", "size", "line").agg((F.col("size") * F.count(F.lit(1))).alias("words"))
    tied = tied.select(
        F.col("source").alias("of"), F.col("doc_id").alias("id"), F.col("size").alias("long"),
        (F.col("line.start") + F.coalesce(F.sum("words").over(order), F.lit(0)) + F.col("words") / 2 <= F.col("line.rest")).cast("long").alias("extra"),
    )
    tied = small_or_not(written(tied, "tied"))
    ordered = on_line.join(tied, F.col("source").eqNullSafe(F.col("of")) & F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("size") == F.col("long"))).drop("of", "id", "long")
    copies = F.col("whole") + F.col("extra")
    return decided.unionByName(ordered).select(
        "doc_id",
        "source",
        "size",
        "source_size",
        "target",
        copies.alias("copies"),
        (copies * F.col("size")).alias("taken"),
    )


def mix(docs: DataFrame, **options) -> DataFrame:
    """doc_id, size, source_size, target, copies, taken of each row, as `decisions` has them."""
    return decisions(docs, **options).select("doc_id", "size", "source_size", "target", "copies", "taken")


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """Each row of `docs`, with its columns, whatever their names, as often as the mix takes it; odd cases as in `decisions`.

    Rows of one id, source and size are taken alike, so the decisions are joined by these, broadcast if few.
    """
    made = decisions(docs, id_col=id_col, text_col=text_col, source_col=source_col, **options).where("copies > 0")
    made = made.groupBy(F.struct("doc_id", "source", "size").alias("key")).agg(F.first("copies").cast("int").alias("copies"))
    made = small_or_not(written(made, "copies"))
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")
    key = F.struct(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size")).alias("key")
    taken = docs.select(row, key).alias("d").join(made.alias("m"), F.col("d.key").eqNullSafe(F.col("m.key")))
    return taken.select("row", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy")).select("row.*")


#: The whole mix in DuckDB's SQL, for one importance: every document orders in one window there.
MIX_SQL = """
WITH s AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size FROM {docs}),
g AS (SELECT source, sum(size)::BIGINT AS source_size FROM s GROUP BY source),
w AS (SELECT *, [5.0, 2.0, 1.0][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT]::DOUBLE AS weight FROM g),
r AS (SELECT *, source_size * 2.0::DOUBLE AS most, source_size * 2.0::DOUBLE / weight AS ratio, sum(source_size) OVER () * 1.5::DOUBLE AS total FROM w),
f AS (SELECT *, coalesce(sum(most) OVER b, 0) AS full_before, sum(weight) OVER () - coalesce(sum(weight) OVER b, 0) AS weight_left FROM r
      WINDOW b AS (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
h AS (SELECT *, ratio * weight_left <= total - full_before AS is_full FROM f),
t AS (SELECT source, source_size, round(CASE WHEN is_full THEN most ELSE (total - coalesce(sum(CASE WHEN is_full THEN most END) OVER (), 0))
      / sum(CASE WHEN NOT is_full THEN weight END) OVER () * weight END, 6) AS target FROM h),
e AS (SELECT s.doc_id, s.size, t.*, least(CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END, 2.0)::DOUBLE AS expects,
      (('0x' || substr(md5(coalesce(s.doc_id::VARCHAR, '') || '|20'), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0::DOUBLE AS u
      FROM s JOIN t ON s.source IS NOT DISTINCT FROM t.source),
k AS (SELECT *, floor(expects)::BIGINT AS whole FROM e),
q AS (SELECT *, CASE WHEN expects - whole > 0 THEN (u / (1 - u)) / ((expects - whole) / (1 - (expects - whole))) END AS rank,
      target - sum(size * whole) OVER (PARTITION BY source) AS rest FROM k),
c AS (SELECT *, sum(size) OVER (PARTITION BY source, rank IS NULL ORDER BY rank, doc_id, size RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS run,
      sum(size) OVER (PARTITION BY source, rank, doc_id, size) AS alike FROM q),
p AS (SELECT *, whole + CASE WHEN rank IS NOT NULL AND run - alike / 2.0::DOUBLE <= rest THEN 1 ELSE 0 END AS copies FROM c)
SELECT doc_id, size, source_size, target, copies::BIGINT AS copies, (copies * size)::BIGINT AS taken FROM p
"""
