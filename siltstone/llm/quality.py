"""Quality rules: base rules, then robust multivariate outliers per language and source."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .memo import released
from .store import measured, small_or_not, written

#: The symbols of the base rule, and the other ASCII punctuation.
SYMBOLS = "#*$%&|<>"
PUNCTUATION = b"!\"'()+,-./:;=?@[\\]^_`{}~"
CAPITALS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
SPACES = " \t\n\v\f\r"

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_capitals", "n_punctuation")


def repeated_words(words: list[bytes], width: int = 3) -> int:
    """Words inside a `width`-word window whose words occur in two or more windows, first ones included."""
    n = len(words) - width + 1
    if n < 2:
        return 0
    seen: dict[bytes, int] = {}
    ids = np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, len(words))
    key = ids[:n]
    for k in range(1, width):
        if k > 1 and int(key.max()) > 2**62 // len(seen):
            key = np.unique(key, return_inverse=True)[1]
        key = key * len(seen) + ids[k : n + k]
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    if not same.any():
        return 0
    twice = np.zeros(n, bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    covered = np.zeros(len(words), bool)
    for k in range(width):
        covered[k : n + k] |= twice
    return int(covered.sum())


def counts_of(text: str | None) -> tuple[int, ...]:
    """COUNTS of a text; null is an empty text."""
    if not text:
        return (0,) * len(COUNTS)
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    lines = [x for x in text.split("\n") if x.strip(SPACES)]
    return (
        len(words),
        len(text) - sum(text.count(c) for c in SPACES),
        sum(text.count(c) for c in SYMBOLS),
        len(lines) - len(set(lines)),
        repeated_words(words),
        len(lines),
        len(raw) - len(raw.translate(None, CAPITALS)),
        len(raw) - len(raw.translate(None, PUNCTUATION)),
    )


def with_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """doc_id, lang, source, key and COUNTS of each row; the text itself stays behind."""
    schema = "doc_id long, lang string, source string, key long, " + ", ".join(f"{c} long" for c in COUNTS)
    fields = [pa.field(c, pa.int64()) for c in COUNTS]

    @released
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = np.array([counts_of(t.as_py()) for t in batch.column(4)], np.int64).reshape(-1, len(COUNTS))
            columns = [*batch.columns[:4], *(pa.array(rows[:, k]) for k in range(len(COUNTS)))]
            yield pa.RecordBatch.from_arrays(columns, schema=pa.schema([*(batch.schema.field(k) for k in range(4)), *fields]))

    return docs.select("doc_id", "lang", "source", F.xxhash64(text_col).alias("key"), text_col).mapInArrow(count, schema)


def base_failed(least_words: int = 50, most_repeated: int = 50) -> Column:
    return (F.col("n_words") < least_words) | (100 * F.col("n_repeat_words") > most_repeated * F.col("n_words"))


#: The transformed statistics and the least standard deviation that a cell's estimate is given in each.
FEATURES = {
    "word_length": ("log2(1 + word_chars / greatest(n_words, 1))", 0.06),
    "symbols": ("log2(1 + 20 * n_symbols / greatest(n_words, 1))", 0.15),
    "dup_lines": ("sqrt(n_dup_lines / greatest(n_lines, 1))", 0.15),
    "repeats": ("sqrt(n_repeat_words / greatest(n_words, 1))", 0.08),
    "capitals": ("log2(1 + n_capitals / greatest(n_words, 1))", 0.06),
    "punctuation": ("log2(1 + n_punctuation / greatest(n_words, 1))", 0.06),
}
D = len(FEATURES)
X = [f"x{k}" for k in range(D)]
PAIRS = [(i, j) for i in range(D) for j in range(i, D)]


def chi2_cdf(x: float, d: int) -> float:
    """Chi-square distribution function, by the series of the lower incomplete gamma function."""
    a, x = d / 2, x / 2
    if x <= 0:
        return 0.0
    term = total = 1 / a
    k = 0
    while term > total * 1e-16:
        k += 1
        term *= x / (a + k)
        total += term
    return min(1.0, total * math.exp(a * math.log(x) - x - math.lgamma(a)))


def chi2_quantile(p: float, d: int) -> float:
    low, high = 0.0, 1e4
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if chi2_cdf(mid, d) < p else (low, mid)
    return high


def distance(mean: str = "mean", inverse: str = "inverse") -> Column:
    """Squared Mahalanobis distance of x0.. from a cell's centre."""
    off = [F.col(x) - F.element_at(mean, k + 1) for k, x in enumerate(X)]
    terms = [(1 if i == j else 2) * off[i] * off[j] * F.element_at(inverse, k + 1) for k, (i, j) in enumerate(PAIRS)]
    return sum(terms[1:], terms[0])


def _fit(moments: DataFrame, share: float) -> DataFrame:
    """Centre, inverse scatter and log-determinant of each cell and start from n, s0.. (sums) and p0_0.. (sums of products), rescaled for the share kept."""
    scale = share / chi2_cdf(chi2_quantile(share, D), D + 2) if share < 1 else 1.0
    floors = np.array([f for _, f in FEATURES.values()]) ** 2

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            table = batch.to_pandas()
            n = table["n"].to_numpy(float)[:, None]
            mean = table[[f"s{k}" for k in range(D)]].to_numpy(float) / n
            scatter = np.zeros((len(table), D, D))
            for i, j in PAIRS:
                scatter[:, i, j] = scatter[:, j, i] = table[f"p{i}_{j}"].to_numpy(float) / n[:, 0] - mean[:, i] * mean[:, j]
            yield _state(batch, mean, scatter * scale + np.diag(floors))

    return moments.select("cell", "start", *MOMENTS).mapInArrow(fit, STATE)


STATE = "cell string, start int, mean array<double>, inverse array<double>, logdet double"
MOMENTS = ["n", *(f"s{k}" for k in range(D)), *(f"p{i}_{j}" for i, j in PAIRS)]


def _state(batch: pa.RecordBatch, mean: np.ndarray, scatter: np.ndarray) -> pa.RecordBatch:
    inverse = np.linalg.inv(scatter) if len(scatter) else scatter
    logdet = np.linalg.slogdet(scatter)[1] if len(scatter) else np.zeros(0)
    lists = lambda rows: pa.array(rows, pa.list_(pa.float64()))
    return pa.RecordBatch.from_arrays(
        [batch.column("cell"), batch.column("start"), lists(mean.tolist()), lists([[m[i, j] for i, j in PAIRS] for m in inverse]), pa.array(logdet, pa.float64())],
        names=["cell", "start", "mean", "inverse", "logdet"],
    )


def _moments() -> list[Column]:
    sums = [F.sum(x).alias(f"s{k}") for k, x in enumerate(X)]
    return [F.count(F.lit(1)).alias("n"), *sums, *(F.sum(F.col(X[i]) * F.col(X[j])).alias(f"p{i}_{j}") for i, j in PAIRS)]


def _starts(points: DataFrame) -> DataFrame:
    """STATE of three starts of each cell, all about the medians and scaled by median deviations: without correlations (0),
    with those of the squashed coordinates (1), and with those of the directions from the centre (2)."""
    middle = points.groupBy("cell").agg(*(F.percentile(x, 0.5).alias(f"m{k}") for k, x in enumerate(X)))
    middle = small_or_not(written(middle, "medians"))
    spread = points.join(middle, "cell").groupBy("cell").agg(*(F.first(f"m{k}").alias(f"m{k}") for k in range(D)), *(F.percentile(F.abs(F.col(x) - F.col(f"m{k}")), 0.5).alias(f"d{k}") for k, x in enumerate(X)))
    floors = [f for _, f in FEATURES.values()]
    deviation = [F.sqrt(F.pow(1.4826 * F.col(f"d{k}"), 2) + F.lit(f**2)).alias(f"d{k}") for k, f in enumerate(floors)]
    spread = small_or_not(written(spread.select("cell", *(f"m{k}" for k in range(D)), *deviation), "deviations"))
    scaled = [(F.col(x) - F.col(f"m{k}")) / F.col(f"d{k}") for k, x in enumerate(X)]
    long = F.sqrt(sum((z * z for z in scaled), F.lit(1e-12)))
    whole = lambda z: F.floor(z * 1024) / 1024  # noqa: E731 (so that sums are exact)
    squashed = points.join(spread, "cell").select("cell", *(whole(F.tanh(z)).alias(f"t{k}") for k, z in enumerate(scaled)), *(whole(z / long).alias(f"u{k}") for k, z in enumerate(scaled)))
    products = squashed.groupBy("cell").agg(*(F.sum(F.col(f"{w}{i}") * F.col(f"{w}{j}")).alias(f"{w}{i}_{j}") for w in "tu" for i, j in PAIRS))
    known = products.join(spread, "cell").withColumn("start", F.lit(0))

    def begin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            table = batch.to_pandas()
            mean = table[[f"m{k}" for k in range(D)]].to_numpy(float)
            scale = table[[f"d{k}" for k in range(D)]].to_numpy(float)
            for start, kind in enumerate(("", "t", "u")):
                correlation = np.tile(np.eye(D), (len(table), 1, 1))
                if kind:
                    for i, j in PAIRS:
                        both = np.sqrt(np.maximum(table[f"{kind}{i}_{i}"] * table[f"{kind}{j}_{j}"], 1e-9)).to_numpy(float)
                        correlation[:, i, j] = correlation[:, j, i] = 0.95 * table[f"{kind}{i}_{j}"].to_numpy(float) / both if i < j else 1.0
                column = batch.set_column(batch.schema.get_field_index("start"), "start", pa.array(np.full(len(table), start), pa.int32()))
                yield _state(column, mean, correlation * scale[:, :, None] * scale[:, None, :])

    return known.mapInArrow(begin, STATE)


def estimates(points: DataFrame, share: float = 0.75, gain: float = 1e-3, most_steps: int = 40) -> DataFrame:
    """cell, mean, inverse, logdet: minimum-covariance-determinant centre and inverse scatter of each cell of `points` (cell, x0..), over all its rows.

    From each of three starts it concentrates: the `share` of a cell's rows nearest to the last estimate give the next one, which
    is taken as long as its log-determinant is smaller, until none gains `gain`; the start with the smallest
    determinant wins. A step is one aggregation over (cell, start, level of distance) with sums of coordinates and of products,
    then running sums over a cell's few hundred levels, so a cell of any size is summed where its rows lie and none is gathered in a task.
    The levels are 1/32 of a doubling apart; the level on which the share is full counts as a whole, so rows tied in distance
    are in or out together. Coordinates are multiples of 1/1024, so sums are exact and
    reruns agree. The least deviations of FEATURES are added to every scatter, so that a cell of equal rows has one.
    """
    zero = F.struct(F.lit(0).cast("long").alias("n"), *(F.lit(0.0).alias(c) for c in MOMENTS[1:]))
    add = lambda a, x: F.when(a["n"] >= F.ceil(F.lit(share) * F.col("all")), a).otherwise(F.struct(*((a[c] + x[c]).alias(c) for c in MOMENTS)))
    known = written(_starts(points).withColumn("moved", F.lit(True)), "starts")
    for step in range(most_steps):
        open_ = known.where("moved").select("cell", "start", "mean", "inverse", "logdet")
        found = measured(open_)
        if not found[0]:
            break
        open_ = small_or_not(open_, found=found)
        levels = points.join(open_.select("cell", "start", "mean", "inverse"), "cell").groupBy("cell", "start", F.floor(F.log2(1 + distance()) * 32).alias("level")).agg(*_moments())
        # sums up to the level that fills the share: the smallest level with enough rows up to it
        nearest = F.array_sort(F.collect_list(F.struct("level", *MOMENTS)))
        folded = levels.groupBy("cell", "start").agg(F.sum("n").alias("all"), nearest.alias("levels"))
        new = _fit(folded.select("cell", "start", F.aggregate("levels", zero, add).alias("sum")).select("cell", "start", "sum.*"), share)
        old = known.select("cell", "start", *(F.col(c).alias(f"old_{c}") for c in ("mean", "inverse", "logdet")))
        # the starts' own determinants belong to no rows, so the first step is always taken
        better = F.col("logdet") < F.col("old_logdet") if step else F.col("logdet").isNotNull()
        known = old.join(new, ["cell", "start"], "left").select(
            "cell", "start", *(F.when(better, F.col(c)).otherwise(F.col(f"old_{c}")).alias(c) for c in ("mean", "inverse", "logdet")),
            F.coalesce(better & (F.col("logdet") < F.col("old_logdet") - gain) if step else better, F.lit(False)).alias("moved"),
        )
        known = written(known, f"mcd-{step}")
    best = known.groupBy("cell").agg(F.min_by(F.struct("mean", "inverse", "logdet"), F.struct("logdet", "start")).alias("best"))
    return written(best.select("cell", "best.*"), "mcd")


def judged(docs: DataFrame, text_col: str = "text", tail: float = 1e-12, shrink: float = 40.0, least_rows: int = 100, share: float = 0.75) -> DataFrame:
    """doc_id, key, COUNTS, base_failed, cell, distance, kept for each row of `docs` (doc_id, text, lang, source).

    base_failed: under 50 words, or over half the words in repeated three-word windows. The others are
    points (FEATURES); each (lang, source) with `least_rows` of them is a cell with an estimate of its own;
    smaller ones pool by language, and those that are still smaller are judged by the estimate of all points.
    A row is an outlier if its squared distance, times n / (n + shrink) for n words as short
    texts vary more, exceeds the chi-square quantile that leaves `tail` above it: so far out that of ordinary rows, whose
    statistics have longer tails than the normal law, none is, whatever the size of the corpus.

    Null text counts as empty (base_failed). Null lang and source are values of their own. Rows tied in distance are judged alike, and so
    are repeated rows, each in its row. A very long text is counted whole, one row at a time. An empty table gives no rows.
    Other columns are ignored, whatever their names.
    """
    counted = written(with_counts(docs, text_col).withColumn("base_failed", base_failed()), "counts")
    part = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c)), F.lit("-"))
    passed = counted.where(~F.col("base_failed"))
    sizes = passed.groupBy(part("lang").alias("l"), part("source").alias("s")).agg(F.count(F.lit(1)).alias("n"))
    # a language's small sources pool
    small = F.col("n") < least_rows
    by_lang = sizes.groupBy("l").agg(F.sum(F.when(small, F.col("n")).otherwise(0)).alias("pooled"))
    cell = F.when(~small, F.concat_ws("\x1f", "l", "s")).when(F.col("pooled") >= least_rows, F.col("l")).otherwise(F.lit("*"))
    cells = sizes.join(by_lang, "l").select("l", "s", cell.alias("cell"))
    cells = small_or_not(written(cells, "cells"))
    points = passed.join(cells, (part("lang") == F.col("l")) & (part("source") == F.col("s"))).select(
        F.explode(F.array_distinct(F.array("cell", F.lit("*")))).alias("cell"), *((F.floor(F.expr(c) * 1024) / 1024).alias(x) for x, (c, _) in zip(X, FEATURES.values(), strict=True))
    )
    points = written(points, "points")
    known = small_or_not(estimates(points, share))
    squared = distance() * F.col("n_words") / (F.col("n_words") + shrink)
    # the verdict follows from the row itself, so it is computed where the row is
    limit = F.lit(chi2_quantile(1 - tail, D))
    return (
        counted.join(cells, (part("lang") == F.col("l")) & (part("source") == F.col("s")) & ~F.col("base_failed"), "left")
        .join(known.select("cell", "mean", "inverse"), "cell", "left")
        .select("*", *((F.floor(F.expr(c) * 1024) / 1024).alias(x) for x, (c, _) in zip(X, FEATURES.values(), strict=True)))
        .withColumn("distance", F.when(~F.col("base_failed"), squared))
        .select("doc_id", "key", *COUNTS, "base_failed", "cell", "distance", (~F.col("base_failed") & (F.coalesce("distance", F.lit(0.0)) <= limit)).alias("kept"))
    )


def filter_quality(docs: DataFrame, **options) -> DataFrame:
    """The rows of `docs` that `judged` keeps, with their columns, whatever their names.

    The rejected keys are broadcast if few, else joined by a shuffle. Null, empty and long texts, ties and repeated rows fare as in
    `judged`; rows of one id and text go together. An empty table gives no rows.
    """
    text = options.get("text_col", "text")
    bad = written(judged(docs, **options).where(~F.col("kept")).select(F.coalesce(F.col("doc_id").cast("string"), F.lit("-")).alias("id"), "key").distinct(), "rejected")
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.coalesce(F.col("doc_id").cast("string"), F.lit("-")).alias("id"), F.xxhash64(text).alias("key"))
    return rows.join(small_or_not(bad), ["id", "key"], "left_anti").select("row.*")
