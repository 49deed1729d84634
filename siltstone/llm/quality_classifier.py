"""Quality by regularised quadratic discriminants over statistics of a text."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .memo import released
from .quality import CAPITALS, PUNCTUATION, SPACES, SYMBOLS, repeated_words
from .store import small_or_not, written

DIGITS = b"0123456789"
OTHERS = re.compile(rb"[^\x00-\x7f]+")
#: The transformed statistics of a text, all of bounded size.
STATISTICS = (
    "log_words", "word_length", "distinct", "repeats", "dup_lines", "lines", "symbols", "capitals", "punctuation", "digits", "marked", "longest", "commonest", "letters",
)
D = len(STATISTICS)
PAIRS = [(i, j) for i in range(D) for j in range(i, D)]


def statistics_of(text: str | None) -> tuple[float, ...]:
    """STATISTICS of a text; null is an empty text. Counts are per word or per character, under roots or logarithms, so a few large ones don't rule the covariance."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    words = raw.split()
    if not words:
        return (0.0,) * D
    n, size = len(words), sum(map(len, words))
    lines = [x for x in text.split("\n") if x.strip(SPACES)]
    counted: dict[bytes, int] = {}
    for w in words:
        counted[w] = counted.get(w, 0) + 1
    bare = raw.translate(None, PUNCTUATION)
    symbols = sum(text.count(c) for c in SYMBOLS)
    capitals = len(raw) - len(raw.translate(None, CAPITALS))
    marked = sum(not w[-1:].isalnum() and w[-1] < 128 for w in words)
    other = sum(map(len, OTHERS.findall(raw)))
    return (
        np.log2(1 + n) / 4,
        np.log2(1 + size / n),
        np.sqrt(len(counted) / n),
        np.sqrt(repeated_words(words) / n),
        np.sqrt((len(lines) - len(set(lines))) / len(lines)),
        np.log2(1 + n / len(lines)) / 4,
        np.log2(1 + symbols / n),
        np.sqrt(capitals / size),
        np.log2(1 + (len(raw) - len(bare)) / n),
        np.sqrt((len(raw) - len(raw.translate(None, DIGITS))) / size),
        np.sqrt(marked / n),
        np.log2(1 + max(map(len, words))) / 4,
        np.sqrt(max(counted.values()) / n),
        np.sqrt(other / size),
    )


def with_statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and x0.. (STATISTICS) of each row; no shuffle, and the text stays behind."""
    kind = pa.float64()

    @released
    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array([statistics_of(t.as_py()) for t in batch.column(1)], float).reshape(-1, D)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x[:, k], kind) for k in range(D))], names=["doc_id", *(f"x{k}" for k in range(D))])

    picked = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    return picked.mapInArrow(measure, "doc_id long, " + ", ".join(f"x{k} double" for k in range(D)))


@dataclass(frozen=True)
class Discriminant:
    """Of classes 0 and 1: mean, Cholesky factor of the shrunk covariance, log-determinant and log share of rows; None where nothing was learned."""

    means: np.ndarray
    factors: np.ndarray
    log_dets: np.ndarray
    log_priors: np.ndarray

    def log_density(self, x: np.ndarray, c: int) -> np.ndarray:
        """Log density of class `c` by its Mahalanobis distance, up to a constant: forward substitution with the factor at hand."""
        off = x - self.means[c]
        for k in range(x.shape[1]):
            off[:, k] = (off[:, k] - off[:, :k] @ self.factors[c][k, :k]) / self.factors[c][k, k]
        return self.log_priors[c] - 0.5 * ((off * off).sum(axis=1) + self.log_dets[c])

    def score(self, x: np.ndarray) -> np.ndarray:
        """0 to 1, over 0.5 where class 1 is the denser: the logistic function of the difference, over the number of statistics so that few are 0 or 1 exactly."""
        difference = (self.log_density(x, 1) - self.log_density(x, 0)) / x.shape[1]
        return 1 / (1 + np.exp(-np.clip(difference, -700, 700)))


def discriminant(moments: dict[int, tuple[int, np.ndarray, np.ndarray]], shrink: float, floor: float) -> Discriminant | float:
    """From number, mean and covariance of each class. Without rows of one class, the other's label; without any, 0.5.

    A class covariance is shrunk towards the pooled one, the more the fewer rows it has against the statistics, by at least `shrink`; that towards its own
    diagonal by `shrink`. `floor` is a standard deviation added to each statistic, so that constant ones don't decide.
    """
    if len(moments) < 2:
        return float(*moments) if moments else 0.5
    total = sum(n for n, _, _ in moments.values())
    pooled = sum(n * cov for n, _, cov in moments.values()) / total
    pooled = (1 - shrink) * pooled + shrink * np.diag(np.diag(pooled)) + floor**2 * np.eye(len(pooled))
    means, factors, dets, priors = [], [], [], []
    for c in (0, 1):
        n, mean, cov = moments[c]
        alpha = max(shrink, len(mean) / (len(mean) + n))
        factor = np.linalg.cholesky((1 - alpha) * (cov + floor**2 * np.eye(len(mean))) + alpha * pooled)
        means.append(mean)
        factors.append(factor)
        dets.append(2 * np.log(np.diag(factor)).sum())
        priors.append(np.log(n / total))
    return Discriminant(np.array(means), np.array(factors), np.array(dets), np.array(priors))


def class_moments(labelled: DataFrame) -> dict[int, tuple[int, np.ndarray, np.ndarray]]:
    """Number, mean and covariance (divisor n) of x0.. by `label`. Sums are taken about the mean, which one row a class brings back first."""
    x = [f"x{k}" for k in range(D)]
    centres = labelled.groupBy("label").agg(F.count(F.lit(1)).alias("n"), *(F.avg(c).alias(c) for c in x)).collect()  # two rows
    if not centres:
        return {}

    def centred(c: str) -> Column:
        return F.col(c) - F.element_at(F.create_map(*(F.lit(v) for r in centres for v in (r["label"], r[c]))), F.col("label"))

    off = labelled.select("label", *(centred(c).alias(c) for c in x))
    sums = off.groupBy("label").agg(*(F.avg(F.col(f"x{i}") * F.col(f"x{j}")).alias(f"p{i}_{j}") for i, j in PAIRS)).collect()  # two rows
    found = {}
    for r in sums:
        cov = np.zeros((D, D))
        for i, j in PAIRS:
            cov[i, j] = cov[j, i] = r[f"p{i}_{j}"]
        own = next(c for c in centres if c["label"] == r["label"])
        found[r["label"]] = own["n"], np.array([own[c] for c in x]), cov
    return found


def fit(measured: DataFrame, labels: DataFrame, shrink: float = 0.05, floor: float = 0.02) -> Discriminant | float:
    """Learn from rows of `measured` (a written table) whose doc_id has a label: an id with both labels teaches nothing, one with repeated labels as if it had one.

    All labelled rows are learned from, as sums by class. Null ids and labels other than 0 and 1 teach nothing.
    """
    known = labels.where("doc_id is not null and quality in (0, 1)").groupBy("doc_id").agg(F.min("quality").cast("int").alias("label"), F.max("quality").alias("most"))
    known = small_or_not(written(known.where("label = most").select("doc_id", "label"), "labels"))
    joined = written(measured.where("doc_id is not null").join(known, "doc_id").select("label", *(f"x{k}" for k in range(D))), "labelled")
    return discriminant(class_moments(joined), shrink, floor)


def predict(measured: DataFrame, model: Discriminant | float) -> DataFrame:
    """doc_id, score, predicted (1 from a score of 0.5 on); no shuffle."""
    held = measured.sparkSession.sparkContext.broadcast(model)  # two factors of D by D

    @released
    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = held.value
        for batch in batches:
            x = np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns[1:]], axis=1).astype(float)
            score = np.full(len(x), model) if isinstance(model, float) else model.score(x)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score), pa.array((score >= 0.5).astype(np.int32))], names=["doc_id", "score", "predicted"])

    return measured.select("doc_id", *(f"x{k}" for k in range(D))).mapInArrow(judge, "doc_id long, score double, predicted int")


def held_out(doc_id: Column) -> Column:
    """Whether crc32 of the id as text leaves 1 when divided by 3; a null id counts as an empty text."""
    return F.crc32(F.encode(F.coalesce(doc_id.cast("string"), F.lit("")), "UTF-8")) % 3 == 1


def predict_all(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """doc_id, held_out, score, predicted of each row of `docs`; learned from the labels of ids that aren't held out.

    Null and empty texts have statistics of 0 and a score like others. A very long text is measured whole, as one unit of work. Repeated rows
    repeat. Without labels of one class all scores are the other's label, without any 0.5. An empty table gives no rows; other columns are ignored,
    whatever their names.
    """
    measured = written(with_statistics(docs), "statistics")
    model = fit(measured, labels.select("doc_id", "quality").where(~held_out(F.col("doc_id"))), **options)
    return predict(measured, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")
