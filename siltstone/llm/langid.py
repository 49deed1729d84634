"""Language identification by nearest centroid of TF-IDF n-gram vectors, with rejection by distance."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .memo import released
from .store import small_or_not, written

#: n-grams of so many bytes of the lower-cased text, hashed to so many bins.
SIZES, BIN_BITS = (1, 2, 3, 4), 12
BINS = 1 << BIN_BITS
UNKNOWN = "und"
#: Documents and bytes that are counted at a time in a task.
ROWS, BYTES = 128, 1 << 20


@dataclass(frozen=True)
class Model:
    langs: list[str]
    idf: np.ndarray
    #: one row a centroid, of norm 1; the language of each, and the cosine under which it rejects
    centroids: np.ndarray
    owner: np.ndarray
    floor: np.ndarray


def counts(texts: list[str]) -> np.ndarray:
    """n-gram counts by bin, one row a text. N-grams don't cross texts."""
    raw = [t.lower().encode("utf-8", "surrogatepass") for t in texts]
    joined = np.frombuffer(b"\0".join(raw) + b"\0", np.uint8).astype(np.uint32)
    sizes = np.array([len(r) + 1 for r in raw])
    base = np.repeat(np.arange(len(raw), dtype=np.int64) << BIN_BITS, sizes)
    total = np.zeros(len(raw) << BIN_BITS, np.float32)
    gram = np.zeros(len(joined), np.uint32)
    ok = np.ones(len(joined), bool)
    for n in range(1, max(SIZES) + 1):
        shifted = joined[n - 1 :]
        gram = gram[: len(shifted)] << np.uint32(8) | shifted
        ok = ok[: len(shifted)] & (shifted != 0)
        if n in SIZES:
            bins = (gram * np.uint32(2654435761) + np.uint32(n * 0x9E3779B1 & 0xFFFFFFFF)) * np.uint32(0x85EBCA6B) >> np.uint32(32 - BIN_BITS)
            total += np.bincount((base[: len(shifted)] + bins)[ok], minlength=len(total))
    return total.reshape(len(raw), BINS)


def _weighed(tf: np.ndarray, idf: np.ndarray) -> np.ndarray:
    x = np.log1p(tf) * idf
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def _pieces(texts: list[str]) -> Iterator[tuple[int, list[str]]]:
    """Runs of about ROWS texts and BYTES bytes; a longer text is a run of its own."""
    first, size = 0, 0
    for k, t in enumerate(texts):
        if k > first and (k - first >= ROWS or size + len(t) > BYTES):
            yield first, texts[first:k]
            first, size = k, 0
        size += len(t)
    if texts:
        yield first, texts[first:]


def clusters(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Spherical k-means from a farthest-first start; fewer centroids if there are fewer rows."""
    mean = x.mean(axis=0)
    chosen = [int(np.argmax(x @ mean))]
    near = x @ x[chosen[0]]
    while len(chosen) < min(k, len(x)):
        chosen.append(int(np.argmin(near)))
        near = np.maximum(near, x @ x[chosen[-1]])
    centres = x[chosen]
    for _ in range(rounds):
        own = np.argmax(x @ centres.T, axis=1)
        sums = np.stack([x[own == c].sum(axis=0) if (own == c).any() else centres[c] for c in range(len(centres))])
        centres = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-12)
    return centres


def _counted(usable: DataFrame) -> DataFrame:
    """A written table of one pass over lang and text: lang, hash of each text (once a batch), and a row a task with `seen`, its number of texts by bin and, last, of all."""

    @released
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(BINS + 1, np.int64)
        kinds = pa.schema([("lang", pa.string()), ("hash", pa.int64()), ("seen", pa.list_(pa.int64()))])
        for batch in batches:
            for _, run in _pieces(batch.column(2).to_pylist()):
                seen[:BINS] += (counts(run) > 0).sum(axis=0)
                seen[BINS] += len(run)
            kept = pa.table(batch.columns[:2], names=["lang", "hash"]).group_by(["lang", "hash"]).aggregate([])
            yield from kept.append_column("seen", pa.nulls(len(kept), kinds.field("seen").type)).cast(kinds).to_batches()
        if seen[BINS]:
            yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.string()), pa.nulls(1, pa.int64()), pa.array([seen.tolist()])], schema=kinds)

    return written(usable.select("lang", F.xxhash64("text").alias("hash"), "text").mapInArrow(count, "lang string, hash long, seen array<long>"), "counted")


def _frequencies(counted: DataFrame) -> tuple[int, np.ndarray]:
    """Number of all texts, and by bin of those that have an n-gram there."""
    by_bin = counted.select(F.posexplode("seen").alias("bin", "n")).groupBy("bin").agg(F.sum("n").alias("n")).toPandas()  # BINS rows and one
    seen = np.zeros(BINS + 1, np.int64)
    seen[by_bin["bin"].to_numpy(int)] = by_bin["n"].to_numpy(np.int64)
    return int(seen[BINS]), seen[:BINS]


def sampled(usable: DataFrame, per_lang: int, counted: DataFrame | None = None) -> DataFrame:
    """lang, text: of each language the `per_lang` distinct texts of least hash, or all if it has fewer.

    Only the part of the hashes' range that holds about four times as many of the language's distinct texts is ranked, so neither a
    language nor a text of any number of rows fills a task.
    """
    hashes = usable.select("lang", F.xxhash64("text").alias("hash")) if counted is None else counted.where("hash is not null").select("lang", "hash")
    keys = written(hashes.distinct(), "keys")
    shares = keys.groupBy("lang").agg((F.lit(4.0 * per_lang) / F.count(F.lit(1))).alias("share"))
    low = keys.join(small_or_not(written(shares, "shares")), "lang").where(F.col("hash").cast("double") / 2.0**64 + 0.5 <= F.col("share"))
    least = low.withColumn("place", F.row_number().over(Window.partitionBy("lang").orderBy("hash"))).where(F.col("place") <= per_lang)
    least = small_or_not(written(least.select("lang", "hash"), "sample"))
    return usable.select("lang", "text", F.xxhash64("text").alias("hash")).join(least, ["lang", "hash"], "left_semi").groupBy("lang", "hash").agg(F.min("text").alias("text"))


def fit(labelled: DataFrame, per_lang: int = 500, k: int = 4, slack: float = 0.5) -> Model:
    """Learn from text and lang of `labelled` (rows with both and a letter in the text).

    idf is counted over all rows. Centroids are learned from `per_lang` distinct texts of each language (`sampled`), which come to
    the driver as sparse counts; every language that has a usable row is learned. A language has up to `k` centroids;
    a centroid rejects what is less similar to it than `slack` times the least similar of its own rows.

    Rows of null text or lang teach nothing. Repeated rows count in idf and are one text for the centroids. Of no rows nothing is learned.
    Equal cosines in clustering go to the earlier centroid. Other columns are ignored.
    """
    usable = labelled.where(F.col("text").isNotNull() & F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}")).select("lang", "text")
    counted = _counted(usable)
    total, seen = _frequencies(counted)
    if not total:
        return Model([], np.zeros(BINS), np.zeros((0, BINS), np.float32), np.zeros(0, int), np.zeros(0))
    idf = (np.log((1 + total) / (1 + seen)) + 1).astype(np.float32)

    @released
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for first, run in _pieces(texts):
                bins, values = [], []
                for row in counts(run):
                    at = np.flatnonzero(row)
                    bins.append(at.astype(np.int16).tobytes())
                    values.append(row[at].tobytes())
                yield pa.RecordBatch.from_pydict({"lang": langs[first : first + len(run)], "bins": pa.array(bins, pa.binary()), "counts": pa.array(values, pa.binary())})

    chosen = sampled(usable, per_lang, counted).select("lang", "text").mapInArrow(count, "lang string, bins binary, counts binary").collect()
    by_lang: dict[str, list] = {}
    for r in sorted(chosen, key=lambda r: (r["lang"], bytes(r["bins"]), bytes(r["counts"]))):
        by_lang.setdefault(r["lang"], []).append(r)
    centroids, owner, floor = [], [], []
    for k_lang, rows in enumerate(by_lang.values()):
        tf = np.zeros((len(rows), BINS), np.float32)  # one language at a time is dense
        for k_row, r in enumerate(rows):
            tf[k_row, np.frombuffer(r["bins"], np.int16)] = np.frombuffer(r["counts"], np.float32)
        own = _weighed(tf, idf)
        centres = clusters(own, k)
        close = own @ centres.T
        for c in range(len(centres)):
            members = close[np.argmax(close, axis=1) == c, c]
            centroids.append(centres[c])
            owner.append(k_lang)
            floor.append(slack * float(members.min()) if len(members) else 1.0)
    return Model(list(by_lang), idf, np.array(centroids, np.float32), np.array(owner), np.array(floor))


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred (the nearest centroid's language), score (its cosine, 0 to 1), rejected; no shuffle.

    A text that is null or has no letters is `und` with score 0 and rejected, and so is any where nothing was learned. Equal
    cosines go to the first language in order. A long text is counted whole, as a run of its own. Repeated rows repeat; an
    empty table gives no rows. Other columns are ignored, whatever their names.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)  # centroids of the learned languages, 16 KB each

    @released
    def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = held.value
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            langs, scores, out = [UNKNOWN] * len(texts), np.zeros(len(texts)), np.ones(len(texts), bool)
            known = [k for k, t in enumerate(texts) if any(map(str.isalpha, t))] if model.langs else []
            for first, run in _pieces([texts[k] for k in known]):
                cosine = _weighed(counts(run), model.idf) @ model.centroids.T
                for k, row, best in zip(known[first : first + len(run)], cosine, np.argmax(cosine, axis=1), strict=True):
                    langs[k], scores[k], out[k] = model.langs[model.owner[best]], min(1.0, max(0.0, float(row[best]))), row[best] < model.floor[best]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(langs), pa.array(scores), pa.array(out)], names=["doc_id", "lang_pred", "score", "rejected"])

    picked = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return picked.mapInArrow(name, "doc_id long, lang_pred string, score double, rejected boolean")


def held_out(doc_id: Column) -> Column:
    """Whether crc32 of the id as text is a multiple of 5; a null id counts as an empty text."""
    return F.crc32(F.encode(F.coalesce(doc_id.cast("string"), F.lit("")), "UTF-8")) % 5 == 0


def predict_all(spark: SparkSession, docs: DataFrame, **options) -> DataFrame:
    """Learn from the rows that aren't held out, and predict all: doc_id, held_out, lang_pred, score, rejected.

    Null ids count as an empty text in the fold. The rest is as in `fit` and `predict`.
    """
    model = fit(docs.where(~held_out(F.col("doc_id"))).select("text", "lang"), **options)
    return predict(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "rejected")
