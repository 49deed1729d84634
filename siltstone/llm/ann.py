"""Nearest neighbours: score-aware anisotropic quantisation, four-bit table scans, exact reranking of all that the codes cannot rule out."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .memo import released
from .store import small_or_not, written

#: Rows that the codebooks are fitted on, about; dimensions of a subspace; centres of a subspace (four bits).
SAMPLE, WIDTH, CENTRES = 20_000, 1, 16
#: Rows of a shard of codes, and queries of a block; one is scanned against the other. Rows that are coded at a time.
SHARD, QUERIES, CODED = 16_384, 256, 2_048
#: Bytes of a shard's vectors, about; pairs of a query and a row that are scored at a time.
SHARD_BYTES, PAIRS = 8 << 20, 65_536
#: Queries of a wave, and bytes of its vectors, about: what the driver and each worker hold of the queries at once.
WAVE, WAVE_BYTES = 16_384, 32 << 20


@dataclass(frozen=True)
class Codebooks:
    #: subspace, centre, dimension
    centres: np.ndarray
    weight: float


def unit(rows: np.ndarray) -> np.ndarray:
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)


def anisotropic_weight(dimensions: int, least: float) -> float:
    """How much more the residual along a unit vector costs than across it, if only scores above `least` matter."""
    return max(1.0, (dimensions - 1) * least**2 / (1 - least**2))


def assign(x: np.ndarray, books: Codebooks, rounds: int = 3) -> np.ndarray:
    """Centre numbers of unit rows: coordinate descent on |r|^2 + (weight - 1) (x.r)^2 for the residual r of a row x.

    The second term, the residual parallel to the row, couples the subspaces, so they are chosen in
    turn, given the others, from the nearest centres on. Rows are coded CODED at a time, as each takes
    some tables of a float for every centre.
    """
    return np.concatenate([_assign(x[k : k + CODED], books, rounds) for k in range(0, max(1, len(x)), CODED)])


def _assign(x: np.ndarray, books: Codebooks, rounds: int) -> np.ndarray:
    n, m, w = len(x), len(books.centres), books.weight - 1
    # subspace by subspace, so that each step reads one stretch of memory
    parts = np.ascontiguousarray(x.reshape(n, m, -1).transpose(1, 0, 2))
    product = parts @ books.centres.transpose(0, 2, 1)
    along = (parts**2).sum(-1, keepdims=True) - product
    square = along - product + (books.centres**2).sum(-1)[:, None, :]
    row = np.arange(n)
    codes = square.argmin(-1)
    total = sum(along[s, row, codes[s]] for s in range(m))
    for _ in range(rounds):
        for s in range(m):
            rest = total - along[s, row, codes[s]]
            loss = along[s] + rest[:, None]
            loss *= loss
            loss *= w
            loss += square[s]
            codes[s] = loss.argmin(1)
            total = rest + along[s, row, codes[s]]
    codes = codes.T
    return codes.astype(np.uint8)


def fit(sample: np.ndarray, least: float = 0.2, rounds: int = 5, seed: int = 5) -> Codebooks:
    """Codebooks for rows of any norm, fitted on their directions: k-means per subspace, then rounds of anisotropic
    assignment and of the centres that minimise its loss, by least squares with the parallel term."""
    x = unit(sample.astype(np.float64))
    x = np.pad(x, ((0, 0), (0, -x.shape[1] % WIDTH)))
    n, m = len(x), x.shape[1] // WIDTH
    rng = np.random.default_rng(seed)
    parts = x.reshape(n, m, WIDTH)
    centres = np.stack([parts[rng.choice(n, CENTRES, n < CENTRES), s] for s in range(m)])
    weight = anisotropic_weight(x.shape[1], least)
    for k in range(2 * rounds):
        w = weight if k >= rounds else 1.0
        codes = assign(x, Codebooks(centres, w), 2 if w > 1 else 0)
        own = (codes + np.arange(m, dtype=np.int64) * CENTRES).ravel()
        total_of = lambda values: np.bincount(own, values.ravel(), m * CENTRES)  # noqa: B023, E731
        along = ((parts - centres[np.arange(m), codes]) * parts).sum(2)
        rest = along.sum(1, keepdims=True) - along + (parts**2).sum(2)
        # minimise sum |y - v|^2 + (w - 1) (rest + y.(y - v))^2 over v, for each subspace and centre
        count = np.bincount(own, minlength=m * CENTRES)
        left = np.empty((m * CENTRES, WIDTH, WIDTH))
        right = np.empty((m * CENTRES, WIDTH))
        for i in range(WIDTH):
            right[:, i] = total_of(parts[:, :, i]) + (w - 1) * total_of(parts[:, :, i] * rest)
            for j in range(WIDTH):
                left[:, i, j] = (count + 1e-9) * (i == j) + (w - 1) * total_of(parts[:, :, i] * parts[:, :, j])
        found = np.linalg.solve(left, right[:, :, None])[:, :, 0].reshape(m, CENTRES, WIDTH)
        centres = np.where((count > 0).reshape(m, CENTRES, 1), found, centres)
    return Codebooks(centres, weight)


def usable(vector: Column) -> Column:
    """Whether a vector takes part: not null, not empty, all components finite, some not zero."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    return F.coalesce((F.size(vector) > 0) & F.forall(vector, finite) & F.exists(vector, lambda x: x != 0), F.lit(False))


def encoded(rows: DataFrame, books: Codebooks) -> DataFrame:
    """n, vec_ids, codes, along, across, vectors: rows (vec_id, vector of double) in packed shards of at most SHARD rows, in order of id, two codes a byte.

    `along` and `across` are the parts of a decoded row along the row's direction and square to it; vectors are kept as float
    where that loses nothing.
    """
    held = rows.sparkSession.sparkContext.broadcast(books)  # 16 centres a subspace

    @released
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            size = max(1, min(SHARD, SHARD_BYTES // (8 * len(batch.column(1)[0]))))
            for first in range(0, batch.num_rows, size):
                part = batch.slice(first, size)
                ids = np.asarray(part.column(0))
                order = np.argsort(ids, kind="stable")
                vectors = _matrix(part.column(1))[order]
                x = _padded(vectors)
                codes = assign(x, held.value)
                along, across = _parts(x, codes, held.value)
                codes = np.pad(codes, ((0, 0), (0, codes.shape[1] % 2)))
                packed = codes[:, 0::2] << 4 | codes[:, 1::2]
                with np.errstate(over="ignore"):
                    short = vectors.astype(np.float32)
                vectors = short if np.array_equal(short, vectors) else vectors
                yield pa.RecordBatch.from_pydict({"n": [len(ids)]} | {
                    name: pa.array([values.tobytes()], pa.binary())
                    for name, values in {"vec_ids": ids[order], "codes": packed, "along": along, "across": across, "vectors": vectors}.items()
                })

    return rows.select("vec_id", "vector").mapInArrow(encode, "n long, vec_ids binary, codes binary, along binary, across binary, vectors binary")


def _parts(x: np.ndarray, codes: np.ndarray, books: Codebooks) -> tuple[np.ndarray, np.ndarray]:
    along, across = np.empty((2, len(x)), np.float32)
    for k in range(0, len(x), CODED):
        row = x[k : k + CODED]
        decoded = books.centres[np.arange(len(books.centres)), codes[k : k + CODED]].reshape(len(row), -1)
        dot = (row * decoded).sum(1)
        along[k : k + CODED], across[k : k + CODED] = dot, np.linalg.norm(decoded - dot[:, None] * row, axis=1)
    return along, across


def _matrix(column: pa.Array) -> np.ndarray:
    return np.asarray(column.flatten(), np.float64).reshape(len(column), -1)


def _padded(x: np.ndarray) -> np.ndarray:
    x = unit(x)
    return np.pad(x, ((0, 0), (0, -x.shape[1] % WIDTH)))


def best_of(scores: np.ndarray, ids: np.ndarray, top: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and scores of the `top` columns of each row: larger scores first, of equal ones the smaller ids. `ids` is like `scores`, or one row."""
    ids = np.broadcast_to(ids, scores.shape)
    if top < scores.shape[1]:
        line = -np.partition(-scores, top - 1, axis=1)[:, top - 1 : top]
        above, level = scores > line, scores == line
        # of those level with the last place, the smallest ids fill the places left
        want = top - above.sum(1)
        tied = np.flatnonzero(level.sum(1) > want)
        for k in tied.tolist():
            at = np.flatnonzero(level[k])
            level[k] = False
            level[k, at[np.argsort(ids[k, at], kind="stable")[: want[k]]]] = True
        at = np.nonzero(above | level)[1].reshape(len(scores), top)
        scores, ids = np.take_along_axis(scores, at, 1), np.take_along_axis(ids, at, 1)
    order = np.lexsort((ids, -scores))
    return np.take_along_axis(ids, order, 1), np.take_along_axis(scores, order, 1)


def scan(queries: np.ndarray, packed: np.ndarray, books: Codebooks) -> np.ndarray:
    """Approximate scores of the rows for each query, by sums of table entries.

    For two codes in a byte there is one table of 256 sums a query, so a byte costs one look-up.
    """
    m = len(books.centres)
    table = np.einsum("qmd,mcd->qmc", queries.reshape(len(queries), m, WIDTH), books.centres).astype(np.float32)
    if m % 2:
        table = np.concatenate([table, np.zeros((len(table), 1, CENTRES), np.float32)], 1)
    pairs = (table[:, 0::2, :, None] + table[:, 1::2, None, :]).reshape(len(queries), -1, CENTRES * CENTRES)
    scores = np.zeros((len(queries), len(packed)), np.float32)
    for b in range(packed.shape[1]):
        scores += pairs[:, b][:, packed[:, b]]
    return scores


class Vectors:
    """Vectors as they are, by dimension, with their norms; both summed in order of the dimensions, as `exact` does."""

    def __init__(self, x: np.ndarray):
        self.by_dimension = np.ascontiguousarray(x.T, np.float64)
        self.norms = np.sqrt(sum(v * v for v in self.by_dimension))

    def units(self, rows=slice(None)) -> np.ndarray:
        return self.by_dimension[:, rows] / self.norms[rows]

    def cosines(self, rows: np.ndarray, others: Vectors, columns: np.ndarray) -> np.ndarray:
        """Of pairs of a row of this and one of `others`."""
        dot = sum(a[rows] * b[columns] for a, b in zip(self.by_dimension, others.by_dimension, strict=True))
        return dot / (self.norms[rows] * others.norms[columns])


class Best:
    """The `most` best rows that each query has met, best first, no id twice; a place that is free has the score -inf."""

    def __init__(self, queries: int, most: int):
        self.ids, self.scores = np.zeros((queries, most), np.int64), np.full((queries, most), -np.inf)

    def take(self, query: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> None:
        old = self.scores > -np.inf
        query, ids, scores = np.concatenate([np.nonzero(old)[0], query]), np.concatenate([self.ids[old], ids]), np.concatenate([self.scores[old], scores])
        # an id may have several vectors; its best score counts
        order = np.lexsort((-scores, ids, query))
        query, ids, scores = query[order], ids[order], scores[order]
        first = np.ones(len(query), bool)
        first[1:] = (query[1:] != query[:-1]) | (ids[1:] != ids[:-1])
        query, ids, scores = query[first], ids[first], scores[first]
        order = np.lexsort((ids, -scores, query))
        query, ids, scores = query[order], ids[order], scores[order]
        place = np.arange(len(query)) - np.searchsorted(query, query)
        kept = place < self.ids.shape[1]
        self.scores[:] = -np.inf
        self.ids[query[kept], place[kept]], self.scores[query[kept], place[kept]] = ids[kept], scores[kept]


def look_up(asked: Vectors, best: Best, ids: np.ndarray, packed: np.ndarray, along: np.ndarray, across: np.ndarray, rows: Vectors, books: Codebooks, rerank: int) -> None:
    """Bring a block of queries to a shard of rows: `best` then has the best of those that it had and of all rows.

    The codes give approximate scores. A query without enough rows so far scores the `rerank` best exactly. Let t be the last of its
    best scores then: a row whose cosine is t or more has an approximate score of at least along * t - across * sqrt(1 - t^2), as the
    decoded row can turn away from the query by no more than its angle to the row. All rows that reach it are scored exactly.
    """
    most, units = best.ids.shape[1], asked.units()
    approximate = scan(np.pad(units.T, ((0, 0), (0, -len(units) % WIDTH))), packed, books)
    new = np.flatnonzero(best.scores[:, -1] == -np.inf)
    if len(new):
        at = best_of(approximate[new], np.arange(len(ids)), rerank)[0]
        _score(asked, best, ids, rows, np.repeat(new, at.shape[1]), at.ravel())
    least = best.scores[:, -1]
    # sums of floats, each of at most the decoded row's norm
    slack = 2e-7 * (len(books.centres) + 8) * (1 + np.hypot(along, across).max())
    level = np.maximum(least, 0).astype(np.float32)[:, None]
    reach = level * along - np.sqrt(np.maximum(0, 1 - np.maximum(least, 0) ** 2)).astype(np.float32)[:, None] * across - np.float32(slack)
    # the bound holds for angles of up to 90 degrees
    reach[least < 0], reach[:, along < 0] = -np.inf, -np.inf
    left = approximate >= reach
    columns = np.flatnonzero(left.any(0))
    if not len(columns):
        return
    near = units.T @ rows.units(columns)
    near[~left[:, columns]] = -np.inf
    if len(columns) > most and (ids[1:] > ids[:-1]).all():
        least = np.maximum(least, -np.partition(-near, most - 1, axis=1)[:, most - 1])
    # products of matrices are summed in another order
    query, column = np.nonzero((near >= least[:, None] - 1e-9) & (near > -np.inf))
    _score(asked, best, ids, rows, query, columns[column])


def _score(asked: Vectors, best: Best, ids: np.ndarray, rows: Vectors, query: np.ndarray, column: np.ndarray) -> None:
    for k in range(0, len(query), PAIRS):
        q, c = query[k : k + PAIRS], column[k : k + PAIRS]
        best.take(q, ids[c], asked.cosines(q, rows, c))


def distinct_vectors(rows: DataFrame, k: int) -> DataFrame:
    """vec_id, vector, ids of each distinct vector of `rows` (vec_id, vector, h1, h2, no two rows alike): the smallest id that
    has it, and its k + 1 smallest ids in order, which are all that any query can need."""
    same = ["h1", "h2"]
    several = rows.groupBy(same).agg(F.min("vec_id").alias("least"), F.max("vec_id").alias("last")).where("last > least")
    several = small_or_not(written(several.select(*same, "least"), "several"))
    ids = rows.select(*same, "vec_id").join(several.select(*same), same)
    # a limit by rank is applied before the shuffle too, so no task gets all ids of one vector
    ids = ids.withColumn("place", F.row_number().over(Window.partitionBy(*same).orderBy("vec_id"))).where(F.col("place") <= k + 1)
    ids = small_or_not(written(ids.groupBy(same).agg(F.array_sort(F.collect_list("vec_id")).alias("ids")), "ids"))
    index = rows.join(several, same, "left").where("least is null or vec_id = least").join(ids, same, "left")
    return index.select("vec_id", "vector", F.coalesce("ids", F.array("vec_id")).alias("ids"))


def squarable(vector: Column) -> Column:
    """The vector, times a power of two if squares of its components would leave the doubles' range; no cosine changes."""
    largest = F.array_max(F.transform(vector, F.abs))
    factor = F.pow(F.lit(2.0), F.least(-F.floor(F.log2(largest)), F.lit(1000)))
    return F.when(largest.between(1e-100, 1e100), vector).otherwise(F.transform(vector, lambda x: x * factor))


def of_common_length(rows: DataFrame) -> DataFrame:
    """The rows whose vector has the length that most have; of equal numbers the larger."""
    size = F.size("vector").alias("size")
    lengths = rows.groupBy(size).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.desc("size")).limit(2).collect()
    return rows.where(F.size("vector") == lengths[0]["size"]) if len(lengths) > 1 else rows


def search(
    vectors: DataFrame, every: int = 50, k: int = 5, rerank: int = 200, id_col: str = "vec_id", vector_col: str = "embedding"
) -> DataFrame:
    """query_id, rank, vec_id, score: the `k` rows of largest cosine for each query, a row whose id is divisible by `every`.

    The codebooks are fitted on about SAMPLE distinct vectors, chosen by a share of the range of a hash; every vector is
    coded, once for all rows that have it. Codes and vectors stay where they are written: the queries come to them in waves of about WAVE, and a task
    scans its shards against the wave's blocks. First the `rerank` best by the codes are scored exactly on the original vectors, in double
    precision, then all others that the errors of their codes don't rule out (`look_up`), so the result is that of brute force. A task
    keeps the k + 1 best ids of each query; what is left of those is scored once more, and rows of equal vectors
    are told apart by id. At every cut ties go to the smaller id.

    A null id, and a vector that is null, empty, zero or has null or non-finite components, takes no part, nor does one of another length than
    the commonest (of equal numbers the larger). Rows with the query's id are never its answers; other repeated ids are scored one by one and an id
    is answered once. A query whose id has several vectors asks with the one of least hash. With fewer candidates
    than `k` all come; an empty table gives no rows. Other columns are ignored, whatever their names.
    """
    spark, rerank = vectors.sparkSession, max(rerank, k + 1)  # a query's own vector takes a place
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.transform(F.col(vector_col).cast("array<double>"), lambda x: x + F.lit(0.0)).alias("vector"))
    rows = rows.where(F.col("vec_id").isNotNull() & usable(F.col("vector"))).select("vec_id", squarable(F.col("vector")).alias("vector")).select("*", F.xxhash64(F.lit(1), "vector").alias("h1"), F.xxhash64(F.lit(2), "vector").alias("h2"))
    rows = of_common_length(written(rows.dropDuplicates(["vec_id", "h1", "h2"]), "vectors"))
    index = written(distinct_vectors(rows, k), "index")
    total = index.count()
    share = min(1.0, SAMPLE / max(1, total))
    sample = index.where(F.xxhash64("vec_id", "vector").cast("double") / 2.0**64 + 0.5 <= share).select("vector").toArrow().column(0)
    schema = "query_id long, rank int, vec_id long, score double"
    if not len(sample):
        return spark.createDataFrame([], schema)
    books = fit(np.concatenate([_matrix(c) for c in sample.chunks if len(c)]))
    shards = written(encoded(index, books), "codes")
    asked = rows.where(F.col("vec_id") % every == 0).groupBy(F.col("vec_id").alias("query_id")).agg(F.min_by("vector", F.struct("h1", "h2")).alias("query"))
    asked = written(asked, "asked")
    dimensions = len(sample[0])
    waves = max(1, -(-asked.count() // max(1, min(WAVE, WAVE_BYTES // (8 * dimensions)))))
    held = spark.sparkContext.broadcast(books)
    found = None
    for wave in range(waves):
        best = written(_scanned(shards, asked.where(F.pmod(F.xxhash64("query_id"), F.lit(waves)) == wave), held, rerank, k + 1), "best")
        found = best if found is None else found.unionByName(best)
    return exact(found, index, asked, k)


def _scanned(shards: DataFrame, asked: DataFrame, books, rerank: int, most: int) -> DataFrame:
    """query_id, best (structs of -score and vec_id in order, `most` at most) of a wave of queries over all shards."""
    spark = shards.sparkSession
    wave = asked.select("query_id", "query").toArrow()  # WAVE rows, about
    if not wave.num_rows:
        return spark.createDataFrame([], "query_id long, best array<struct<d:double,vec_id:long>>")
    wave = wave.combine_chunks().sort_by("query_id")
    queries = spark.sparkContext.broadcast((np.asarray(wave.column(0)), np.concatenate([_matrix(c) for c in wave.column(1).chunks])))

    @released
    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        query_ids, x = queries.value
        blocks = [(Vectors(x[k : k + QUERIES]), Best(len(x[k : k + QUERIES]), most)) for k in range(0, len(x), QUERIES)]
        for batch in batches:
            for shard in batch.to_pylist():
                ids = np.frombuffer(shard["vec_ids"], np.int64)
                packed = np.frombuffer(shard["codes"], np.uint8).reshape(len(ids), -1)
                along, across = (np.frombuffer(shard[name], np.float32) for name in ("along", "across"))
                kind = np.float32 if len(shard["vectors"]) == 4 * len(ids) * x.shape[1] else np.float64
                rows = Vectors(np.frombuffer(shard["vectors"], kind).reshape(len(ids), -1))
                for block, best in blocks:
                    look_up(block, best, ids, packed, along, across, rows, books.value, rerank)
        for k, (_, best) in enumerate(blocks):
            query, place = np.nonzero(best.scores > -np.inf)
            yield pa.RecordBatch.from_arrays([pa.array(query_ids[k * QUERIES + query]), pa.array(-best.scores[query, place]), pa.array(best.ids[query, place])], names=["query_id", "d", "vec_id"])

    # a query has `most` rows a partition at most, so they meet in one task
    best = shards.mapInArrow(look, "query_id long, d double, vec_id long").repartition("query_id")
    best = best.groupBy("query_id", "vec_id").agg(F.min("d").alias("d"))
    return best.groupBy("query_id").agg(F.slice(F.array_sort(F.collect_list(F.struct("d", "vec_id"))), 1, most).alias("best"))


def exact(best: DataFrame, index: DataFrame, asked: DataFrame, k: int) -> DataFrame:
    """The `k` best of the candidates (query_id, best) by cosine on the original vectors, each told apart in the ids that have it."""
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    candidates = best.select("query_id", F.explode("best.vec_id").alias("vec_id")).distinct()
    cosine = dot(F.col("query"), F.col("vector")) / (F.sqrt(dot(F.col("query"), F.col("query"))) * F.sqrt(dot(F.col("vector"), F.col("vector"))))
    scored = candidates.join(index, "vec_id").join(small_or_not(asked), "query_id").select("query_id", (-cosine).alias("d"), F.explode("ids").alias("vec_id"))
    # an id may have several vectors; its best score counts
    scored = scored.where("vec_id <> query_id").groupBy("query_id", "vec_id").agg(F.min("d").alias("d"))
    top = scored.groupBy("query_id").agg(F.slice(F.array_sort(F.collect_list(F.struct("d", "vec_id"))), 1, k).alias("top"))
    ranked = top.select("query_id", F.posexplode("top").alias("pos", "hit"))
    return ranked.select("query_id", (F.col("pos") + 1).cast("int").alias("rank"), "hit.vec_id", (-F.col("hit.d")).alias("score"))
