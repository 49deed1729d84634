"""Whitening of embeddings: moments by Chan's merging in a tree, eigenvectors on the driver, and a second pass that verifies the identity."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .memo import released

#: An entry c becomes floor(SCALE * c) + SHIFT.
SCALE, SHIFT = 64, 1_000_000
#: Rows that are worked on at a time in a task, and components returned.
ROWS, COMPONENTS = 4096, 32
#: From this size on, a scaled entry is no exact whole number.
LARGEST = 2.0**52
#: States that a level of the tree merges into about the square root of their number.
DEPTH = 2


@dataclass
class Moments:
    """Number of rows, exact sums of whole entries (or None), mean, and centred scatter."""

    n: int
    sums: list[int] | None
    mean: np.ndarray
    scatter: np.ndarray

    @classmethod
    def of(cls, x: np.ndarray, whole: bool) -> Moments:
        mean = x.mean(axis=0)
        off = x - mean
        mean += off.mean(axis=0)  # what rounding left
        off = x - mean
        return cls(len(x), [sum(map(int, c)) for c in x.T] if whole and np.abs(x).max(initial=0) >= 2.0**40 else x.sum(axis=0).astype(np.int64).tolist() if whole else None, mean, off.T @ off)

    def merged(self, other: Moments) -> Moments:
        """Chan, Golub and LeVeque: the scatters, and what the means lie apart."""
        n = self.n + other.n
        apart = other.mean - self.mean
        scatter = self.scatter + other.scatter + np.outer(apart, apart) * (self.n * other.n / n)
        sums = None if self.sums is None else [a + b for a, b in zip(self.sums, other.sums, strict=True)]
        return Moments(n, sums, self.mean + apart * (other.n / n), scatter)


def _both(a: Moments | None, b: Moments | None) -> Moments | None:
    return b if a is None else a if b is None else a.merged(b)


@dataclass(frozen=True)
class Whitener:
    """n and exact sums of the rows (less SHIFT each), and by component (columns) unit eigenvector and eigenvalue; trace of all."""

    n: int
    sums: list[int]
    vectors: np.ndarray
    values: np.ndarray
    trace: float

    @property
    def size(self) -> int:
        return len(self.sums)

    def whiten(self, y: np.ndarray) -> np.ndarray:
        """Rows projected on each component, over the root of its eigenvalue; NaN for a component without variance."""
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.where(self.values > 0, (y - self.mean) @ self.vectors / np.sqrt(self.values), np.nan)

    @property
    def mean(self) -> np.ndarray:
        return np.array([s // self.n + s % self.n / self.n for s in self.sums])

    def deviations(self, y: np.ndarray) -> list[int | None]:
        """Sum over dimensions of (n * entry - sum) squared, exactly; None where it is no 64-bit number."""
        sums = np.array(self.sums, object)
        most = max((self.n * int(np.abs(y).max(initial=0)) + max(map(abs, self.sums), default=0)), 1)
        if most * most * max(self.size, 1) < 2**63:
            off = y.astype(np.int64) * self.n - sums.astype(np.int64)
            return (off * off).sum(axis=1).tolist()
        off = y.astype(np.int64).astype(object) * self.n - sums
        # an exact sum that needs more than 64 bits has no long
        return [v if v < 2**63 else None for v in map(int, (off * off).sum(axis=1))] if self.size else [0] * len(y)


def whole_vectors(column: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Which rows of a list column hold a vector of `size` finite entries, and floor(SCALE * entry) of those as whole doubles, without SHIFT."""
    lengths = pc.fill_null(pc.list_value_length(column), -1).to_numpy(zero_copy_only=False)
    fits = np.flatnonzero(lengths == size)
    entries = column.take(pa.array(fits)).flatten()
    x = np.floor(entries.cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(len(fits), size) * SCALE)  # a null entry is NaN
    good = (np.abs(x) < LARGEST).all(axis=1)
    use = np.zeros(len(column), bool)
    use[fits[good]] = True
    return use, x[good]


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for k in range(0, batch.num_rows, ROWS):
            yield batch.slice(k, ROWS)


def _merged_moments(vectors: DataFrame, rows_of, whole: bool) -> Moments | None:
    """Moments of what `rows_of` makes of each piece's vectors: one state a partition, merged pairwise in a tree. None without rows."""

    @released
    def states(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = None
        for piece in _pieces(batches):
            x = rows_of(piece.column(0))
            if len(x):
                state = _both(state, Moments.of(x, whole))
        if state is not None:
            sums = [str(s) for s in state.sums or []]
            yield pa.RecordBatch.from_pydict({"n": [state.n], "sums": pa.array([sums], pa.list_(pa.string())), "mean": [state.mean.tobytes()], "scatter": [state.scatter.tobytes()]})

    def state_of(row) -> Moments:
        mean = np.frombuffer(row["mean"])
        return Moments(row["n"], [int(s) for s in row["sums"]] if whole else None, mean, np.frombuffer(row["scatter"]).reshape(len(mean), len(mean)))

    found = vectors.mapInArrow(states, "n long, sums array<string>, mean binary, scatter binary")
    return found.rdd.map(state_of).treeAggregate(None, _both, _both, DEPTH)


def common_size(vectors: DataFrame) -> int | None:
    """The length that most vectors have (of equal numbers the larger); None without vectors."""
    size = F.size("embedding").alias("size")
    top = vectors.where("embedding is not null").groupBy(size).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.desc("size")).first()
    return top["size"] if top else None


def fitted(vectors: DataFrame, components: int = COMPONENTS) -> Whitener | None:
    """The whitener of a table's vectors (`embedding`); None if there are none. One scan; a state (as large as the covariance) a partition goes through the tree."""
    size = common_size(vectors)
    if size is None:
        return None
    state = _merged_moments(vectors, lambda column: whole_vectors(column, size)[1], True)
    if state is None:
        return None
    covariance = state.scatter / state.n
    values, basis = np.linalg.eigh((covariance + covariance.T) / 2)
    order = np.argsort(-values, kind="stable")[:components]
    trace = float(np.trace(covariance))
    # what rounding alone makes of a direction without variance
    kept = np.where(values > size * np.finfo(float).eps * max(values.max(initial=0), 0), values, 0)[order]
    basis = basis[:, order]
    heads = basis[np.argmax(np.abs(basis), axis=0), np.arange(basis.shape[1])] if size else np.ones(len(order))
    return Whitener(state.n, state.sums, basis * np.where(heads < 0, -1, 1), kept, trace)


def identity_error(vectors: DataFrame, whitener: Whitener) -> float:
    """Largest absolute entry of the whitened rows' covariance less the identity, over components with variance: a second pass over all rows."""
    live = whitener.values > 0
    held = vectors.sparkSession.sparkContext.broadcast(whitener)  # a vector a component, at most COMPONENTS

    def rows_of(column: pa.Array) -> np.ndarray:
        y = whole_vectors(column, held.value.size)[1]
        return held.value.whiten(y)[:, live]

    if not live.any():
        return 0.0
    state = _merged_moments(vectors, rows_of, False)
    return float(np.abs(state.scatter / state.n - np.eye(int(live.sum()))).max())


def whitened(table: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error: a row for each usable vector and component, of largest variance first.

    Vectors that are null, hold null or non-finite entries or ones of 2^46 and more in size, or have another length than the commonest (of
    equal numbers the larger) take no part. Repeated rows count and return as often as they stand; null ids stay null. A component
    without variance (equal or too few rows) has null `whitened`, `explained` 0 and no part in `identity_error`. A `deviation` beyond 64 bits
    is null. Eigenvectors of equal eigenvalues are any basis. Tables without usable vectors give no rows; other columns are ignored,
    whatever their names. Three scans without a shuffle of rows; states and what is broadcast depend on the dimension alone.
    """
    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    vectors = table.select(F.col(f"`{vector_col}`").cast("array<double>").alias("embedding"))
    whitener = fitted(vectors, components)
    if whitener is None or not whitener.size:
        return table.sparkSession.createDataFrame([], schema)
    error = identity_error(vectors, whitener)
    held = table.sparkSession.sparkContext.broadcast(whitener)  # a vector a component, at most COMPONENTS
    names = [f.split()[0] for f in schema.split(", ")]

    @released
    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = held.value
        k = len(w.values)
        explained = np.maximum(w.values, 0) / w.trace if w.trace > 0 else np.zeros(k)
        for piece in _pieces(batches):
            use, y = whole_vectors(piece.column(1), w.size)
            m = len(y)
            if not m:
                continue
            ids = piece.column(0).filter(pa.array(use)).take(pa.array(np.repeat(np.arange(m), k)))
            deviation = pa.array(w.deviations(y), pa.int64()).take(pa.array(np.repeat(np.arange(m), k)))
            values = w.whiten(y).ravel()
            columns = [
                ids, pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), pa.array(np.full(m * k, w.n)), deviation,
                pa.array(values, mask=np.isnan(values)), pa.array(np.tile(explained, m)), pa.array(np.full(m * k, error)),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    picked = table.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), F.col(f"`{vector_col}`").cast("array<double>").alias("embedding"))
    return picked.mapInArrow(project, schema)
