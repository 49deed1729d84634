"""Spans that overlap: each one's rank above the earlier spans of its key that it overlaps."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ordered import in_parts, running


def overlap_ranks(spans: DataFrame, key: str, order: list[str], lo: str, hi: str) -> DataFrame:
    """`key`, the columns `order`, and `rank` of each span: 0, or one more than the largest rank of the spans before it (by `order`, which must not tie within a key) that it overlaps by more than a border.

    Ends are whole numbers and may be given either way round; a span of null ends has a null rank. Spans that touch no gap-free stretch of others can't rank each
    other: a key is cut at its gaps, which a running maximum of ends over ranges of the key finds, and each stretch is a unit of work.
    """
    ends = spans.withColumns({"_lo": F.least(lo, hi), "_hi": F.greatest(lo, hi)}).select(key, *order, "_lo", "_hi")
    open_ended = F.col(lo).isNull() | F.col(hi).isNull()
    none = spans.where(open_ended).select(key, *order, F.lit(None).cast("int").alias("rank"))
    sweep = [*("_lo", "_hi"), *order]
    parts = in_parts(ends.where(spans[lo].isNotNull() & spans[hi].isNotNull()), [key], sweep)
    reached = running(parts, [key], sweep, "max", F.col("_hi"), "_reached", current=False)
    cut = F.when(F.col("_reached") > F.col("_lo"), 0).otherwise(1).cast("long")
    stretches = running(reached.withColumn("_cut", cut), [key], sweep, "sum", F.col("_cut"), "_stretch")
    rows = F.sort_array(F.collect_list(F.struct(*order, "_lo", "_hi"))).alias("rows")
    grouped = stretches.groupBy(key, "_stretch").agg(rows).drop("_stretch")
    kinds = {f.name: f.dataType.simpleString() for f in spans.schema.fields}
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in (key, *order)) + ", rank int"

    def rank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            rows = lists.flatten()
            sizes = np.diff(lists.offsets.to_numpy())
            low, high = rows.field("_lo").to_numpy(zero_copy_only=False), rows.field("_hi").to_numpy(zero_copy_only=False)
            ranks = np.zeros(len(low), np.int32)
            for end, size in zip(np.cumsum(sizes), sizes, strict=True):
                if size > 1:
                    ranks[end - size : end] = _ranks(low[end - size : end], high[end - size : end])
            keys = batch.column(0).take(pa.array(np.repeat(np.arange(len(sizes)), sizes)))
            yield pa.RecordBatch.from_arrays([keys, *(rows.field(c) for c in order), pa.array(ranks)], names=[key, *order, "rank"])

    return grouped.mapInArrow(rank, schema).unionByName(none)


def _ranks(low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Ranks of spans in their order. Cells are the ends (even) and what lies between two (odd); a span without length lies on an end and overlaps none of its kind."""
    ends = np.unique(np.concatenate([low, high]))
    first, last = np.searchsorted(ends, low) * 2, np.searchsorted(ends, high) * 2
    top = np.full((2, 2 * len(ends)), -1, np.int32)  # largest rank by cell, of spans with and without length
    ranks = np.zeros(len(low), np.int32)
    for k, (a, b) in enumerate(zip(first.tolist(), last.tolist(), strict=True)):
        if a == b:
            ranks[k] = top[0, a] + 1
            top[1, a] = max(top[1, a], ranks[k])
        else:
            ranks[k] = top[:, a + 1 : b].max() + 1
            np.maximum(top[0, a + 1 : b], ranks[k], out=top[0, a + 1 : b])
    return ranks
