"""A gate that admits so many jobs at a time, first come first served: when each job starts and ends."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ordered import in_parts, running


def admitted(jobs: DataFrame, key: str, tie: str, arrival: str, duration: str, slots: int = 2) -> DataFrame:
    """`key`, `tie`, `started`, `ended` of each job: it starts once it has arrived, all earlier jobs of its key have started and a slot is free. Whole numbers throughout.

    Jobs are in order of arrival, then `tie` (unique in a key). A gate with one slot would be idle at times; there any number of slots has done all before, so
    a key is cut at those times, which running sums and maxima over ranges of the key find, and each busy stretch is a unit of work. Null arrivals and
    durations start nothing (null); negative durations count as none. Null keys are one gate.
    """
    fit = F.col(arrival).isNotNull() & F.col(duration).isNotNull()
    kind = jobs.schema[key].dataType.simpleString()
    none = jobs.where(~fit).select(key, tie, F.lit(None).cast("long").alias("started"), F.lit(None).cast("long").alias("ended"))
    order = ["_at", tie]
    timed = jobs.where(fit).select(key, tie, F.col(arrival).cast("long").alias("_at"), F.greatest(F.col(duration).cast("long"), F.lit(0)).alias("_for"))
    # one slot: the end of a job is the work up to it plus the largest of (arrival less the work before it) so far
    worked = running(in_parts(timed, [key], order), [key], order, "sum", F.col("_for"), "_work")
    ends = running(worked, [key], order, "max", F.col("_at") - F.col("_work") + F.col("_for"), "_lead", current=False)
    idle = F.coalesce(F.col("_lead") + F.col("_work") - F.col("_for") <= F.col("_at"), F.lit(True))
    busy = running(ends.withColumn("_idle", idle.cast("long")), [key], order, "sum", F.col("_idle"), "_stretch")
    rows = F.sort_array(F.collect_list(F.struct(*order, "_for"))).alias("rows")
    grouped = busy.groupBy(key, "_stretch").agg(rows).drop("_stretch")

    def serve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            rows, sizes = lists.flatten(), np.diff(lists.offsets.to_numpy())
            at, work = (rows.field(c).to_numpy(zero_copy_only=False).tolist() for c in ("_at", "_for"))
            started, first = [], 0
            for size in sizes.tolist():
                free = [at[first]] * slots
                for k in range(first, first + size):
                    begin = max(at[k], free[0])
                    heapq.heapreplace(free, begin + work[k])
                    started.append(begin)
                first += size
            begins = np.array(started, np.int64)
            keys = batch.column(0).take(pa.array(np.repeat(np.arange(len(sizes)), sizes)))
            yield pa.RecordBatch.from_arrays([keys, rows.field(tie), pa.array(begins), pa.array(begins + np.array(work, np.int64))], names=[key, tie, "started", "ended"])

    tie_kind = jobs.schema[tie].dataType.simpleString()
    return grouped.mapInArrow(serve, f"`{key}` {kind}, `{tie}` {tie_kind}, started long, ended long").unionByName(none)
