"""Files in the folder that the driver and all executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_OWN: list[str] = []
#: Where the paths go that the thread at hand takes; see `taken_paths`.
_TAKEN: ContextVar[list[str] | None] = ContextVar("taken", default=None)


def shared_folder(spark: SparkSession) -> str:
    """The cluster's `spark.checkpoint.dir`. Where it is unset, a folder of our own if driver and executors are one
    process, as in tests; on a cluster that is an error, as executors would write to their own disks."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not _OWN:
        _OWN.append(tempfile.mkdtemp(prefix="siltstone-"))
    return _OWN[0]


#: Bytes of an Arrow batch; a row that is larger is a batch of its own.
BATCH_BYTES = 4 << 20


def small_batches(spark: SparkSession) -> None:
    """Have this session send texts to Python in batches of BATCH_BYTES: executors hold two batches a core, outside their heap, and their workers as many."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def new_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    taken = _TAKEN.get()
    if taken is not None:
        taken.append(path)
    return path


@contextmanager
def taken_paths() -> Iterator[list[str]]:
    """The paths that this thread takes inside the block; those of other threads aren't among them."""
    taken: list[str] = []
    token = _TAKEN.set(taken)
    try:
        yield taken
    finally:
        _TAKEN.reset(token)


def drop_tables(paths: list[str]) -> None:
    """Delete what was written under these paths: for jobs whose result stands elsewhere."""
    for uri in paths:
        store, path = opened(uri)
        if store.get_file_info(path).type == fs.FileType.Directory:
            store.delete_dir(path)


def written(df: DataFrame, name: str) -> DataFrame:
    """`df` as a Parquet table in the shared folder: what follows is recomputed from there, whichever executor is lost."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def opened(uri: str) -> tuple[fs.FileSystem, str]:
    """File system and path of a URI (file, hdfs, s3, gs, ...) or of a plain path."""
    if "://" in uri or uri.startswith("file:"):
        if uri.startswith("file:/") and not uri.startswith("file://"):
            uri = "file://" + uri[len("file:") :]
        return fs.FileSystem.from_uri(uri)
    return fs.LocalFileSystem(), uri


def make_folder(uri: str) -> None:
    store, path = opened(uri)
    store.create_dir(path, recursive=True)


def write_whole(folder: str, name: str, body) -> str:
    """Write a file under a name of this attempt's own and return its URI.

    A retried or speculative task writes another file; only the URI that a successful task returns
    is ever read, so leftovers of lost attempts do no harm.
    """
    uri = f"{folder}/{uuid.uuid4().hex}-{name}"
    store, path = opened(uri)
    with store.open_output_stream(path, compression=None) as out:
        body(out)
    return uri


#: A side with at most so many rows and bytes may be broadcast.
BROADCAST_ROWS, BROADCAST_BYTES = 200_000, 32 << 20


def _bytes(column: Column, kind: T.DataType) -> Column:
    """Bytes of a value, about."""
    if isinstance(kind, T.StringType | T.BinaryType):
        return F.coalesce(F.octet_length(column), F.lit(0)) + 16
    if isinstance(kind, T.ArrayType):
        inner = 8 if isinstance(kind.elementType, T.NumericType | T.BooleanType) else 64
        return F.greatest(F.size(column), F.lit(0)) * inner + 24
    return F.lit(16)


def measured(df: DataFrame) -> tuple[int, int]:
    """Rows and bytes, about, of a table that `written` has made."""
    width = sum((_bytes(F.col(f"`{f.name}`"), f.dataType) for f in df.schema.fields), F.lit(0))
    return df.agg(F.count(F.lit(1)), F.coalesce(F.sum(width), F.lit(0))).first()


def small_or_not(df: DataFrame, rows: int = BROADCAST_ROWS, most_bytes: int = BROADCAST_BYTES, found: tuple[int, int] | None = None) -> DataFrame:
    """`df`, a table that `written` has made, marked for broadcasting if its counted rows and summed bytes (`found`, if they are known) are few; else left
    to a shuffle join, whose large partitions adaptive execution splits."""
    n, size = found or measured(df)
    return df.hint("broadcast") if n <= rows and size <= most_bytes else df
