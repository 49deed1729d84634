"""Dictionary-compressed WARC archives: one Zstandard frame a record, the dictionary in a leading skippable frame."""

from __future__ import annotations

import base64
import hashlib
import io
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .memo import released
from .store import make_folder, new_path, opened, small_or_not, write_whole, written

#: Fixed values of the .warc.zst format: the magic number of the skippable frame that holds the dictionary.
DICTIONARY_MAGIC = 0x184D2A5D
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP_HEAD = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n"

#: Bounds of the sample that the dictionary is trained on: records, and bytes of each.
SAMPLE_RECORDS, SAMPLE_BYTES, DICTIONARY_BYTES = 2000, 16_384, 65_536
LEVEL = 6


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def train_dictionary(samples: list[bytes]) -> bytes:
    """A trained dictionary; where the samples are too few or too small to train on, their own text serves as one."""
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-DICTIONARY_BYTES:]


def _record_id(page_id, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}:{digest}')}>"


def _one_line(text: str) -> str:
    return "".join(c if " " < c < "\x7f" else "".join(f"%{b:02X}" for b in c.encode("utf-8", "surrogatepass")) for c in text)


def record(page_id, url, payload: bytes, refers_to, date: str) -> bytes:
    digest = payload_digest(payload)
    http = HTTP_HEAD % len(payload)
    block = http if refers_to is not None else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: {_record_id(page_id, digest)}",
        f"WARC-Date: {date}",
        f"WARC-Target-URI: {_one_line(url or f'urn:page:{page_id}')}",
        f"WARC-Payload-Digest: sha1:{digest}",
        f"X-Payload-Length: {len(payload)}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if page_id is not None:
        head.append(f"X-Page-ID: {page_id}")
    if refers_to is not None:
        head += [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: {_record_id(refers_to, digest)}", f"X-Refers-To-Page-ID: {refers_to}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def write_archives(pages: DataFrame, folder: str, dictionary: bytes, date: str = "2020-01-01T00:00:00Z", file_bytes: int = 256 << 20) -> DataFrame:
    """Write page_id, url, html, refers_to as archives of about `file_bytes`, one or more a task; returns uri, n_records.

    Records are streamed into the open file, so a task holds one batch and one record.
    """
    make_folder(folder)
    held = pages.sparkSession.sparkContext.broadcast(dictionary)  # DICTIONARY_BYTES at most

    @released
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (row for batch in batches for row in zip(*(c for c in batch.columns), strict=True))
        dictionary = zstandard.ZstdCompressionDict(held.value)
        packer = zstandard.ZstdCompressor(level=LEVEL, dict_data=dictionary, write_checksum=True)
        row = next(rows, None)
        while row is not None:
            count = 0

            def body(out):
                nonlocal row, count
                size = out.write(struct.pack("<II", DICTIONARY_MAGIC, len(held.value)) + held.value) or 0
                while row is not None and size < file_bytes:
                    page_id, url, html, refers_to = (v.as_py() for v in row)
                    frame = packer.compress(record(page_id, url, (html or "").encode("utf-8", "surrogatepass"), refers_to, date))
                    out.write(frame)
                    size += len(frame)
                    count += 1
                    row = next(rows, None)

            uri = write_whole(folder, "part.warc.zst", body)
            yield pa.RecordBatch.from_pydict({"uri": [uri], "n_records": [count]})

    return written(pages.select("page_id", "url", "html", "refers_to").mapInArrow(write, "uri string, n_records long"), "warc-files")


def records_in(stream) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and block of each record of an archive, read as a stream."""
    magic, size = struct.unpack("<II", stream.read(8))
    if magic != DICTIONARY_MAGIC:
        raise ValueError("no dictionary frame in front")
    dictionary = zstandard.ZstdCompressionDict(stream.read(size))
    reader = zstandard.ZstdDecompressor(dict_data=dictionary).stream_reader(stream, read_across_frames=True)
    text = io.BufferedReader(reader, 1 << 18)
    while first := text.readline():
        if not first.startswith(b"WARC/"):
            raise ValueError("not a record")
        head = {}
        while (line := text.readline()) != b"\r\n":
            name, _, value = line.decode().partition(":")
            head[name.lower()] = value.strip()
        block = text.read(int(head["content-length"]))
        if text.read(4) != b"\r\n\r\n":
            raise ValueError("a record without its end")
        yield head, block


READ_SCHEMA = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, stored_bytes long"


def read_archives(files: DataFrame) -> DataFrame:
    """One row a record of the archives listed by `uri`; a response whose payload and digest differ raises."""

    @released
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri in batch.column(0).to_pylist():
                store, path = opened(uri)
                rows = []
                with store.open_input_stream(path, compression=None) as stream:
                    for head, block in records_in(stream):
                        digest, kind = head["warc-payload-digest"].removeprefix("sha1:"), head["warc-type"]
                        size, stored = int(head["x-payload-length"]), len(block)
                        if kind == "response":
                            payload = block[block.index(b"\r\n\r\n") + 4 :]
                            if payload_digest(payload) != digest or len(payload) != size:
                                raise ValueError(f"a damaged record in {uri}")
                        number = lambda k: int(head[k]) if k in head else None  # noqa: B023, E731
                        rows.append((number("x-page-id"), head["warc-target-uri"], size, digest, kind, number("x-refers-to-page-id"), stored))
                        if len(rows) == 4096:
                            yield _batch(rows)
                            rows = []
                yield _batch(rows)

    spread = files.select("uri").repartition(max(1, min(files.count(), 10_000)))
    return spread.mapInArrow(read, READ_SCHEMA)


_NAMES = [c.split()[0] for c in READ_SCHEMA.split(", ")]
_TYPES = [pa.string() if c.endswith("string") else pa.int64() for c in READ_SCHEMA.split(", ")]


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [[] for _ in _NAMES]
    return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, _TYPES, strict=True)], names=_NAMES)


def revisits(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """page_id, sha -> refers_to: for each payload of `least_bytes` or more, all rows but those with its smallest page_id.

    The payloads that several pages have are written, so that none of their aggregation stands between the shuffle of a very
    common payload's pages and their join: it is broadcast if small, else adaptive execution can split those pages.
    """
    keyed = pages.where(F.octet_length("html") >= least_bytes).select("page_id", "sha")
    first = keyed.groupBy("sha").agg(F.min("page_id").alias("refers_to"), F.max("page_id").alias("last")).where("last > refers_to")
    first = small_or_not(written(first.select("sha", "refers_to"), "payloads"))
    return keyed.join(first, "sha").where("page_id > refers_to").select("page_id", "sha", "refers_to").distinct()


def samples_of(pages: DataFrame, records: int) -> list[bytes]:
    """Records of about `records` pages for the dictionary, cut to SAMPLE_BYTES: those in a share of the range of a hash, one a payload."""
    share = records / max(records, pages.count())
    at = F.xxhash64("page_id", "sha").cast("double") / 2.0**64 + 0.5
    chosen = pages.where(at <= share).groupBy("sha").agg(F.min(F.struct(F.col("page_id"), F.col("url"), F.substring("html", 1, SAMPLE_BYTES).alias("html"))).alias("page"))
    return [record(r.page_id, r.url, r.html.encode("utf-8", "surrogatepass")[:SAMPLE_BYTES], None, "2020-01-01T00:00:00Z") for r in chosen.select("page.*").sort("page_id", "html").collect()]


def archive(
    spark: SparkSession, pages: DataFrame, folder: str | None = None, least_bytes: int = 0, id_col: str = "page_id", url_col: str = "url", html_col: str = "html"
) -> DataFrame:
    """Write every page as a record and return the archives' uri and n_records.

    Only ids and digests are shuffled. The table of revisits is broadcast to the writers if it has few
    rows, else joined by a shuffle; the html goes from the scan to the archives. The dictionary is trained on a bounded sample:
    the first SAMPLE_BYTES of about SAMPLE_RECORDS records, of distinct payloads. Every record is written whole.

    Null html is an empty payload. A null url becomes urn:page:<id>. A null page_id is never the smallest
    and never a revisit. Rows with the same page_id and payload are all what the first is; of equal payloads the smallest
    page_id wins. A record is held whole while it is written and read. Of an empty table nothing is written. Other columns are
    ignored, whatever their names.
    """
    pages = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.coalesce(F.col(html_col), F.lit("")).alias("html"))
    pages = pages.withColumn("sha", F.sha1(F.encode("html", "UTF-8")))
    again = small_or_not(written(revisits(pages, least_bytes), "revisits"))
    samples = samples_of(pages, SAMPLE_RECORDS)
    joined = pages.join(again, ["page_id", "sha"], "left")
    return write_archives(joined, folder or new_path(spark, "warc"), train_dictionary(samples))


#: A page's digest in DuckDB's SQL: each five hexadecimal digits of SHA-1 give four letters of base 32.
ARCHIVE_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM {pages}),
d AS (SELECT page_id, strlen(h)::BIGINT AS payload_bytes, sha1(h) AS sha FROM p),
f AS (SELECT *, min(page_id) OVER (PARTITION BY sha) AS first FROM d)
SELECT page_id, payload_bytes,
  list_aggregate(list_transform(range(8), lambda i: list_aggregate(list_transform([15, 10, 5, 0],
    lambda b: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (((('0x' || substr(sha, 5 * i::INT + 1, 5))::BIGINT >> b) & 31) + 1)::INT, 1)), 'string_agg', '')), 'string_agg', '') AS payload_digest,
  CASE WHEN page_id > first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id > first THEN first END AS refers_to
FROM f
"""
