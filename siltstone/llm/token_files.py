"""Token ids in seekable files: independent Zstandard frames, a seek table with checksums behind them."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .bpe import CUTS
from .memo import Memo, released
from .store import make_folder, new_path, opened, write_whole, written

#: Fixed values of the seekable Zstandard format: skippable frames and the table's last four bytes.
SKIPPABLE, SEEK_TABLE, SEEK_END = 0x184D2A50, 0x184D2A5E, 0x8F92EAB1
#: A frame takes documents until its ids have so many bytes; a larger document has a frame of its own.
FRAME_BYTES = 256 << 10
#: Bytes of the texts that are encoded together; a larger text is a run of its own.
RUN_BYTES = 8 << 20
LEVEL = 3


class LibraryEncoder:
    """The tokenizers library over words with the space before them, which its merges never cross, and a bounded memo of words.

    A run of texts is split and its distinct words numbered by Arrow; the library gets the words that the memo
    lacks as one text, whose ids fall apart again before each token that begins with a space.
    """

    def __init__(self, path: str, remembered: int = 400_000):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.by_words = not any(" " in t for t in special)
        size = self.library.get_vocab_size()
        self.kind = np.dtype("<u2" if size <= 1 << 16 else "<u4")
        self.width = self.kind.itemsize
        self.spaced = np.zeros(size, bool)
        for token, number in self.library.get_vocab().items():
            self.spaced[number] = token.startswith("\u0120")  # the letter that stands for a space
        self.memo = Memo(lambda word: self.whole([" " + word])[0], remembered)

    def whole(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(x.ids, self.kind) for x in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def _encoded(self, words: list[str]) -> list[bytes]:
        """Packed ids of words with a space before each, put into the memo."""
        found: list[bytes] = []
        for k in range(0, len(words), 2048):
            some = words[k : k + 2048]
            ids = self.whole(["".join(map(" ".__add__, some))])[0]
            starts = np.flatnonzero(self.spaced[ids])
            if len(starts) == len(some):
                raw, bounds = ids.tobytes(), [*(starts * self.width).tolist(), len(ids) * self.width]
                found += [raw[i:j] for i, j in zip(bounds, bounds[1:], strict=False)]
            else:
                found += [x.tobytes() for x in self.whole([" " + w for w in some])]
        self.memo.put_all(words, found)
        return found

    def encode_all(self, texts: list[str | None]) -> list[bytes]:
        """Packed ids of each text; null is empty. A text with spaces that aren't just one before a word is cut at fewer places."""
        texts = [t or "" for t in texts]
        if not self.by_words:
            return [x.tobytes() for x in self.whole(texts)]
        split = pc.split_pattern(pa.array(texts, pa.large_string()), " ")
        offsets = split.offsets.to_numpy()
        numbered = split.flatten().dictionary_encode()
        index = numbered.indices.to_numpy().astype(np.int64)
        words = numbered.dictionary.to_pylist()
        inner = np.ones(len(index), bool)
        inner[offsets[:-1]] = False
        used = np.zeros(len(words), bool)
        used[index[inner]] = True
        places = np.flatnonzero(used).tolist()
        asked = words if len(places) == len(words) else [words[k] for k in places]
        packed: list[bytes] = [b""] * len(words)
        uneven, new = np.zeros(len(words), bool), []
        for k, word, found in zip(places, asked, map(self.memo.get, asked), strict=True):
            if found is not None:
                packed[k] = found
            elif not word or word[0].isspace():
                uneven[k] = True
            elif (old := self.memo.old.get(word)) is not None:
                packed[k] = old
            else:
                new.append(k)
        fresh = [words[k] for k in new]
        for k, ids in zip(new, self._encoded(fresh), strict=True):
            packed[k] = ids
        # the first word of a text has no space before it, so each is an entry of its own
        packed += [x.tobytes() for x in self.whole([words[k] for k in index[offsets[:-1]]])]
        index[offsets[:-1]] = np.arange(len(words), len(packed))
        sizes = np.fromiter(map(len, packed), np.int64, len(packed)) // self.width
        flat, first = np.frombuffer(b"".join(packed), self.kind), np.cumsum(sizes) - sizes
        of = sizes[index]
        ends = np.cumsum(of)
        small = np.int32 if len(ends) and ends[-1] < 1 << 31 else np.int64
        places = np.repeat((first[index] - ends + of).astype(small), of)
        places += np.arange(len(places), dtype=small)
        tokens = flat[places]
        bounds = np.concatenate([[0], ends])[offsets].tolist()
        out = [tokens[i:j].tobytes() for i, j in zip(bounds, bounds[1:], strict=False)]
        odd = np.zeros(len(index), bool)
        odd[inner] = uneven[index[inner]]
        for k in set((np.searchsorted(offsets, np.flatnonzero(odd), "right") - 1).tolist()):
            first_part, *rest = CUTS.split(texts[k])
            out[k] = b"".join(x.tobytes() for x in self.whole([first_part, *map(" ".__add__, rest)]))
        return out


@lru_cache(maxsize=2)
def library_encoder(path: str) -> LibraryEncoder:
    return LibraryEncoder(path)


def runs(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """The batch in slices of about RUN_BYTES of its second column."""
    ends = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(batch.column(1)), 0), np.int64))
    first = 0
    while first < batch.num_rows:
        before = int(ends[first - 1]) if first else 0
        last = max(first + 1, int(np.searchsorted(ends, before + RUN_BYTES, "right")))
        yield batch.slice(first, last - first)
        first = last


def write_file(out, documents: Iterator[tuple[int | None, bytes]], width: int) -> tuple[int, int]:
    """Frames of whole documents, a frame with the documents' ids and counts, and the seek table. Returns documents and ids written."""
    packer = zstandard.ZstdCompressor(level=LEVEL, write_checksum=True)
    table, ids, counts, held, size = [], [], [], [], 0

    def frame():
        raw = b"".join(held)
        packed = packer.compress(raw)
        out.write(packed)
        table.append((len(packed), len(raw), xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF))
        held.clear()

    for doc_id, packed in documents:
        held.append(packed)
        size += len(packed)
        ids.append(doc_id)
        counts.append(len(packed) // width)
        if size >= FRAME_BYTES:
            frame()
            size = 0
    if held:
        frame()
    index = zstandard.ZstdCompressor(level=LEVEL).compress(
        np.array([x or 0 for x in ids], "<i8").tobytes() + np.array([x is None for x in ids], "u1").tobytes() + np.array(counts, "<u4").tobytes()
    )
    index += struct.pack("<III", len(index), len(ids), width)
    out.write(struct.pack("<II", SKIPPABLE, len(index)) + index)
    rows = b"".join(struct.pack("<III", *row) for row in [*table, (8 + len(index), 0, 0)])
    foot = rows + struct.pack("<IBI", len(table) + 1, 0x80, SEEK_END)
    out.write(struct.pack("<II", SEEK_TABLE, len(foot)) + foot)
    return len(ids), sum(counts)


class TokenFile:
    """Reads documents of a file by position; only the frames that hold them are read and unpacked."""

    def __init__(self, file):
        self.file = file
        end = file.size()
        frames, flags, magic = struct.unpack("<IBI", file.read_at(9, end - 9))
        if magic != SEEK_END or flags != 0x80:
            raise ValueError("no seek table at the end")
        table = np.frombuffer(file.read_at(12 * frames, end - 9 - 12 * frames), "<u4").reshape(-1, 3).astype(np.int64)
        places = np.cumsum(table[:, 0]) - table[:, 0]
        tail = file.read_at(int(table[-1, 0]) - 8, int(places[-1]) + 8)
        size, n, self.width = struct.unpack("<III", tail[-12:])
        index = zstandard.ZstdDecompressor().decompress(tail[: size])
        self.doc_ids = np.frombuffer(index, "<i8", n)
        self.null = np.frombuffer(index, "u1", n, 8 * n).astype(bool)
        self.counts = np.frombuffer(index, "<u4", n, 9 * n).astype(np.int64)
        self.starts = np.cumsum(self.counts) - self.counts
        self.table, self.places = table[:-1], places[:-1]
        self.bases = np.cumsum(self.table[:, 1]) - self.table[:, 1]
        self.unpacker = zstandard.ZstdDecompressor()
        self._last: tuple[int, bytes] = (-1, b"")

    def _frame(self, k: int) -> bytes:
        if self._last[0] != k:
            raw = self.unpacker.decompress(self.file.read_at(int(self.table[k, 0]), int(self.places[k])), max_output_size=int(self.table[k, 1]))
            if xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF != self.table[k, 2]:
                raise ValueError(f"frame {k} is damaged")
            self._last = (k, raw)
        return self._last[1]

    def ids(self, k: int) -> np.ndarray:
        """Ids of the k-th document as unsigned 32-bit integers."""
        if not self.counts[k]:
            return np.zeros(0, "<u4")
        at = int(self.starts[k]) * self.width
        frame = int(np.searchsorted(self.bases, at, "right")) - 1
        return np.frombuffer(self._frame(frame), f"<u{self.width}", int(self.counts[k]), at - int(self.bases[frame])).astype("<u4")


def write_tokens(
    spark: SparkSession, docs: DataFrame, vocabulary: str, end_id: int | None = 2, folder: str | None = None, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Encode each text, append `end_id`, and write the ids in ascending order of id: uri, part, n_docs, n_tokens of each file.

    A range partition by id gives each task a stretch of documents, which it sorts, encodes and streams
    into one file. Null text counts as empty; null ids come first; rows of equal id follow each other in order of a hash of their
    text, by which many of them are dealt to several tasks. A very long text is a run of its own. An empty table gives no file with
    documents. Other columns are ignored, whatever their names.
    """
    folder = folder or new_path(spark, "tokens")
    make_folder(folder)

    @released
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = library_encoder(vocabulary)
        end = b"" if end_id is None else np.array([end_id], f"<u{codec.width}").tobytes()
        made: list[tuple[int, int]] = []
        least = []

        def documents():
            for batch in batches:
                for part in runs(batch):
                    ids = part.column(0).to_pylist()
                    least.extend([] if least else [ids[0], part.column(2)[0].as_py()])
                    yield from zip(ids, (x + end for x in codec.encode_all(part.column(1).to_pylist())), strict=True)

        uri = write_whole(folder, "tokens.zst", lambda out: made.append(write_file(out, documents(), codec.width)))
        if made[0][0]:
            yield pa.RecordBatch.from_pydict({"uri": [uri], "least": pa.array(least[:1], pa.int64()), "least_hash": pa.array(least[1:], pa.int64()), "n_docs": [made[0][0]], "n_tokens": [made[0][1]]})

    keyed = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).withColumn("hash", F.xxhash64("text"))
    ordered = keyed.repartitionByRange("doc_id", "hash").sortWithinPartitions("doc_id", "hash")
    files = written(ordered.mapInArrow(write, "uri string, least long, least_hash long, n_docs long, n_tokens long"), "token-files")
    # one row a file
    before = Window.orderBy(F.col("least").asc_nulls_first(), "least_hash", "uri").rowsBetween(Window.unboundedPreceding, -1)
    return written(files.withColumn("start", F.coalesce(F.sum("n_tokens").over(before), F.lit(0))), "token-files")


def read_tokens(files: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of each document of the files, from their frames."""

    @released
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                store, path = opened(uri)
                with store.open_input_file(path) as handle:
                    file = TokenFile(handle)
                    crcs = np.fromiter((zlib.crc32(file.ids(k)) for k in range(len(file.counts))), np.int64, len(file.counts))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(file.doc_ids, mask=file.null), pa.array(base + file.starts), pa.array(file.counts), pa.array(crcs)],
                    names=["doc_id", "start", "n_tokens", "ids_crc32"],
                )

    spread = files.select("uri", "start").repartition(max(1, min(files.count(), 10_000)))
    return spread.mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")
