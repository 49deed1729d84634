"""Periodic runs of words in linear time, after Ellert and Fischer: Lyndon arrays over an ordered alphabet, with extensions that reuse matches."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from .memo import released
from .words import words_of

#: A run has so many words at least, and so many times its period.
LEAST, TIMES = 6, 4


def repetitive_edges(t: list, times: int) -> list[tuple[int, int, int]]:
    """(i, j, e): j is the start of the next smaller suffix after i, t[i:j] the longest Lyndon word at i, and t[i:i+e] = t[j:j+e]; those with e >= times * (j - i).

    `t` ends in an element smaller than all others, which also stands before the first. Each position asks the suffixes on the path of
    previous smaller ones, last first, until one is smaller. What two suffixes share is read off earlier answers: inside the match that
    reaches furthest, from the pair that lies as far before as the match's parts are apart; and on the path, from what the last suffix
    asked shares with both. Elements are compared one by one only beyond that, so each comparison moves the furthest match on or ends a pair.
    """
    n = len(t) - 1
    following, previous = [n] * n, [-1] * n
    to_following, to_previous = [0] * n, [0] * n  # what the suffix shares with these
    first, reached, apart = 0, 0, 0  # t[first:reached] equals what lies `apart` before
    found = []
    for r in range(1, n):
        c, l, before, shared = t[r], r - 1, -1, 0
        while True:
            a = t[l]
            if a == c:
                known = -1
                if before >= 0:
                    other = to_previous[before]
                    if other != shared:
                        known = k = min(other, shared)
                    else:
                        k = shared
                else:
                    k = 1
                if known < 0:
                    if r < reached and l >= first:
                        i, j = l - apart, r - apart
                        e = to_following[i] if following[i] == j else to_previous[j] if previous[j] == i else 0
                        k = max(k, min(e, reached - r))
                    while t[l + k] == t[r + k]:
                        k += 1
                    if r + k >= reached:
                        first, reached, apart = r, r + k, r - l
                if t[l + k] < t[r + k]:
                    previous[r], to_previous[r] = l, k
                    break
                to_following[l], shared = k, k
                if k >= times * (r - l):
                    found.append((l, r, k))
            elif a < c:
                previous[r] = l
                break
            else:
                shared = 0
            following[l], before = r, l
            l = previous[l]
    return found


def extended_left(t: list, edges: list[tuple[int, int, int]]) -> list[int]:
    """For each edge (i, j, ..), in falling order of i, the number of equal elements before i and before j; matches are reused as in `repetitive_edges`."""
    known: dict[int, tuple[int, int]] = {}
    first, last, apart = len(t), len(t), 0  # t[first:last] equals what lies `apart` after
    out = []
    for i, j, *_ in edges:
        k = 0
        if first < i <= last and i + apart in known:
            other, e = known[i + apart]
            if other == j + apart:
                k = min(e, i - first)
        while k < i and t[i - k - 1] == t[j - k - 1]:
            k += 1
        if i - k <= first:
            first, last, apart = i - k, i, j - i
        known[i] = j, k
        out.append(k)
    return out


def runs_of(ids: list[int], least: int = LEAST, times: int = TIMES) -> list[tuple[int, int, int]]:
    """(start, length, period) of each run of at least `least` elements and `times` (3 or more) periods, by start, then period.

    Of a run with so many periods, the Lyndon word at one of its first `period` places is its period in one of the two orders of
    the alphabet, and is followed by `times` - 2 more at least.
    """
    found = set()
    top = max(ids, default=0) + 1
    for t in ([*ids, -1], [*(top - x for x in ids), -1]):
        edges = repetitive_edges(t, times - 2)
        if not edges:
            continue
        edges.sort(reverse=True)
        for (i, j, e), left in zip(edges, extended_left(t, edges), strict=True):
            length = j + e - i + left
            if length >= max(least, times * (j - i)):
                found.add((i - left, length, j - i))
    return sorted(found, key=lambda x: (x[0], x[2]))


def numbered(words: list[bytes]) -> list[int]:
    """Words by number, in order of first occurrence: the ordered alphabet."""
    seen: dict[bytes, int] = {}
    return [seen.setdefault(w, len(seen)) for w in words]


def planted(words: list[bytes], h: int) -> list[bytes]:
    """The words of a document with crc32 `h`: those from a place on made periodic if `h` is a multiple of ten."""
    n, g = len(words), h // 10
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + (words[a : a + p] * ((n - a) // p + 1))[: n - a]


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """The words without those that a run holds after its first period."""
    kept, end = [], 0
    gone: list[tuple[int, int]] = []
    for first, last in sorted((start + period, start + length) for start, length, period in runs):
        if gone and first <= gone[-1][1]:
            gone[-1] = gone[-1][0], max(gone[-1][1], last)
        else:
            gone.append((first, last))
    for first, last in gone:
        kept += words[end:first]
        end = last
    return kept + words[end:] if gone else words


def _sha(raw: bytes) -> str:
    return hashlib.sha256(raw).hexdigest()


def word_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", plant: bool = False) -> DataFrame:
    """doc_id, runs (array of start, length, period, by start, then period) and collapsed (the kept words joined by one space) of each row; no shuffle.

    Null and blank texts have no words, no runs and an empty collapsed text. A text is one unit of work, whatever its length, in time and
    memory linear in its words. Repeated rows give repeated results, an empty table none; other columns are ignored, whatever their names.
    `plant` makes one document of ten periodic first, by the crc32 of its decimal id (a null id is an empty text).
    """
    schema = "doc_id long, runs array<struct<start: long, length: long, period: long>>, collapsed string"
    kind = pa.list_(pa.struct([(c, pa.int64()) for c in ("start", "length", "period")]))

    @released
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            runs, texts = [], []
            for words, found in _found(batch, plant):
                runs.append([{"start": s, "length": m, "period": p} for s, m, p in found])
                texts.append(b" ".join(collapsed(words, found)).decode("utf-8", "surrogatepass"))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(runs, kind), pa.array(texts, pa.string())], names=["doc_id", "runs", "collapsed"])

    return _picked(docs, id_col, text_col).mapInArrow(find, schema)


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", plant: bool = True) -> DataFrame:
    """doc_id, n_runs, start, length, period and exponent_milli of the longest run (ties: least start, then period; null without runs), sha256 of all runs and of the kept words.

    Rows are as in `word_runs`; a text's runs and kept words don't leave their task.
    """
    schema = "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"
    kinds = [pa.int64()] * 5 + [pa.string()] * 2

    @released
    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for words, found in _found(batch, plant):
                start, length, period = min(found, key=lambda x: (-x[1], x[0], x[2])) if found else (None,) * 3
                listed = "".join(f"{s},{m},{p}\n" for s, m, p in found).encode()
                rows.append((len(found), start, length, period, 1000 * length // period if found else None, _sha(listed), _sha(b" ".join(collapsed(words, found)))))
            columns = zip(*rows, strict=True) if rows else [()] * len(kinds)
            made = [pa.array(c, t) for c, t in zip(columns, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *made], names=[f.split()[0] for f in schema.split(", ")])

    return _picked(docs, id_col, text_col).mapInArrow(digest, schema)


def _picked(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.selectExpr(f"cast(`{id_col}` as long) as doc_id", f"`{text_col}` as text")


def _found(batch: pa.RecordBatch, plant: bool) -> Iterator[tuple[list[bytes], list[tuple[int, int, int]]]]:
    """Words and runs of each row of a batch of ids and texts, one at a time."""
    for doc_id, text in zip(batch.column(0), batch.column(1), strict=True):
        words = words_of(text.as_py())
        if plant:
            key = doc_id.as_py()
            words = planted(words, zlib.crc32(b"" if key is None else b"%d" % key))
        yield words, runs_of(numbered(words))
