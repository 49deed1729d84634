"""Substring dedup: suffix automata of reference shards, matching statistics, removal of the spans they give."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .automaton import SuffixAutomaton
from .memo import Memo, released
from .store import small_or_not, written
from .words import words_of

#: Words of a window, and of an anchor: each window has one anchor, its run of so many words of least hash, the first of equals.
WINDOW, ANCHOR = 20, 6
#: Anchors that a window has to choose from; windows in a row that one anchor's place can own.
CHOICES = WINDOW - ANCHOR + 1
#: Words of a reference shard, about; contexts of one anchor, beyond which its windows are keyed one by one.
SHARD_WORDS, MOST_CONTEXTS = 50_000, 2_000
MIX = np.uint64(0x9E3779B97F4A7C15)
BASE = 0xD6E8FEB86659FD93
#: Kinds of contexts of one anchor in a batch, above which they are dealt by kind, as such an anchor may be very common.
KINDS = 2
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers_to(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of BASE and of its inverse (modulo 2^64), at least n."""
    if len(_powers[0]) < n:
        n = max(n, 2 * len(_powers[0]))
        for k, base in enumerate((BASE, pow(BASE, -1, 1 << 64))):
            factors = np.full(n, base, np.uint64)
            factors[0] = 1
            _powers[k] = np.multiply.accumulate(factors)
    return _powers[0], _powers[1]


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * MIX
    return x ^ (x >> np.uint64(29))


def contexts(words: list[bytes], words_seen: Memo) -> tuple[np.ndarray, ...]:
    """anchor, key (two halves), first window, windows: for each anchor's place the run of windows that own it, a hash of the anchor, and 128 bits of a digest of the run's words.

    Equal windows have equal anchors at equal places, wherever they stand. Runs are in order and disjoint. Anchors only tell what meets; equal runs are told by the digest alone.
    """
    n = len(words)
    hashes = np.fromiter(map(words_seen.__getitem__, words), np.uint64, n)
    up, down = _powers_to(n + 1)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(hashes * up[:n], out=sums[1:])
    short = _mixed((sums[ANCHOR:] - sums[:-ANCHOR]) * down[: n - ANCHOR + 1])
    place = np.lib.stride_tricks.sliding_window_view(short, CHOICES).argmin(1) + np.arange(n - WINDOW + 1)
    low = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
    count = np.diff(np.append(low, len(place)))
    text = memoryview(b" ".join(words))
    starts = np.zeros(n + 1, np.int64)  # each word has a space after it
    np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1, out=starts[1:])
    begin, end = starts[low].tolist(), (starts[low + count + WINDOW - 1] - 1).tolist()
    key = np.frombuffer(b"".join([xxhash.xxh3_128_digest(text[i:j]) for i, j in zip(begin, end, strict=True)]), np.uint64).reshape(-1, 2)
    return short[place[low]], key[:, 0], key[:, 1], low, count


class Statistics(SuffixAutomaton):
    """What a string streamed through the automaton matches."""

    def first_ends(self, string: list[int], least: int) -> Iterator[tuple[int, int]]:
        """Streams a string: (its place, place where the last `least` items first end) wherever so many match."""
        edges, link, length, first = self.edges, self.link, self.length, self.first
        state = matched = 0
        for place, c in enumerate(string):
            while state and c not in edges[state]:
                state = link[state]
                matched = length[state]
            to = edges[state].get(c)
            if to is None:
                continue
            state, matched = to, matched + 1
            while length[link[state]] >= least:
                state = link[state]
                matched = length[state]
            if matched >= least:
                yield place, first[state]


def shard_masks(rows: list[tuple[int, int, int, bytes]]) -> list[int]:
    """Of contexts (doc, row, first window, words), the windows (bits) that also start earlier in the shard."""
    order = sorted(range(len(rows)), key=lambda k: rows[k][:3])
    number: dict[bytes, int] = {}
    strings = [[number.setdefault(w, len(number)) for w in words.split(b" ")] for *_, words in rows]
    automaton, starts, at = Statistics(), [], 0
    for k in order:
        automaton.add(strings[k], at)
        starts.append(at)
        at += len(strings[k])
    bounds = np.array(starts)
    masks = [0] * len(rows)
    for k in order:
        doc, row, low, _ = rows[k]
        places, firsts = zip(*automaton.first_ends(strings[k], WINDOW), strict=True)
        begins = np.array(firsts) - WINDOW + 1
        owner = np.searchsorted(bounds, begins, "right") - 1
        for place, begin, o in zip(places, begins.tolist(), owner.tolist(), strict=True):
            j = place - WINDOW + 1
            other = rows[order[o]]
            if (other[0], other[1], other[2] + begin - starts[o]) < (doc, row, low + j):
                masks[k] |= 1 << j
    return masks


@released
def _find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Contexts of each document. Those that a batch has earlier are marked here and needn't meet others.

    Contexts meet where their route says: by anchor, or, if the batch has over KINDS kinds of the anchor, each kind on its own
    (`many`); then one more row without a document tells the anchor's route that there are others.
    """
    words_seen = Memo(xxhash.xxh64_intdigest, 300_000)
    for batch in batches:
        found = []
        for doc, row, text in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
            words = words_of(text)
            if len(words) >= WINDOW:
                anchor, key, more, low, count = contexts(words, words_seen)
                n = len(low)
                found.append((anchor, key, more, np.full(n, doc), np.full(n, row), low * 16 + count))
        if not found:
            continue
        anchor, key, more, doc, row, at = map(np.concatenate, zip(*found, strict=True))
        order = np.lexsort((at, row, doc, more, key, anchor))
        anchor, key, more, doc, row, at = (x[order] for x in (anchor, key, more, doc, row, at))
        new_anchor = np.concatenate([[True], anchor[1:] != anchor[:-1]])
        new = new_anchor | np.concatenate([[True], (key[1:] != key[:-1]) | (more[1:] != more[:-1])])
        lead = np.flatnonzero(new)[np.cumsum(new) - 1]
        # a row that is there twice is marked once
        again = np.concatenate([[False], ~new[1:] & (doc[1:] == doc[:-1]) & (row[1:] == row[:-1]) & (at[1:] == at[:-1])])
        later = (doc != doc[lead]) | (row != row[lead]) | (at != at[lead])
        of = np.cumsum(new_anchor) - 1
        many = (np.add.reduceat(new.astype(np.int64), np.flatnonzero(new_anchor)) > KINDS)[of]
        # a marked one goes where its document's key says
        route = np.where(later, row.astype(np.uint64), np.where(many, _mixed(anchor ^ key), anchor))
        told = np.flatnonzero(new_anchor & many)
        own = np.flatnonzero(~again)
        columns = [np.concatenate([x[own], y[told]]) for x, y in ((route, anchor), (anchor, anchor), (key, key), (more, more), (doc, doc), (row, row), (at, np.full(len(at), -1)))]
        flags = [np.concatenate([x[own], np.full(len(told), y)]) for x, y in ((later, False), (many, True))]
        arrays = [*(pa.array(x.view(np.int64)) for x in columns), *map(pa.array, flags)]
        yield pa.RecordBatch.from_arrays(arrays, names=["route", "anchor", "key", "more", "doc", "row", "at", "marked", "many"])


@released
def _judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of contexts sorted by route, anchor, whether they are marked and many, key and place: those that aren't the first of their kind,
    marked; and the first ones of anchors with several kinds."""
    several, held = False, None  # whether the open anchor has several kinds; its first context, while it seems the only one
    last: tuple = (None,) * 7  # route, anchor, key (two halves), document, row and place of the open kind's first context
    for batch in batches:
        out = []
        for route, anchor, key, more, doc, row, at, marked, many in zip(*(batch.column(k).to_pylist() for k in range(9)), strict=True):
            if marked:
                out.append((anchor, doc, row, at, True))
                continue
            if (route, anchor) != last[:2]:
                several, held, last = False, None, (route, anchor, None, None, None, None, None)
            if many and not several:
                several = True
                out += [held] if held else []
            if at < 0:
                continue
            if (route, anchor, key, more) != last[:4]:
                several = several or last[2] is not None
                last = (route, anchor, key, more, doc, row, at)
                out += [held] if held and several else []
                held = (anchor, doc, row, at, False)
                if several:
                    out.append(held)
                    held = None
            elif (doc, row, at) != last[4:]:
                out.append((anchor, doc, row, at, True))
        columns = list(zip(*out, strict=True)) if out else [[]] * 5
        arrays = [pa.array(c, t) for c, t in zip(columns, [*[pa.int64()] * 4, pa.bool_()], strict=True)]
        yield pa.RecordBatch.from_arrays(arrays, names=["anchor", "doc", "row", "at", "marked"])


@released
def _cut_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The words of the contexts asked for."""
    for batch in batches:
        for first in range(0, batch.num_rows, 256):
            out = []
            part = batch.slice(first, 256)
            for doc, row, text, wanted in zip(*(part.column(k).to_pylist() for k in range(4)), strict=True):
                words = words_of(text)
                for x in wanted:
                    low, count = divmod(x["at"], 16)
                    out.append((x["anchor"], x["hot"], doc, row, x["at"], b" ".join(words[low : low + count + WINDOW - 1])))
            columns = list(zip(*out, strict=True)) if out else [[]] * 6
            kinds = [pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["anchor", "hot", "doc", "row", "at", "words"])


@released
def _match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Shards of whole anchors, in order: an automaton of each, and what its contexts' statistics say."""

    def judged(rows: list[tuple]) -> pa.RecordBatch:
        masks = shard_masks([(doc, row, at >> 4, words) for _, doc, row, at, words in rows])
        hits = [(doc, row, (at >> 4) << 15 | mask) for (_, doc, row, at, _), mask in zip(rows, masks, strict=True) if mask]
        columns = list(zip(*hits, strict=True)) if hits else [[]] * 3
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["doc", "row", "mark"])

    rows, size = [], 0
    for batch in batches:
        for x in zip(*(batch.column(k).to_pylist() for k in range(5)), strict=True):
            if size >= SHARD_WORDS and x[0] != rows[-1][0]:
                yield judged(rows)
                rows, size = [], 0
            rows.append(x)
            size += WINDOW + (x[3] & 15) - 1
    if rows:
        yield judged(rows)


@released
def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each window of the contexts by a digest of its words."""
    for batch in batches:
        out = []
        for doc, row, at, words in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
            parts = words.split(b" ")
            for j in range(at & 15):
                out.append((hashlib.blake2b(b" ".join(parts[j : j + WINDOW]), digest_size=16).digest(), doc, row, (at >> 4) + j))
        columns = list(zip(*out, strict=True)) if out else [[]] * 4
        kinds = [pa.binary(), pa.int64(), pa.int64(), pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["window", "doc", "row", "begin"])


@released
def _remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    bits = np.arange(15)
    for batch in batches:
        out = []
        for text, marks in zip(batch.column(1).to_pylist(), batch.column(2), strict=True):
            words = words_of(text)
            n = len(words)
            if marks.is_valid and n:
                packed = marks.values.to_numpy(zero_copy_only=False)
                begins = (packed[:, None] >> 15) + bits
                begins = begins[(packed[:, None] >> bits & 1).astype(bool)]
                cover = np.zeros(n + 1, np.int64)
                np.add.at(cover, begins, 1)
                np.add.at(cover, begins + WINDOW, -1)
                gone = np.cumsum(cover[:-1]) > 0
                words = [w for w, g in zip(words, gone.tolist(), strict=True) if not g]
            kept = b" ".join(words)
            out.append((n, n - len(words), hashlib.sha256(kept).hexdigest(), kept.decode("utf-8", "surrogatepass")))
        columns = list(zip(*out, strict=True)) if out else [[]] * 4
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string()]
        arrays = [batch.column(0), *(pa.array(c, t) for c, t in zip(columns, kinds, strict=True))]
        yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "n_words", "n_removed", "kept_sha256", "kept"])


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    doc_id, text = F.col(id_col).cast("long"), F.col(text_col)
    last = F.lit((1 << 63) - 1)
    return docs.select(F.coalesce(doc_id, last).alias("doc"), F.xxhash64(doc_id, text).alias("row"), text.alias("text"), doc_id.alias("doc_id"))


def repeats(rows: DataFrame) -> DataFrame:
    """doc, row, mark: first word of a run of windows (shifted left by 15) and, as bits, those of them that also start earlier."""
    found = rows.select("doc", "row", "text").mapInArrow(_find, "route long, anchor long, key long, more long, doc long, row long, at long, marked boolean, many boolean")
    judged = found.repartition("route").sortWithinPartitions("route", "anchor", "marked", F.desc("many"), "key", "more", "doc", "row", "at")
    judged = written(judged.mapInArrow(_judge, "anchor long, doc long, row long, at long, marked boolean"), "judged")
    full = F.expr("shiftleft(1L, cast(at % 16 as int)) - 1")
    marks = judged.where("marked").select("doc", "row", F.shiftleft(F.shiftright("at", 4), 15).bitwiseOR(full).alias("mark"))

    # first contexts of anchors with several kinds: their words meet in reference shards
    open_ = judged.where("not marked").drop("marked")
    hot = small_or_not(written(open_.groupBy("anchor").count().where(F.col("count") > MOST_CONTEXTS).select("anchor", F.lit(True).alias("hot")), "hot"))
    open_ = open_.join(hot, "anchor", "left").withColumn("hot", F.coalesce("hot", F.lit(False)))
    wanted = open_.groupBy("doc", "row").agg(F.collect_list(F.struct("anchor", "at", "hot")).alias("wanted"))
    asked = written(rows.select("doc", "row", "text").dropDuplicates(["doc", "row"]).join(wanted, ["doc", "row"]).select("doc", "row", "text", "wanted").mapInArrow(
        _cut_out, "anchor long, hot boolean, doc long, row long, at long, words binary"), "contexts")
    cool = asked.where("not hot").select("anchor", "doc", "row", "at", "words").repartition("anchor").sortWithinPartitions("anchor")
    marks = marks.unionByName(cool.mapInArrow(_match, "doc long, row long, mark long"))
    windows = asked.where("hot").select("doc", "row", "at", "words").mapInArrow(_windows, "window binary, doc long, row long, begin long")
    first = windows.groupBy("window").agg(F.min(F.struct("doc", "row", "begin")).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    later = windows.join(first, "window").where(F.struct("doc", "row", "begin") > F.col("first"))
    return marks.unionByName(later.select("doc", "row", (F.shiftleft("begin", 15) + 1).alias("mark")))


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256, kept (the words left, joined by one space) of each row.

    A window is WINDOW consecutive words. Each word goes that is covered by a window whose words also start
    earlier: in a document of smaller id, or earlier in the same one. Windows are judged on the input.

    1. One pass over the texts gives contexts: an anchor and the windows around it that own it. Contexts that
       a batch has earlier are marked on the spot, so copies and common passages hardly move.
    2. Contexts, as 128-bit digests of their words, meet by anchor: of equal ones all but the first are marked. Most anchors occur once.
    3. The words of the first contexts of anchors with several kinds make up the reference. It is cut in shards
       of whole anchors and about SHARD_WORDS words; in each a suffix automaton is built, its contexts are streamed
       for matching statistics, and a window that matches at full length is marked if it first ends earlier.
       The windows of an anchor with over MOST_CONTEXTS contexts are keyed by digests instead.
    4. Spans of marked windows are merged and cut out of each document.

    Null or blank text has no words; under WINDOW words nothing goes. A null id counts as larger than all others.
    Rows of one id follow each other in order of a hash of their texts; equal rows are one, and each gets its result. A very long
    text is read whole, one at a time. An empty table gives no rows. Other columns are ignored, whatever their names.
    """
    rows = _keyed(docs, id_col, text_col)
    marks = written(repeats(rows), "marks")
    by_row = marks.groupBy("doc", "row").agg(F.collect_list("mark").alias("marks"))
    return rows.join(by_row, ["doc", "row"], "left").select("doc_id", "text", "marks").mapInArrow(
        _remove, "doc_id long, n_words long, n_removed long, kept_sha256 string, kept string")


def digests(docs: DataFrame) -> DataFrame:
    """As dedup, without the words."""
    return dedup(docs).select("doc_id", "n_words", "n_removed", "kept_sha256")
