"""Near-duplicate classes by b-bit MinHash: bands give candidates, packed low bits rule pairs out, full sets confirm."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .memo import Memo, released
from .store import small_or_not, written

#: Bits that are kept of each minimum, and minima in a band.
BITS, ROWS = 4, 4
#: Members of a bucket that are compared pair by pair (by their packed bits); a larger bucket is taken as one class of candidates,
#: in parts of about so many.
BUCKET = 4096
#: Shingles of the documents that are confirmed in one task; larger classes are first connected by pairs, and what is left is
#: confirmed in blocks.
BLOCK = 50_000
MIX = np.uint64(0x9E3779B97F4A7C15)


@dataclass(frozen=True)
class Plan:
    """Shingle width in words and least similarity in percent; the number of bands follows from the links that may be missed."""

    width: int = 5
    percent: int = 80
    missed: float = 1e-6

    @property
    def bands(self) -> int:
        return math.ceil(math.log(self.missed) / math.log(1 - (self.percent / 100) ** ROWS))

    @property
    def hashes(self) -> int:
        return -(-self.bands * ROWS // 16) * 16

    @property
    def least_matches(self) -> int:
        """Equal low bits below which a pair's estimate is five standard errors under the threshold, after the correction for chance."""
        t, chance = self.percent / 100, 2.0**-BITS
        least = t - 5 * math.sqrt(t * (1 - t) / self.hashes)
        return math.floor(self.hashes * (chance + least * (1 - chance)))


def shingles(text: str | None, width: int, words_seen: Memo) -> np.ndarray:
    """64-bit hashes of the shingles in order; with fewer words than `width`, of all words as one; without words none."""
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not words:
        return np.zeros(0, np.uint64)
    hashes = np.fromiter(map(words_seen.__getitem__, words), np.uint64, len(words))
    n = max(1, len(words) - width + 1)
    width = min(width, len(words))
    made = np.full(n, width, np.uint64)
    for k in range(width):
        made = (made ^ hashes[k : n + k]) * MIX
        made ^= made >> np.uint64(29)
    return made


def _word_hashes() -> Memo:
    """A task's own, so that it ends with the task."""
    return Memo(xxhash.xxh64_intdigest, 40_000)


def signatures(docs: DataFrame, plan: Plan, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, set_key (digest of the set), bands, packed of each row."""
    rng = np.random.Generator(np.random.PCG64(7))
    factors = rng.integers(0, 2**31, plan.hashes).astype(np.uint32) * np.uint32(2) + np.uint32(1)
    masks = rng.integers(0, 2**32, plan.hashes, dtype=np.uint32)
    bands, hashes, width = plan.bands, plan.hashes, plan.width

    def minima(sets: list[np.ndarray]) -> np.ndarray:
        joined = np.concatenate(sets)
        x = ((joined * MIX) >> np.uint64(32)).astype(np.uint32)
        starts = np.cumsum([0, *map(len, sets[:-1])])
        out = np.empty((len(sets), hashes), np.uint32)
        for k in range(hashes):
            out[:, k] = np.minimum.reduceat((x ^ masks[k]) * factors[k], starts)
        return out

    @released
    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words_seen = _word_hashes()
        for whole in batches:
            for first in range(0, whole.num_rows, 256):
                batch = whole.slice(first, 256)
                sets = [np.unique(shingles(t.as_py(), width, words_seen)) for t in batch.column(1)]
                sizes = [len(s) for s in sets]
                full = [k for k, n in enumerate(sizes) if n]
                keys, packed = [[]] * len(sets), [None] * len(sets)
                if full:
                    least = minima([sets[k] for k in full])
                    low = (least & np.uint32(15)).astype(np.uint8)
                    low = low[:, 0::2] << 4 | low[:, 1::2]
                    band = np.zeros((len(full), bands), np.uint64)
                    for r in range(ROWS):
                        band = (band ^ least[:, r : ROWS * bands : ROWS]) * MIX
                        band ^= band >> np.uint64(31)
                    band = ((band ^ np.arange(bands, dtype=np.uint64)) * MIX).view(np.int64)
                    for row, k in enumerate(full):
                        keys[k], packed[k] = band[row], low[row].tobytes()
                digests = [hashlib.md5(s.tobytes()).digest() if len(s) else None for s in sets]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), pa.array(keys, pa.list_(pa.int64())), pa.array(packed, pa.binary())],
                    names=["doc_id", "n_shingles", "set_key", "bands", "packed"],
                )

    picked = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return picked.mapInArrow(sign, "doc_id long, n_shingles long, set_key binary, bands array<long>, packed binary")


class Classes:
    """Disjoint classes of 0..n-1."""

    def __init__(self, n: int):
        self.parent = list(range(n))
        self.left = n

    def find(self, x: int) -> int:
        parent = self.parent
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    def join(self, a: int, b: int) -> bool:
        a, b = self.find(a), self.find(b)
        if a == b:
            return False
        self.parent[max(a, b)] = min(a, b)
        self.left -= 1
        return True


def unequal(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Number of minima whose low bits differ, of packed rows."""
    x = a ^ b
    x |= x >> np.uint64(1)
    x |= x >> np.uint64(2)
    return np.bitwise_count(x & np.uint64(0x1111111111111111)).sum(-1, dtype=np.int64)


def bucket_links(packed: np.ndarray, most_unequal: int) -> list[tuple[int, int]]:
    """Pairs that connect what the packed rows' estimates connect; at most one fewer than rows.

    A row is linked to the middle one of the earlier rows of a class that it is near to: so no row has
    many links, and no path is long.
    """
    classes, links = Classes(len(packed)), []
    for b in range(1, len(packed)):
        near = np.flatnonzero(unequal(packed[:b], packed[b]) <= most_unequal)
        if len(near):
            roots: dict[int, list[int]] = {}
            for a in near.tolist():
                roots.setdefault(classes.find(a), []).append(a)
            for members in roots.values():
                a = members[len(members) // 2]
                if classes.join(a, b):
                    links.append((a, b))
    return links


def _groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """The rows of sorted batches, cut between groups of equal first `keys` columns."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [np.asarray(batch.column(k)) for k in range(keys)]
        new = np.flatnonzero(np.any([c[1:] != c[:-1] for c in columns], axis=0))
        if held and any(held[-1].column(k)[-1] != batch.column(k)[0] for k in range(keys)):
            yield pa.Table.from_batches(held)
            held = []
        if len(new):
            cut = int(new[-1]) + 1
            yield pa.Table.from_batches([*held, batch.slice(0, cut)])
            held, batch = [], batch.slice(cut)
        held.append(batch)
    if held:
        yield pa.Table.from_batches(held)


def candidate_links(signed: DataFrame, plan: Plan) -> DataFrame:
    """a, b: pairs that connect all documents that share a band and whose packed bits don't rule them out.

    Rows are dealt by band key and read in order, so a task holds one bucket. All members of a bucket over BUCKET become one class,
    which loses nothing, as full sets decide later: it is dealt in parts of about BUCKET, each a tree of
    its members, and the parts' smallest members are linked as a tree.
    """
    most_unequal, words = plan.hashes - plan.least_matches, plan.hashes // 16

    @released
    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _groups(batches, 2):
            key, part, doc, hot = (np.asarray(table.column(k).combine_chunks()) for k in range(4))
            packed = np.frombuffer(b"".join(table.column(4).to_pylist()), np.uint64).reshape(-1, words)
            bounds = np.concatenate([[0], np.flatnonzero((key[1:] != key[:-1]) | (part[1:] != part[:-1])) + 1, [len(key)]])
            sizes, hot = np.diff(bounds), hot[bounds[:-1]]
            twos = bounds[:-1][(sizes == 2) & ~hot]
            near = twos[unequal(packed[twos], packed[twos + 1]) <= most_unequal] if len(twos) else twos
            a, b = [doc[near]], [doc[near + 1]]
            for k in np.flatnonzero((sizes > 2) | hot).tolist():
                low, high = int(bounds[k]), int(bounds[k + 1])
                if hot[k]:
                    later = np.arange(1, high - low)
                    a.append(doc[low + (later - 1) // 2])
                    b.append(doc[low + later])
                elif found := bucket_links(packed[low:high], most_unequal):
                    pairs = np.array(found) + low
                    a.append(doc[pairs[:, 0]])
                    b.append(doc[pairs[:, 1]])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a), pa.int64()), pa.array(np.concatenate(b), pa.int64())], names=["a", "b"])

    rows = signed.select(F.explode("bands").alias("band"), "doc_id", "packed")
    large = rows.groupBy("band").count().where(F.col("count") > BUCKET).select("band", F.ceil(F.col("count") / BUCKET).alias("parts"))
    large = small_or_not(written(large, "large-buckets"))
    dealt = rows.join(large, "band", "left").select(
        "band", F.when(F.col("parts").isNull(), 0).otherwise(F.pmod(F.xxhash64("doc_id"), "parts")).cast("long").alias("part"), "doc_id", F.col("parts").isNotNull().alias("hot"), "packed"
    )
    links = dealt.repartition("band", "part").sortWithinPartitions("band", "part", "doc_id").mapInArrow(link, "a long, b long")
    least = dealt.where("hot").groupBy("band", "part").agg(F.min("doc_id").alias("least"))
    least = written(least, "least-of-parts")
    above = least.select("band", F.col("part").alias("up"), F.col("least").alias("a"))
    trees = least.where("part > 0").withColumn("up", F.floor((F.col("part") - 1) / 2)).join(above, ["band", "up"]).select("a", F.col("least").alias("b"))
    return links.unionByName(trees)


def similar(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """Whether 100 * intersection >= percent * union, of sorted distinct values."""
    common = len(np.intersect1d(x, y, assume_unique=True))
    return 100 * common >= percent * (len(x) + len(y) - common)


def confirmed_links(ids: np.ndarray, sets: list[np.ndarray], known: np.ndarray, asked: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Positions of pairs that connect what 100 * intersection >= percent * union connects; at most one fewer than sets.

    Sets of equal `known` are connected already; the sets where `asked` is true meet all others.
    """
    n = len(sets)
    sizes = np.array([len(s) for s in sets])
    classes, links = Classes(n), []
    _, first, of = np.unique(known, return_index=True, return_inverse=True)
    for k in np.flatnonzero(first[of] != np.arange(n)).tolist():
        classes.join(k, int(first[of[k]]))
    if n == 2:
        return [(0, 1)] if classes.left == 2 and similar(sets[0], sets[1], percent) else []
    joined = np.concatenate(sets)
    owner = np.repeat(np.arange(n), sizes)
    values, number = np.unique(joined, return_inverse=True)
    by_value = np.argsort(number, kind="stable")
    posting = owner[by_value]
    counts = np.bincount(number, minlength=len(values))
    starts = np.cumsum(counts) - counts
    shared = counts[number] > 1
    offsets = np.concatenate([[0], np.cumsum(sizes)])
    for x in np.argsort(ids, kind="stable").tolist():
        if classes.left == 1:
            break
        if not asked[x]:
            continue
        own = number[offsets[x] : offsets[x + 1]][shared[offsets[x] : offsets[x + 1]]]
        if not len(own):
            continue
        runs = counts[own]
        ends = np.cumsum(runs)
        at = np.arange(ends[-1]) + np.repeat(starts[own] - ends + runs, runs)
        common = np.bincount(posting[at], minlength=n)
        near = np.flatnonzero(100 * common >= percent * (sizes[x] + sizes - common))
        for y in near.tolist():
            if y != x and classes.join(x, y):
                links.append((x, y))
    return links


def shingle_sets(docs: DataFrame, members: DataFrame, width: int) -> DataFrame:
    """The columns of `members` (doc_id and others) and set, the packed sorted shingles, of each of its documents' texts."""
    names = [c for c in members.columns if c != "doc_id"]

    @released
    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words_seen = _word_hashes()
        for batch in batches:
            for first in range(0, batch.num_rows, 512):
                part = batch.slice(first, 512)
                sets = [np.unique(shingles(t.as_py(), width, words_seen)).tobytes() for t in part.column(part.num_columns - 1)]
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(sets, pa.binary())], names=["doc_id", *names, "set"])

    wanted = docs.join(members, "doc_id").select("doc_id", *names, "text")
    return wanted.mapInArrow(build, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in wanted.schema.fields[:-1]) + ", set binary")


def confirm_pairs(sets: DataFrame, pairs: DataFrame, percent: int) -> DataFrame:
    """a, b: of the pairs, those whose sets are similar enough."""

    @released
    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (c.to_pylist() for c in batch.columns[2:])
            good = [similar(np.frombuffer(p, np.uint64), np.frombuffer(q, np.uint64), percent) for p, q in zip(x, y, strict=True)]
            yield batch.select([0, 1]).filter(pa.array(good, pa.bool_()))

    left = sets.select(F.col("doc_id").alias("a"), F.col("set").alias("x"))
    right = sets.select(F.col("doc_id").alias("b"), F.col("set").alias("y"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y").mapInArrow(check, "a long, b long")


def confirm(docs: DataFrame, members: DataFrame, plan: Plan) -> DataFrame:
    """a, b: links confirmed on full sets inside each class of candidates.

    `members` is doc_id, coarse (its class), known (what it is connected to already), block, open_blocks, blocks. Documents of blocks
    under open_blocks meet all others of their class; those of the blocks behind are connected and don't meet one another.
    """
    percent = plan.percent

    @released
    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _groups(batches, 3):
            keys = np.stack([np.asarray(table.column(k).combine_chunks()) for k in range(3)])
            asked, ids, known = (np.asarray(table.column(k).combine_chunks()) for k in (3, 4, 5))
            sets = [np.frombuffer(s, np.uint64) for s in table.column(6).to_pylist()]
            bounds = np.concatenate([[0], np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1, [len(ids)]]).tolist()
            out: list[list[int]] = [[], []]
            for low, high in zip(bounds, bounds[1:], strict=False):
                if high - low > 1:
                    for a, b in confirmed_links(ids[low:high], sets[low:high], known[low:high], asked[low:high], percent):
                        out[0].append(int(ids[low + a]))
                        out[1].append(int(ids[low + b]))
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], names=["a", "b"])

    open_ = F.col("block") < F.col("open_blocks")
    others = F.explode(F.sequence(F.lit(0).cast("long"), F.when(open_, F.col("blocks")).otherwise(F.col("open_blocks")) - 1)).alias("other")
    pairs = shingle_sets(docs, members, plan.width).select("*", others).select(
        "coarse", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), open_.alias("asked"), "doc_id", "known", "set"
    )
    return pairs.repartition("coarse", "i", "j").sortWithinPartitions("coarse", "i", "j").mapInArrow(link, "a long, b long")


def _large_classes(docs: DataFrame, sized: DataFrame, candidates: DataFrame, plan: Plan) -> tuple[DataFrame, DataFrame]:
    """Links among `sized` (doc_id, coarse, n), the members of classes too large for a task, and the members that then are still to be confirmed.

    The candidates' pairs are confirmed one by one. What they connect needn't meet again: of each class, only the documents
    outside its largest part are open, and meet all others of the class in blocks.
    """
    docs_of = small_or_not(written(sized.select("doc_id").distinct(), "large-members"))
    sets = written(shingle_sets(docs, docs_of, plan.width).dropDuplicates(["doc_id", "set"]), "sets")
    pairs = candidates.join(docs_of.select(F.col("doc_id").alias("a")), "a", "left_semi")
    links = written(confirm_pairs(sets, pairs, plan.percent).distinct(), "pair-links")
    parts = components(links).select(F.col("node").alias("doc_id"), F.col("component").alias("known"))
    labelled = written(sized.join(parts, "doc_id", "left").withColumn("known", F.coalesce("known", "doc_id")), "labelled")
    by_part = labelled.groupBy("coarse", "known").agg(F.sum("n").alias("n"))
    blocks = lambda n: F.ceil(n / BLOCK)
    by_class = by_part.groupBy("coarse").agg(F.max_by("known", F.struct("n", -F.col("known"))).alias("main"), F.max("n").alias("most"), F.sum("n").alias("all")).where("all > most")
    by_class = by_class.select("coarse", "main", blocks(F.col("all") - F.col("most")).alias("open_blocks"), blocks(F.col("most")).alias("main_blocks"))
    by_class = small_or_not(written(by_class, "open-classes"))
    spread = F.xxhash64("doc_id")
    block = F.when(F.col("known") == F.col("main"), F.col("open_blocks") + F.pmod(spread, "main_blocks")).otherwise(F.pmod(spread, "open_blocks"))
    rest = labelled.join(by_class, "coarse").select("doc_id", "coarse", "known", block.alias("block"), "open_blocks", (F.col("open_blocks") + F.col("main_blocks")).alias("blocks"))
    return links, rest


def near_duplicates(docs: DataFrame, plan: Plan | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id, kept of each row.

    A-Z is lower-cased; a document's set is its distinct shingles. Documents link if their sets' similarity is
    `plan.percent` or more; component_id is the smallest doc_id that links reach. kept: it is the row's own.

    1. One pass over the texts gives each set's size, digest, bands of minima and packed low bits.
    2. Documents of equal digest are one from here on, the one of smallest id, so copies cost nothing.
    3. Documents that share a band and aren't ruled out by their low bits form classes of candidates, of which
       only connecting pairs are kept. A link of just the threshold shares no band with probability plan.missed.
    4. In classes of up to BLOCK shingles all sets meet in one task and links are confirmed. In larger ones the connecting pairs are
       confirmed first, and only documents that those leave outside the class's largest part meet all others, in blocks. Again only
       connecting pairs leave a task, so no group gives rows by the square of its size.

    Null or blank text has an empty set and links with nothing. Rows with one id are one node. A null id links with
    nothing and is kept. Sets tie in nothing, as all links count. A very long text is one set, held whole in a task. An empty table
    gives no rows. Other columns are ignored, whatever their names.
    """
    plan = plan or Plan()
    signed = written(signatures(docs, plan, id_col, text_col), "signatures")
    full = signed.where("set_key is not null and doc_id is not null")
    alike = full.groupBy("set_key").agg(F.min("doc_id").alias("rep"), F.min_by(F.struct("bands", "packed", "n_shingles"), "doc_id").alias("of"), F.count(F.lit(1)).alias("rows"))
    alike = written(alike, "alike")
    candidates = written(candidate_links(alike.select(F.col("rep").alias("doc_id"), "of.bands", "of.packed"), plan).where("a <> b").distinct(), "candidates")
    coarse = written(components(candidates), "classes")
    sized = coarse.join(alike.select(F.col("rep").alias("node"), F.col("of.n_shingles").alias("n")), "node")
    sized = written(sized.select(F.col("node").alias("doc_id"), F.col("component").alias("coarse"), "n"), "sized")
    large = written(sized.groupBy("coarse").agg(F.sum("n").alias("all")).where(F.col("all") > BLOCK).select("coarse", F.lit(True).alias("large")), "large")
    any_large = not large.isEmpty()
    sized = sized.join(small_or_not(large), "coarse", "left")
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    one, none = F.lit(1).cast("long"), F.lit(0).cast("long")
    small = sized.where("large is null").select("doc_id", "coarse", F.col("doc_id").alias("known"), none.alias("block"), one.alias("open_blocks"), one.alias("blocks"))
    pair_links, members = None, small
    if any_large:
        pair_links, rest = _large_classes(texts, sized.where("large").drop("large"), candidates, plan)
        members = small.unionByName(rest)
    links = confirm(texts, small_or_not(written(members.distinct(), "members")), plan)
    final = written(components(links if pair_links is None else links.unionByName(pair_links)), "components")
    # only copies and linked documents get another id than their own
    moved = alike.join(final.select(F.col("node").alias("rep"), "component"), "rep", "left").where("rows > 1 or component is not null")
    moved = small_or_not(written(moved.select("set_key", F.coalesce("component", "rep").alias("component_id")), "moved"))
    # empty sets match nothing, each by a key of its own, so that they don't meet in one task
    lone = F.unhex(F.md5(F.monotonically_increasing_id().cast("string")))
    keyed = signed.select("doc_id", "n_shingles", F.coalesce("set_key", lone).alias("set_key"))
    return keyed.join(moved, "set_key", "left").select(
        "doc_id",
        "n_shingles",
        F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id"),
        F.coalesce(F.coalesce("component_id", "doc_id") == F.col("doc_id"), F.lit(True)).alias("kept"),
    )
