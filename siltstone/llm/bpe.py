"""Byte-level BPE encoding by dynamic programming over prefixes, and decoding."""

from __future__ import annotations

import hashlib
import json
import struct
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .automaton import SuffixAutomaton
from .memo import Memo, released

#: Fixed value: how the vocabulary's format cuts text before the merges.
PIECES = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
#: A cut that no piece crosses: before a space that a character other than white space follows.
CUTS = regex.compile(r" (?=\S)")


def byte_letters() -> list[str]:
    """The letter that stands for each byte in the vocabulary file: itself if printable in Latin-1, else the next from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


#: Length of the prefixes whose table is remembered.
STEM = 6


class Uneven(Exception):
    """Spaces that aren't just one between words."""


class Suffixes(SuffixAutomaton):
    """Suffix automaton of a set of strings of bytes, and for each state the strings that end there.

    From a state and match length, an edge (or else the suffix links up to one) leads over the next byte to
    the longest suffix that occurs in some string. All single bytes are strings here, so one always does.
    """

    def __init__(self, words: dict[bytes, int]):
        super().__init__()
        ends = [self.add(word) for word in words]
        edges = self.edges
        # the states of whole words; a state may hold several, its suffixes of other lengths
        own: list[list[tuple[int, int]]] = [[] for _ in edges]
        for (word, number), state in zip(words.items(), ends, strict=True):
            # later growth may have split the state: climb to the one whose range of lengths has the word
            while self.link[state] >= 0 and self.length[self.link[state]] >= len(word):
                state = self.link[state]
            own[state].append((len(word), number))
        order = sorted(range(len(edges)), key=self.length.__getitem__)
        for state in order:
            own[state].sort(reverse=True)
        # and the words of the states up its suffix links: all suffixes of its strings, longest first
        self.ending: list[tuple[tuple[int, int], ...]] = [()] * len(edges)
        for state in order[1:]:
            above = self.ending[self.link[state]]
            self.ending[state] = (*own[state], *above) if own[state] else above
        self.edge_to = {state << 8 | c: to for state, out in enumerate(edges) for c, to in out.items()}
        self.edges, self.first = [], []  # not needed any more


class Encoder:
    """Encodes and decodes with the vocabulary and merges of a `tokenizers` file."""

    def __init__(self, path: str, remembered: int = 200_000):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        byte_of = {letter: b for b, letter in enumerate(byte_letters())}
        raw = lambda token: bytes(byte_of[x] for x in token)
        vocab: dict[str, int] = spec["model"]["vocab"]
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.bytes_of = {i: raw(t) for t, i in vocab.items() if t not in self.special}
        self.bytes_of |= {i: t.encode() for t, i in self.special.items()}
        listed = [self.bytes_of.get(i, b"") for i in range(max(self.bytes_of) + 1)]
        self.flat = np.frombuffer(b"".join(listed), np.uint8)
        self.sizes = np.array([len(x) for x in listed])
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.id_of = {raw(t): i for t, i in vocab.items() if t not in self.special}
        self.rank: dict[tuple[int, int], int] = {}
        self.parts: dict[int, tuple[int, int]] = {}
        self.made: dict[int, int] = {}
        for rank, pair in enumerate(spec["model"]["merges"]):
            left, right = pair if isinstance(pair, list) else pair.split(" ")
            a, b, c = vocab[left], vocab[right], vocab[left + right]
            self.rank[a, b] = rank
            if c not in self.parts:
                self.parts[c], self.made[c] = (a, b), rank
        # a token whose own bytes encode to something else never comes out
        self.whole = {text: i for text, i in self.id_of.items() if self._merged(text) == [i]}
        self.automaton = Suffixes(self.whole)
        self._fits: dict[int, bool] = {}
        self.words = Memo(self._after_space, remembered // 2)
        self.chunks = Memo(self._chunk, remembered // 8)
        self.stems = Memo(lambda stem: self._table(stem, [-1], [0], 0, 0), remembered // 4)
        self.pieces = Memo(lambda piece: pack(self.encode_piece(piece.encode("utf-8", "surrogatepass"))), remembered)
        self.cut_special = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None

    def fits(self, left: int, right: int) -> bool:
        """Whether the bytes of the two tokens encode to just these two, given that each encodes to itself.

        Going back in time, the token at either side of the border falls apart into what it was merged from.
        The border stays if no merge across it comes before the merges that next take the tokens beside it;
        of equal merges the left one comes first.
        """
        key = left << 20 | right
        known = self._fits.get(key)
        if known is not None:
            return known
        a, b, end = left, right, len(self.rank)
        until_a = until_b = end
        rank, made, parts = self.rank.get, self.made.get, self.parts
        while True:
            across = rank((a, b), end)
            if across < until_a and across <= until_b and across < end:
                answer = False
                break
            at_a, at_b = made(a, -1), made(b, -1)
            if at_a < 0 and at_b < 0:
                answer = True
                break
            if at_b >= at_a:
                until_b, b = at_b, parts[b][0]
            else:
                until_a, a = at_a, parts[a][1]
        if len(self._fits) > 2_000_000:
            self._fits.clear()
        self._fits[key] = answer
        return answer

    def _merged(self, text: bytes) -> list[int]:
        ids = [self.id_of[text[k : k + 1]] for k in range(len(text))]
        while len(ids) > 1:
            best, at = min((self.rank.get(pair, len(self.rank)), k) for k, pair in enumerate(zip(ids, ids[1:], strict=False)))
            if best == len(self.rank):
                break
            ids[at : at + 2] = [self.id_of[self.bytes_of[ids[at]] + self.bytes_of[ids[at + 1]]]]
        return ids

    def _table(self, text: bytes, last: list[int], sizes: list[int], state: int, matched: int) -> tuple[list[int], list[int], int, int]:
        """The unique last token of every prefix and its size, carried on over `text`.

        It is the one suffix of the prefix in the vocabulary that fits the last token of what is before it.
        The automaton lists those suffixes.
        """
        edges, link, length = self.automaton.edge_to, self.automaton.link, self.automaton.length
        ending, known, fits = self.automaton.ending, self._fits.get, self.fits
        for end, c in enumerate(text, len(last)):
            to = edges.get(state << 8 | c)
            while to is None:
                state = link[state]
                matched = length[state]
                to = edges.get(state << 8 | c)
            state = to
            matched += 1
            for size, token in ending[state]:
                if size <= matched:
                    before = last[end - size]
                    if before < 0:
                        break
                    fit = known(before << 20 | token)
                    if fit or (fit is None and fits(before, token)):
                        break
            last.append(token)
            sizes.append(size)
        return last, sizes, state, matched

    def encode_piece(self, piece: bytes) -> list[int]:
        """Ids of one piece: back from the end over the last tokens of its prefixes.

        A prefix's last token doesn't depend on what follows, so the tables of common first STEM bytes are shared.
        """
        token = self.whole.get(piece)
        if token is not None:
            return [token]
        if len(piece) > STEM:
            last, sizes, state, matched = self.stems[piece[:STEM]]
            last, sizes, _, _ = self._table(piece[STEM:], last.copy(), sizes.copy(), state, matched)
        else:
            last, sizes, _, _ = self._table(piece, [-1], [0], 0, 0)
        ids, end = [], len(piece)
        while end:
            ids.append(last[end])
            end -= sizes[end]
        return ids[::-1]

    def _after_space(self, word: str) -> bytes:
        if not word or word[0].isspace():
            raise Uneven
        if word.isalpha():
            return self.pieces[" " + word]
        if word[-1] in ",." and word[:-1].isalpha():
            return self.pieces[" " + word[:-1]] + self.pieces[word[-1]]
        return self._chunk(" " + word)

    def _chunk(self, chunk: str) -> bytes:
        found = PIECES.findall(chunk)
        return self.pieces[chunk] if len(found) == 1 else b"".join(map(self.pieces.__getitem__, found))

    def _plain(self, text: str) -> bytes:
        first, *rest = text.split(" ")
        try:
            return b"".join([self.chunks[first] if first else b"", *map(self.words.__getitem__, rest)])
        except Uneven:
            return b"".join(map(self.chunks.__getitem__, cut(text)))

    def encode(self, text: str | None) -> bytes:
        """Ids as little-endian unsigned 32-bit integers; null is an empty text. Special tokens' strings get their ids."""
        if not text:
            return b""
        if self.cut_special is None or not any(t in text for t in self.special):
            return self._plain(text)
        parts = self.cut_special.split(text)
        return b"".join(pack([self.special[p]]) if k % 2 else self._plain(p) for k, p in enumerate(parts) if p)

    def decode(self, ids: bytes) -> str:
        """Text of packed ids; bytes that aren't UTF-8 become U+FFFD."""
        if not ids:
            return ""
        tokens = np.frombuffer(ids, "<u4")
        sizes = self.sizes[tokens]
        ends = np.cumsum(sizes)
        at = np.arange(ends[-1]) + np.repeat(self.starts[tokens] - ends + sizes, sizes)
        return self.flat[at].tobytes().decode("utf-8", "replace")


def pack(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


def cut(text: str) -> list[str]:
    """Text cut at CUTS; each part but the first begins with its space."""
    first, *rest = CUTS.split(text)
    return [*filter(None, [first]), *map(" ".__add__, rest)]


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One a worker process."""
    return Encoder(path)


def encode_documents(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, ids (array of int), decoded, n_tokens, ids_sha256, decoded_sha256 and the carried columns, row by row.

    No shuffle. Each worker holds the automaton of the vocabulary and two bounded memos of pieces.
    Null text counts as empty and gives no ids. A very long text is encoded whole, one at a time. Repeated rows give repeated
    results, an empty table none. No ties arise: the last token of every prefix is unique. Columns that aren't carried are ignored; a carried one may not have an output's name.
    """
    return _encoded(docs, vocabulary, id_col, text_col, carry, True)


def digests(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """As encode_documents, without ids and decoded text."""
    return _encoded(docs, vocabulary, id_col, text_col, (), False)


def _encoded(docs: DataFrame, vocabulary: str, id_col: str, text_col: str, carry: tuple[str, ...], whole: bool) -> DataFrame:
    kept = docs.select(id_col, *carry, text_col)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields[:-1])
    schema += ", n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>, decoded string" * whole

    @released
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = encoder(vocabulary)
        for batch in batches:
            columns: list[list] = [[] for _ in range(5)]
            for value in batch.column(batch.num_columns - 1):
                ids = codec.encode(value.as_py())
                text = codec.decode(ids)
                columns[0].append(len(ids) // 4)
                columns[1].append(hashlib.sha256(ids).hexdigest())
                columns[2].append(hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest())
                if whole:
                    columns[3].append(memoryview(ids).cast("I").tolist())
                    columns[4].append(text)
            kinds = [pa.int64(), pa.string(), pa.string(), pa.list_(pa.int32()), pa.string()][: 5 if whole else 3]
            names = ["n_tokens", "ids_sha256", "decoded_sha256", "ids", "decoded"]
            made = [pa.array(c, t) for c, t in zip(columns, kinds, strict=False)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *made], names=[*batch.schema.names[:-1], *names[: len(made)]])

    return kept.mapInArrow(encode, schema)
