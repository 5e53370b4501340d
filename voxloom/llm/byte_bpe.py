"""Byte-level BPE: ids of texts by the ranks of a public vocabulary, and the bytes of ids.

A batch's texts are parted into the matches of the word pattern in numpy; each match not met before becomes a row of a
padded matrix of token ids, rows of like length together. Every round each row merges its leftmost pair of least rank;
finished rows leave, the others close up. A pair's rank comes from a hash table over all parts of all tokens.

Null texts count as empty and have no ids; rows that share a doc_id stay apart; no other column is read.
A match is one row however long it is, but it is first cut between bytes that stand side by side in no token, where no
merge can reach across. Nothing is shuffled.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxloom.llm.common import ragged, slices, small_batches, text_buffers
from voxloom.llm.tokens import WordTable

#: Rank of a pair that makes no token.
_NONE = np.int32(2**31 - 1)
#: Cells of one padded matrix; bounds the temporary arrays.
_CELLS = 1 << 20
_LETTER, _NUMBER, _SPACE, _OTHER = range(4)
_ASCII_SPACE = np.zeros(256, bool)
_ASCII_SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: What follows an apostrophe in the first alternatives of the pattern.
CONTRACTIONS = ("s", "t", "re", "ve", "m", "ll", "d")


class PairTable:
    """Rank of (left id, right id) by open addressing; pairs that make no token have _NONE."""

    def __init__(self, left: np.ndarray, right: np.ndarray, rank: np.ndarray) -> None:
        self.bits = max(4, int(4 * len(rank) + 1).bit_length())
        self.keys, self.ranks = np.full(1 << self.bits, -1, np.int64), np.full(1 << self.bits, _NONE, np.int32)
        key, slot = self._key(left, right), self._slot(self._key(left, right))
        todo = np.arange(len(key))
        while len(todo):
            free = todo[self.keys[slot[todo]] == -1]
            self.keys[slot[free]] = key[free]
            self.ranks[slot[free]] = rank[free]
            todo = todo[self.keys[slot[todo]] != key[todo]]
            slot[todo] = (slot[todo] + 1) & ((1 << self.bits) - 1)
        taken = np.flatnonzero(self.keys >= 0)
        assert len(taken) == len(key) and (self.lookup(left, right) == rank).all()

    def _key(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        return (left.astype(np.int64) << 32) | right.astype(np.int64)

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def lookup(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = self._key(left, right)
        slot = self._slot(key)
        out = np.full(len(key), _NONE, np.int32)
        todo = np.flatnonzero((left >= 0) & (right >= 0))
        while len(todo):
            held = self.keys[slot[todo]]
            found = held == key[todo]
            out[todo[found]] = self.ranks[slot[todo[found]]]
            todo = todo[~found & (held != -1)]
            slot[todo] = (slot[todo] + 1) & ((1 << self.bits) - 1)
        return out


def character_classes() -> np.ndarray:
    """Letter, number, white space or other for each code point, as the library's own pattern engine has them."""
    every = "".join(chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000)
    plain = {bytes([b]): b for b in range(256)}
    out = np.full(0x110000, _OTHER, np.uint8)
    for kind, pattern in ((_LETTER, r"\p{L}"), (_NUMBER, r"\p{N}"), (_SPACE, r"\s")):
        matched = bytes(tiktoken.Encoding("classes", pat_str=f"{pattern}+", mergeable_ranks=plain, special_tokens={}).encode_ordinary(every)).decode()
        out[np.frombuffer(matched.encode("utf-32-le"), np.uint32)] = kind
    return out


class ByteBpe:
    """Encoder and decoder for a rank file: lines of a token in base64 and its rank, which is also its id."""

    def __init__(self, path: str) -> None:
        with open(path, "rb") as f:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
        if any(bytes([b]) not in ranks for b in range(256)):
            raise ValueError("a vocabulary without all single bytes cannot encode every text")
        self.of_byte = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        pairs = [(ranks[t[:i]], ranks[t[i:]], r) for t, r in ranks.items() for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks]
        self.pairs = PairTable(*np.array(pairs, np.int64).reshape(-1, 3).T.astype(np.int32))
        tokens = [b""] * (max(ranks.values()) + 1)
        for t, r in ranks.items():
            tokens[r] = t
        self.bytes = np.frombuffer(b"".join(tokens), np.uint8)
        self.sizes = np.fromiter(map(len, tokens), np.int64, len(tokens))
        self.places = np.cumsum(self.sizes) - self.sizes
        self.adjacent = np.zeros((256, 256), bool)
        inner = np.ones(len(self.bytes), bool)
        inner[(self.places + self.sizes - 1)[self.sizes > 0]] = False
        inner = np.flatnonzero(inner)
        self.adjacent[self.bytes[inner], self.bytes[inner + 1]] = True
        self.classes = character_classes()
        self.table = WordTable()
        # A match that is a token is that token, even where merging would not lead to it.
        known = sorted(ranks, key=ranks.get)
        merged = self._merge(np.frombuffer(b"".join(known), np.uint8), *self._spans(known))
        self.whole = {t: ranks[t] for t, ids in zip(known, merged, strict=True) if ids.tolist() != [ranks[t]]}

    @staticmethod
    def _spans(parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        end = np.cumsum([len(p) for p in parts]).astype(np.int64)
        return end - np.array([len(p) for p in parts], np.int64), end

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the rows in data, and each row's n + 1 places. A long row is read in steps that end before white space."""
        parts, counts = [np.zeros(0, np.int64)], np.zeros(len(offsets) - 1, np.int64)
        for lo, hi in slices(offsets):
            a, b = int(offsets[lo]), int(offsets[hi])
            while True:
                c = b
                if b - a > 1 << 21:
                    c = self._cut(data, a + (1 << 20), b)
                rows = np.zeros(1, np.int64) if hi - lo == 1 else offsets[lo:hi] - a
                ids, at = self._block(data[a:c], rows)
                parts.append(ids)
                counts[lo:hi] += np.diff(at)
                if c >= b:
                    break
                a = c
        return np.concatenate(parts), np.concatenate([[0], np.cumsum(counts)])

    @staticmethod
    def _cut(data: np.ndarray, lo: int, hi: int) -> int:
        """The first place after lo where white space follows another ASCII character, which no match spans; else hi."""
        for at in range(lo, hi, 1 << 16):
            x = data[at : min(hi, at + (1 << 16) + 1)]
            found = np.flatnonzero(_ASCII_SPACE[x[1:]] & (x[:-1] < 0x80) & ~_ASCII_SPACE[x[:-1]])
            if len(found):
                return at + 1 + int(found[0])
        return hi

    def matches(self, data: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """Where the pattern's matches begin; `rows`: where texts begin. No match reaches across."""
        lead = np.flatnonzero((data & 0xC0) != 0x80)
        n = len(lead)
        if not n:
            return np.zeros(0, np.int64)
        padded = np.concatenate([data, np.zeros(3, np.uint8)]).astype(np.uint32)
        b = padded[lead]
        code = b.copy()
        for least, most, size in ((0xC0, 0xE0, 2), (0xE0, 0xF0, 3), (0xF0, 0xF8, 4)):
            i = np.flatnonzero((b >= least) & (b < most))
            code[i] = b[i] & (0x7F >> size)
            for k in range(1, size):
                code[i] = (code[i] << 6) | (padded[lead[i] + k] & 0x3F)
        kind = self.classes[code]
        first = np.zeros(n + 1, bool)  # a text begins
        first[np.searchsorted(lead, rows)] = True
        first[n] = True
        edge = first[:n].copy()
        edge[1:] |= kind[1:] != kind[:-1]
        space = kind == _SPACE
        before_text = space & ~first[1:]
        before_text[:-1] &= ~space[1:]
        blank = code == 0x20
        begins = edge | before_text
        joined = np.flatnonzero(edge[1:] & ~first[1:n] & ~space[1:] & blank[:-1]) + 1  # a space is part of what follows
        begins[joined] = False
        quote = (code == 0x27) & edge
        quote[joined] = False
        at = np.flatnonzero(quote)
        ends = np.flatnonzero(first)
        row_end = ends[np.searchsorted(ends, at, "right")] if len(at) else at
        wide = np.concatenate([code, np.zeros(2, np.uint32)])
        for tail in CONTRACTIONS:
            fits = at + len(tail) < row_end
            for k, ch in enumerate(tail):
                fits &= wide[at + 1 + k] == ord(ch)
            hit = at[fits]
            begins[hit + 1] = False
            after = hit + 1 + len(tail)
            begins[after[after < n]] = True
        return lead[begins]

    def _block(self, data: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        start = self.matches(data, rows)
        if len(data) > 1 and not self.whole:
            cut = ~self.adjacent[data[:-1], data[1:]]
            cut[start[start > 0] - 1] = True
            start = np.concatenate([[0], np.flatnonzero(cut) + 1])
        end = np.append(start[1:], len(data))[: len(start)]
        ids, ends = self.table.lookup(data, start, end, lambda at: self._words(data, start[at], end[at]))
        return ids.astype(np.int64), ends[np.searchsorted(start, np.append(rows, len(data)))]

    def _words(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> list[np.ndarray]:
        out = self._merge(data, start, end)
        if self.whole:
            for i, (a, b) in enumerate(zip(start.tolist(), end.tolist(), strict=True)):
                own = self.whole.get(data[a:b].tobytes())
                out[i] = out[i] if own is None else np.array([own])
        return out

    def _merge(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> list[np.ndarray]:
        """Ids of each data[start:end]."""
        size = end - start
        bucket = np.ceil(np.log2(np.maximum(size, 1))).astype(int)
        out: list = [None] * len(size)
        for b in np.unique(bucket).tolist():
            members = np.flatnonzero(bucket == b)
            step = max(1, _CELLS >> b)
            for k in range(0, len(members), step):
                rows = members[k : k + step]
                n = size[rows]
                tokens = np.full((len(rows), int(n.max(initial=1))), -1, np.int32)
                r = np.repeat(np.arange(len(rows)), n)
                tokens[r, ragged(n, np.zeros(len(rows), np.int64))] = self.of_byte[data[ragged(n, start[rows])]]
                self._rounds(tokens, rows, out)
        return out

    def _rounds(self, tokens: np.ndarray, rows: np.ndarray, out: list) -> None:
        """Merge the rows of a padded matrix until no pair makes a token; out[rows[i]] gets the ids of row i.

        In a round a row merges its leftmost pair of least rank and those of the same rank after it, but stops at one
        whose merging makes a pair of lesser rank, which must come first.
        """
        n, width = tokens.shape
        ranks = np.full((n, width), _NONE, np.int32)
        ranks[:, :-1] = self.pairs.lookup(tokens[:, :-1].ravel(), tokens[:, 1:].ravel()).reshape(n, width - 1)
        while True:
            least = ranks.min(1)
            done = least == _NONE
            for i in np.flatnonzero(done).tolist():
                out[rows[i]] = tokens[i][tokens[i] >= 0].astype(np.uint32)
            if done.all():
                return
            if done.any():
                tokens, ranks, rows, least = tokens[~done], ranks[~done], rows[~done], least[~done]
            n, width = tokens.shape
            hit = ranks == least[:, None]
            r, p = np.nonzero(hit)
            # Of pairs that share a token, every other one from the left.
            fresh = np.ones(len(r), bool)
            fresh[1:] = (r[1:] != r[:-1]) | (p[1:] != p[:-1] + 1)
            run = np.maximum.accumulate(np.where(fresh, np.arange(len(r)), 0))
            odd = (np.arange(len(r)) - run) % 2 == 1
            r, p = r[~odd], p[~odd]
            made = least[r]
            near = np.zeros(len(r), bool)
            near[1:] = (r[1:] == r[:-1]) & (p[1:] == p[:-1] + 2)
            left = np.where(p > 0, tokens[r, np.maximum(p - 1, 0)], -1)
            left = np.where(near, made, left)
            right = np.where(p + 2 < width, tokens[r, np.minimum(p + 2, width - 1)], -1)
            lower = (self.pairs.lookup(left, made) < made) | (self.pairs.lookup(made, right) < made)
            stop = np.cumsum(lower) - lower
            head = np.searchsorted(r, np.arange(n))
            go = stop == stop[head[r]]
            r, p, made = r[go], p[go], made[go]
            tokens[r, p] = made
            tokens[r, p + 1] = -2
            moved = np.zeros((n, width), bool)
            moved[r, p] = True
            keep = tokens >= 0
            place = np.cumsum(keep, axis=1) - 1
            count = place[:, -1] + 1
            kr, kc = np.nonzero(keep)
            to = place[kr, kc]
            shorter = int(count.max())
            closed = np.full((n, shorter), -1, np.int32)
            closed[kr, to] = tokens[kr, kc]
            closed_ranks = np.full((n, shorter), _NONE, np.int32)
            closed_ranks[kr, to] = ranks[kr, kc]
            at = place[r, p]
            for shift in (0, -1):
                rr, cc = r[at + shift >= 0], at[at + shift >= 0] + shift
                following = np.where(cc + 1 < shorter, closed[rr, np.minimum(cc + 1, shorter - 1)], -1)
                closed_ranks[rr, cc] = self.pairs.lookup(closed[rr, cc], following)
            tokens, ranks = closed, closed_ranks

    def decode(self, ids: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of the ids of each row, and n + 1 places; raises ValueError for an id that is none."""
        if len(ids) and (ids.min() < 0 or ids.max() >= len(self.sizes)):
            raise ValueError("an id beyond the vocabulary")
        size = self.sizes[ids]
        return self.bytes[ragged(size, self.places[ids])], np.concatenate([[0], np.cumsum(size)])[offsets]


_coders: dict[str, ByteBpe] = {}


def coder(path: str) -> ByteBpe:
    """One for each Python worker and path."""
    if path not in _coders:
        _coders[path] = ByteBpe(path)
    return _coders[path]


def encode(docs: DataFrame, path: str) -> DataFrame:
    """doc_id and ids (array of int) of every row's text by the rank file at `path`; null text: no ids."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = coder(path)
        for batch in batches:
            ids, at = c.encode(*text_buffers(batch.column("text")))
            lists = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(ids, pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), lists], ["doc_id", "ids"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id, ids and their bytes as `decoded`; null ids: null."""
    small_batches(encoded.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = coder(path)
        for batch in batches:
            lists = batch.column("ids")
            size = np.asarray(lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False), np.int64)
            ids = lists.flatten().to_numpy(zero_copy_only=False)
            data, at = c.decode(ids.astype(np.int64), np.concatenate([[0], np.cumsum(size)]))
            null = lists.is_null().to_pylist() if lists.null_count else [False] * len(lists)
            raw = data.tobytes()
            decoded = pa.array([None if x else raw[a:b] for x, a, b in zip(null, at, at[1:], strict=False)], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), lists, decoded], ["doc_id", "ids", "decoded"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, ids array<int>, decoded binary")


def report(docs: DataFrame, path: str) -> DataFrame:
    """Number and digest of each text's ids (decimal, one space between), and the digest of the bytes that they decode to."""
    both = decode(encode(docs, path), path)
    return both.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join("ids", " "), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
