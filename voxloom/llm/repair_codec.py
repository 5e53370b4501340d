"""Token ids in shards compressed by Re-Pair grammars, with random access to each document.

A shard is one row of a Parquet table: its piece and number, how many ids it holds and a self-contained blob (magic
"RPG2", header, document ids, symbol offsets, the shard's own alphabet, rules as pairs, expansion lengths, symbols;
pairs and symbols packed at the bits that the largest needs). Pairs never cross documents, so a document's symbols are
a slice and its ids the expansion of that slice alone.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from voxloom.llm.common import by_ranges, materialize, pieces_by_size, ragged, small_batches, text_buffers
from voxloom.llm.tokens import encoder

MAGIC = b"RPG2"
_HEAD = struct.Struct("<4sQIIIQBB")
_NO_ID = -(1 << 63)


def compress(ids: np.ndarray, starts: np.ndarray, least: int = 4) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(alphabet, symbols, n + 1 symbol offsets of the documents, rules) by Re-Pair.

    Symbols below len(alphabet) are ids, the others stand for rules[symbol - len(alphabet)]. Pairs are replaced until
    none occurs `least` times (a rule costs two symbols and a length, so rarer pairs do not pay). A round counts the pairs
    and replaces, from the most frequent on, all that cannot overlap one taken before, for no symbol is the left of one and
    the right of another; the order among them then makes no difference. Of a run of one symbol every other pair is taken.
    A pair found rare stays rare, for its symbols only get fewer; only places beside new symbols are counted anew.
    """
    alphabet, seq = _alphabet(ids)
    starts, base = starts.astype(np.int64), len(alphabet)
    hot = np.ones(len(seq), bool)
    rules = [np.zeros((0, 2), np.int64)]
    symbols = base
    while True:
        hot[starts[1:][starts[1:] > 0] - 1] = False  # the last symbols of documents
        at = np.flatnonzero(hot)
        n = len(seq)
        wide, deep = symbols.bit_length(), n.bit_length()
        if 2 * wide + deep <= 64:
            pair = seq[at]
            pair <<= np.uint64(wide)
            pair |= seq[at + 1]
            pair <<= np.uint64(deep)
            pair |= at.view(np.uint64)
            pair.sort()
            spot = (pair & np.uint64((1 << deep) - 1)).view(np.int64)
            pair >>= np.uint64(deep)
        else:
            wide = 32
            pair = (seq[at] << np.uint64(wide)) | seq[at + 1]
            order = np.argsort(pair, kind="stable")
            spot, pair = at[order], pair[order]
        edge = np.flatnonzero(np.concatenate([[True], pair[1:] != pair[:-1]])) if len(pair) else np.zeros(0, np.int64)
        count = np.diff(np.append(edge, len(pair)))
        good = np.flatnonzero(count >= least)
        if not len(good):
            return alphabet, seq.astype(np.uint32), starts, np.concatenate(rules)
        order = ((n - count[good]) << 32) | np.arange(len(good))
        order.sort()
        good = good[order & 0xFFFFFFFF]
        left = (pair[edge[good]] >> np.uint64(wide)).astype(np.int64)
        right = (pair[edge[good]] & np.uint64((1 << wide) - 1)).astype(np.int64)
        free = _without_overlap(left, right, symbols)
        chosen, same = good[free], (left == right)[free]
        hits = spot[ragged(count[chosen], edge[chosen])]
        named = np.repeat(np.arange(symbols, symbols + len(chosen)), count[chosen])
        if same.any():  # places of one pair ascend, and no place of another is beside them
            first = np.concatenate([[True], (hits[1:] != hits[:-1] + 1) | (named[1:] != named[:-1])])
            run = np.maximum.accumulate(np.where(first, np.arange(len(hits)), 0))
            every = ~np.repeat(same, count[chosen]) | ((np.arange(len(hits)) - run) % 2 == 0)
            hits, named = hits[every], named[every]
        rules.append(np.stack([left[free], right[free]], axis=1))
        symbols += len(chosen)
        hot[:] = False
        put_off = good[~free]
        hot[spot[ragged(count[put_off], edge[put_off])]] = True
        hot[hits] = True
        hot[np.maximum(hits - 1, 0)] = True
        seq[hits] = named
        keep = np.ones(n, bool)
        keep[hits + 1] = False
        starts = starts - np.searchsorted(np.flatnonzero(~keep), starts)
        seq, hot = seq[keep], hot[keep]


def _alphabet(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct ids, ascending, and the place of each id among them; by a table where the ids are small."""
    top = int(ids.max(initial=0))
    if top >= 1 << 18:
        alphabet, seq = np.unique(ids, return_inverse=True)
        return alphabet, seq.astype(np.uint64)
    held = np.zeros(top + 1, bool)
    held[ids] = True
    return np.flatnonzero(held).astype(ids.dtype), (np.cumsum(held) - 1).astype(np.uint64)[ids]


def _without_overlap(left: np.ndarray, right: np.ndarray, symbols: int) -> np.ndarray:
    """Which pairs to take, from the first on, so that no symbol is the left of one and the right of another.

    In each step those go in that come before all undecided pairs they clash with, and pairs that clash with them go out.
    """
    out, is_left, is_right = np.zeros(len(left), bool), np.zeros(symbols, bool), np.zeros(symbols, bool)
    as_left, as_right = np.zeros(symbols, np.int64), np.zeros(symbols, np.int64)
    rank = np.arange(len(left))
    while len(rank):
        a, b = left[rank], right[rank]
        as_left[a], as_left[b], as_right[a], as_right[b] = (len(left),) * 4
        as_left[a[::-1]], as_right[b[::-1]] = rank[::-1], rank[::-1]
        good = np.where(a == b, (as_left[a] == rank) & (as_right[a] == rank), (as_right[a] > rank) & (as_left[b] > rank))
        out[rank[good]] = True
        is_left[a[good]], is_right[b[good]] = True, True
        rank = rank[~good & ~is_right[a] & ~is_left[b]]
        rank = rank[~((left[rank] == right[rank]) & (is_left[left[rank]] | is_right[left[rank]]))]
    return out


def expansion_lengths(base: int, rules: np.ndarray) -> np.ndarray:
    """How many ids each symbol stands for; rules name only earlier symbols."""
    out = np.ones(base + len(rules), np.int64)
    for a, b in _blocks(base, rules):
        out[base + a : base + b] = out[rules[a:b, 0]] + out[rules[a:b, 1]]
    return out


def _blocks(base: int, rules: np.ndarray) -> Iterator[tuple[int, int]]:
    """Runs of rules that name no rule of their own run."""
    top, a = rules.max(axis=1, initial=0), 0
    while a < len(rules):
        far = top[a:] >= base + a
        b = a + int(far.argmax()) if far.any() else len(rules)
        yield a, b
        a = b


def _pack(values: np.ndarray, bits: int) -> bytes:
    wide = 2 if bits <= 16 else 4
    planes = np.unpackbits(values.astype(f">u{wide}").view(np.uint8).reshape(-1, wide), axis=1)[:, 8 * wide - bits :]
    return np.packbits(planes).tobytes()


def _unpack(raw: np.ndarray, n: int, bits: int) -> np.ndarray:
    wide = 2 if bits <= 16 else 4
    planes = np.zeros((n, 8 * wide), np.uint8)
    planes[:, 8 * wide - bits :] = np.unpackbits(raw, count=n * bits).reshape(n, bits)
    return np.packbits(planes).view(f">u{wide}").astype(np.int64)


def write_shard(ids: np.ndarray, starts: np.ndarray, doc_ids: list[int | None], first: int) -> bytes:
    """`first`: ids that precede the shard in its piece. Ids may be any numbers below 2**32."""
    alphabet, symbols, at, rules = compress(ids, starts)
    lengths = expansion_lengths(len(alphabet), rules)[len(alphabet) :]
    bits = max(1, (len(alphabet) + len(rules) - 1).bit_length())
    size = 1 if lengths.max(initial=0) < 1 << 8 else 2 if lengths.max() < 1 << 16 else 4
    keys = np.array([_NO_ID if x is None else x for x in doc_ids], "<i8")
    head = _HEAD.pack(MAGIC, first, len(doc_ids), len(alphabet), len(rules), len(symbols), bits, size)
    return b"".join([head, keys.tobytes(), at.astype("<u4").tobytes(), alphabet.astype("<u4").tobytes(), _pack(rules.ravel(), bits), lengths.astype(f"<u{size}").tobytes(), _pack(symbols, bits)])


class Shard:
    """A shard read from its blob; documents and single ids are decoded without the others."""

    def __init__(self, blob: bytes) -> None:
        magic, self.first, docs, alphabet, rules, symbols, bits, size = _HEAD.unpack_from(blob)
        if magic != MAGIC:
            raise ValueError("not a shard")
        parts, at = [], _HEAD.size
        for kind, count in (("<i8", docs), ("<u4", docs + 1), ("<u4", alphabet), ("u1", -(-2 * rules * bits // 8)), (f"<u{size}", rules), ("u1", -(-symbols * bits // 8))):
            parts.append(np.frombuffer(blob, kind, count, at))
            at += parts[-1].nbytes
        self.doc_ids = [None if x == _NO_ID else x for x in parts[0].tolist()]
        self.starts, self.alphabet = parts[1].astype(np.int64), parts[2]
        self.rules = _unpack(parts[3], 2 * rules, bits).reshape(-1, 2)
        self.lengths = np.concatenate([np.ones(alphabet, np.int64), parts[4].astype(np.int64)])
        self.symbols = _unpack(parts[5], symbols, bits)
        self._flat: np.ndarray | None = None
        self._places = np.cumsum(self.lengths) - self.lengths

    def _expanded(self) -> np.ndarray:
        """The ids of all symbols one after the other: each rule is written out once, from those of its two parts."""
        if self._flat is None:
            base, size, place = len(self.alphabet), self.lengths, self._places
            flat = np.zeros(int(size.sum()), np.uint32)
            flat[:base] = self.alphabet
            for a, b in _blocks(base, self.rules):
                one, two, to = self.rules[a:b, 0], self.rules[a:b, 1], place[base + a : base + b]
                flat[ragged(size[one], to)] = flat[ragged(size[one], place[one])]
                flat[ragged(size[two], to + size[one])] = flat[ragged(size[two], place[two])]
            self._flat = flat
        return self._flat

    def document(self, i: int) -> np.ndarray:
        own = self.symbols[self.starts[i] : self.starts[i + 1]]
        return self._expanded()[ragged(self.lengths[own], self._places[own])]

    def offsets(self) -> np.ndarray:
        """Ids before each document, and at last all of them, from expansion lengths alone."""
        return np.concatenate([[0], np.cumsum(self.lengths[self.symbols])])[self.starts]

    def id_at(self, i: int, k: int) -> int:
        """The k-th id of document i: skips whole symbols by their expansion lengths, then walks down one rule."""
        own = self.symbols[self.starts[i] : self.starts[i + 1]]
        ends = np.cumsum(self.lengths[own])
        j = int(np.searchsorted(ends, k, "right"))
        symbol, k = int(own[j]), k - int(ends[j] - self.lengths[own[j]])
        while symbol >= len(self.alphabet):
            a, b = self.rules[symbol - len(self.alphabet)].tolist()
            symbol, k = (a, k) if k < self.lengths[a] else (b, k - int(self.lengths[a]))
        return int(self.alphabet[symbol])


def write_ids(docs: DataFrame, tokenizer: str, end_id: int = 2, shard_ids: int = 1 << 17) -> DataFrame:
    """The written table of shards (piece, shard, n_ids, blob), ids in ascending doc_id order within and across pieces.

    A null or empty text is the end id alone; a null doc_id comes first; rows that share a doc_id follow by a hash of
    their text. A shard is closed once it holds `shard_ids` ids; a longer document has one of its own. Texts are shuffled
    once, to ranges of doc_id, as many as their size asks for, and encoded there.
    """
    small_batches(docs.sparkSession)
    base = max(encoder(tokenizer).tokenizer.get_vocab_size(), end_id + 1)
    kind = "<u2" if base <= 1 << 16 else "<u4"
    docs = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_NO_ID)).alias("doc_id"), "text")

    def encoded(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[int, int, np.ndarray]]:
        encode = encoder(tokenizer).encode
        for batch in batches:
            ids, at = encode(*text_buffers(batch["text"]))
            for p, key, a, b in zip(batch["piece"].to_pylist(), batch["doc_id"].to_pylist(), at[:-1].tolist(), at[1:].tolist(), strict=True):
                yield p, key, np.append(ids[a:b], end_id).astype(kind)

    def shards(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        piece, number, first, held, keys = None, 0, 0, [], []

        def close() -> pa.RecordBatch:
            ids = np.concatenate(held)
            blob = write_shard(ids, np.concatenate([[0], np.cumsum([len(x) for x in held])]), keys, first)
            return pa.record_batch([pa.array([piece], pa.int32()), pa.array([number], pa.int32()), pa.array([len(ids)], pa.int64()), pa.array([blob], pa.binary())], names=["piece", "shard", "n_ids", "blob"])

        size = 0
        for p, key, own in encoded(batches):
            if held and size >= shard_ids:
                yield close()
                number, first = number + 1, first + size
                held, keys, size = [], [], 0
            piece = p
            held.append(own)
            keys.append(None if key == _NO_ID else key)
            size += len(own)
        if held:
            yield close()

    ordered = by_ranges(docs, "doc_id", "text", pieces_by_size(docs, "text"))
    return materialize(ordered.mapInArrow(shards, "piece int, shard int, n_ids long, blob binary"), "token-shards")


#: Pieces whose totals are summed together (a power of two); the sums of these groups are then summed in one task.
BLOCK_BITS = 12


def read_ids(shards: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the written shards.

    Places come from expansion lengths, ids by random access, a document at a time. Each piece's first place is the sum
    of those before it, in two steps of windows over one number a piece.
    """
    before = lambda w: F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    totals = shards.groupBy("piece").agg(F.sum("n_ids").alias("n")).withColumn("block", F.shiftright("piece", BLOCK_BITS))
    blocks = totals.groupBy("block").agg(F.sum("n").alias("n")).select("block", before(Window.orderBy("block")).alias("base"))
    within = totals.select("piece", "block", before(Window.partitionBy("block").orderBy("piece")).alias("before"))
    firsts = within.join(blocks, "block").select("piece", (F.col("base") + F.col("before")).alias("before"))

    def decoded(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece, blob in zip(batch["piece"].to_pylist(), batch["blob"], strict=True):
                shard = Shard(blob.as_buffer().to_pybytes())
                at, n = shard.offsets(), len(shard.doc_ids)
                crc = [zlib.crc32(shard.document(i).astype("<u4").tobytes()) for i in range(n)]
                yield pa.record_batch([pa.array([piece] * n, pa.int32()), pa.array(shard.doc_ids, pa.int64()), pa.array(shard.first + at[:-1], pa.int64()), pa.array(np.diff(at), pa.int64()), pa.array(crc, pa.int64())], names=["piece", "doc_id", "own", "n_tokens", "ids_crc32"])

    found = shards.select("piece", "blob").mapInArrow(decoded, "piece int, doc_id long, own long, n_tokens long, ids_crc32 long")
    return found.join(firsts, "piece").select("doc_id", (F.col("own") + F.col("before")).alias("start"), "n_tokens", "ids_crc32")
