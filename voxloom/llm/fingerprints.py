"""One-permutation MinHash with optimal densification and packed low-order bits.

Each shingle is hashed once: the top bits name a bin, the rest compete for the bin's minimum.
Empty bins borrow from a bin found by a hash of (bin, attempt) alone, so equal sets borrow alike.
Only the low `bits` of each minimum are kept; the likeness corrects for their chance agreement.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from voxloom.llm.common import STEP, U64, by_ranges, materialize, mix, pieces_by_size, shingles, slices, small_batches, text_list


@dataclass(frozen=True)
class Sketcher:
    """bins: a power of two up to 256; bits: 1, 2, 4 or 8."""

    bins: int = 256
    bits: int = 8
    width: int = 5

    def packed(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """A row of packed bytes for each text, and a last byte that is 1 if the text has words."""
        rows = [self._block(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]) for lo, hi in slices(offsets) for a, b in _at_most(lo, hi, 4096)]
        return np.concatenate(rows) if rows else np.zeros((0, self.bins * self.bits // 8 + 1), np.uint8)

    def _block(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        h, at = shingles(data, offsets, self.width)
        n, shift = len(offsets) - 1, U64(64 - (self.bins.bit_length() - 1))
        row = np.repeat(np.arange(n, dtype=U64), np.diff(at))
        key = (row << U64(52)) | ((h >> shift) << U64(44)) | (h & U64((1 << 44) - 1))
        key.sort()
        slot = key >> U64(44)
        new = np.ones(len(key), bool)
        new[1:] = slot[1:] != slot[:-1]
        least = np.zeros(n * 256, U64)
        full = np.zeros(n * 256, bool)
        least[slot[new]] = key[new] & U64((1 << 44) - 1)
        full[slot[new]] = True
        least, full = least.reshape(n, 256)[:, : self.bins], full.reshape(n, 256)[:, : self.bins]
        some = full.any(axis=1)
        self._densify(least, full, some)
        low = (least & U64((1 << self.bits) - 1)).astype(np.uint8)
        planes = np.unpackbits(low[:, :, None], axis=2)[:, :, 8 - self.bits :].reshape(n, -1)
        out = np.packbits(planes, axis=1)
        out[~some] = 0
        return np.concatenate([out, some[:, None].astype(np.uint8)], axis=1)

    def _densify(self, least: np.ndarray, full: np.ndarray, some: np.ndarray) -> None:
        row, to = np.nonzero(~full & some[:, None])
        attempt = 0
        while len(row):
            attempt += 1
            if attempt <= 4 * self.bins:
                source = (mix((to * 65536 + attempt).astype(U64)) & U64(self.bins - 1)).astype(np.int64)
            else:  # nearly empty rows: walk on from the last try, which ends for sure
                source = (source + 1) % self.bins
            hit = full[row, source]
            least[row[hit], to[hit]] = least[row[hit], source[hit]]
            row, to, source = row[~hit], to[~hit], source[~hit]

    def likeness(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Estimated Jaccard of packed rows, corrected for chance agreement; two texts without words: 1, one: 0."""
        both, either = (a[:, -1] & b[:, -1]).astype(bool), (a[:, -1] | b[:, -1]).astype(bool)
        differ = np.unpackbits(a[:, :-1] ^ b[:, :-1], axis=1).reshape(len(a), self.bins, self.bits).any(axis=2)
        chance = 2.0**-self.bits
        found = np.clip(((1 - differ.mean(axis=1)) - chance) / (1 - chance), 0, 1)
        return np.where(both, found, np.where(either, 0.0, 1.0))

    def blobs(self, packed: np.ndarray) -> list[bytes]:
        return [x[:-1].tobytes() if x[-1] else b"" for x in packed]

    def of_texts(self, texts: list[bytes]) -> np.ndarray:
        offsets = np.concatenate([[0], np.cumsum([len(x) for x in texts])]).astype(np.int64)
        return self.packed(np.frombuffer(b"".join(texts), np.uint8), offsets)


def _at_most(lo: int, hi: int, n: int) -> Iterator[tuple[int, int]]:
    for a in range(lo, hi, n):
        yield a, min(hi, a + n)


#: Digests and fingerprints are kept as bytes until they are returned.
_RESULT = "doc_id long, n_chars long, edited_sha256 binary, fingerprint binary, edited_fingerprint binary, near_edited double, near_next double"
#: What a row of the written table is: a result, or the first or the last row of a range with its text.
_FOUND, _HEAD, _TAIL = 0, 1, 2


def fingerprint_with_edit(docs: DataFrame, sketcher: Sketcher = Sketcher()) -> DataFrame:
    """Fingerprint every text, the text with its last quarter replaced by the start of the next, and compare.

    The next document is that of the next greater doc_id (of the first, after the last). Rows that share a doc_id
    follow one another by a hash of their text; a null doc_id comes first; a null or empty text has the fingerprint "".
    Texts are shuffled once, to ranges of doc_id; each range compares its own rows and writes out its first and last one.
    The last of each is then joined with the first of the range after it, so no window holds texts and nothing comes to the driver.
    """
    small_batches(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
    ordered = by_ranges(docs, "doc_id", "text", pieces_by_size(docs, "text"))
    written = materialize(ordered.mapInArrow(lambda batches: _stream(batches, sketcher), f"{_RESULT}, kind int, piece int, text string"), "fingerprints")
    heads = written.where(F.col("kind") == _HEAD).select(F.col("piece").alias("next"), F.col("text").alias("after"))
    tails = written.where(F.col("kind") == _TAIL).select("piece", "doc_id", "text")
    by_piece = Window.orderBy("piece")
    following = tails.select("piece", F.coalesce(F.lead("piece").over(by_piece), F.min("piece").over(by_piece)).alias("next"))
    edges = tails.join(following, "piece").join(heads, "next").select("doc_id", "text", "after")
    found = written.where(F.col("kind") == _FOUND).drop("kind", "piece", "text").unionByName(edges.mapInArrow(lambda batches: _across(batches, sketcher), _RESULT))
    name = lambda c: F.replace(F.base64(c), F.lit("\r\n"), F.lit("")).alias(c)
    return found.select("doc_id", "n_chars", F.lower(F.hex("edited_sha256")).alias("edited_sha256"), name("fingerprint"), name("edited_fingerprint"), "near_edited", "near_next")


def _stream(batches: Iterable[pa.RecordBatch], sketcher: Sketcher) -> Iterator[pa.RecordBatch]:
    held: list[tuple[int | None, str]] = []
    piece, size = None, 0
    for batch in batches:
        for piece, doc_id, text in zip(batch["piece"].to_pylist(), batch["doc_id"].to_pylist(), text_list(batch["text"]), strict=True):
            if not held:
                yield _edge(_HEAD, piece, doc_id, text)
            held.append((doc_id, text))
            size += len(text)
            if size >= STEP and len(held) > 1:
                yield _compared(held, sketcher, _FOUND)
                held, size = held[-1:], len(held[-1][1])
    if len(held) > 1:
        yield _compared(held, sketcher, _FOUND)
    if held:
        yield _edge(_TAIL, piece, *held[-1])


def _across(batches: Iterable[pa.RecordBatch], sketcher: Sketcher) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for doc_id, text, after in zip(batch["doc_id"].to_pylist(), text_list(batch["text"]), text_list(batch["after"]), strict=True):
            yield _compared([(doc_id, text), (None, after)], sketcher)


_KINDS = {"doc_id": pa.int64(), "n_chars": pa.int64(), "edited_sha256": pa.binary(), "fingerprint": pa.binary(), "edited_fingerprint": pa.binary(), "near_edited": pa.float64(), "near_next": pa.float64(), "kind": pa.int32(), "piece": pa.int32(), "text": pa.string()}


def _edge(kind: int, piece: int, doc_id: int | None, text: str) -> pa.RecordBatch:
    row = {"doc_id": doc_id, "kind": kind, "piece": piece, "text": text}
    return pa.record_batch([pa.array([row.get(c)], k) for c, k in _KINDS.items()], names=list(_KINDS))


def _compared(rows: list[tuple[int | None, str]], sketcher: Sketcher, kind: int | None = None) -> pa.RecordBatch:
    """The result of every row but the last, each against the one after it; with a kind, as rows of the written table."""
    n = len(rows) - 1
    edited = []
    for (_, text), (_, after) in zip(rows, rows[1:]):
        cut = len(text) // 4
        edited.append((text[: len(text) - cut] + after[:cut]).encode())
    own, changed = sketcher.of_texts([text.encode() for _, text in rows]), sketcher.of_texts(edited)
    columns = [[x for x, _ in rows[:n]], [len(x) for _, x in rows[:n]], [hashlib.sha256(x).digest() for x in edited], sketcher.blobs(own[:n]), sketcher.blobs(changed), sketcher.likeness(own[:n], changed), sketcher.likeness(own[:n], own[1:])]
    if kind is not None:
        columns += [[kind] * n, [None] * n, [None] * n]
    names = list(_KINDS)[: len(columns)]
    return pa.record_batch([pa.array(v, _KINDS[c]) for c, v in zip(names, columns, strict=True)], names=names)
