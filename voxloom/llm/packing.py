"""Best-fit packing by exact-complement hashing over the histogram of piece lengths.

Pieces are interchangeable within a length, so a plan is made on counts alone: at most `width` numbers, whatever the
corpus. Lengths go from long to short; each gap is looked up in an index of the single, pair and triple sums of the
lengths still available, and as many combinations as the counts allow are consumed at once, which updates the index.
What has no exact complement is packed best fit. Pieces then find their slot by their rank within their length.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from voxloom.llm.common import fan_out, materialize, small_batches, text_buffers
from voxloom.llm.tokens import encoder


@dataclass(frozen=True)
class Plan:
    """Slots in order of length and rank: ranks [first, next slot's first) of a length go to sequence + (rank - first) // each,
    at `offset` + (rank - first) % each * length. `each`: pieces of that length side by side in one sequence of the pattern."""

    length: np.ndarray
    first: np.ndarray
    sequence: np.ndarray
    offset: np.ndarray
    each: np.ndarray
    sequences: int

    def place(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sequence and offset of the pieces with these lengths and ranks."""
        wide = np.int64(1) << 40
        slot = np.searchsorted(self.length * wide + self.first, length * wide + rank, "right") - 1
        past = rank - self.first[slot]
        return self.sequence[slot] + past // self.each[slot], self.offset[slot] + past % self.each[slot] * length


class SumIndex:
    """Available lengths by their sums: `have[s]` single lengths, `pairs[s]` distinct pairs {a, b} with a + b = s.

    A triple of sum s is a length c with a pair of sum s - c, so the two tables index triples too. The pair table
    changes only where a length comes to or falls below one or two available pieces.
    """

    def __init__(self, have: np.ndarray) -> None:
        self.width = len(have) - 1
        self.have = np.zeros_like(have)
        self.pairs = np.zeros(2 * len(have), np.int64)
        for x in np.flatnonzero(have).tolist():
            self.add(x, int(have[x]))

    def add(self, x: int, n: int) -> None:
        """n more pieces of length x, or fewer where n is negative."""
        before, after = int(self.have[x]), int(self.have[x] + n)
        if (before > 0) != (after > 0):
            others = np.flatnonzero(self.have)
            self.pairs[x + others[others != x]] += 1 if after > 0 else -1
        self.pairs[2 * x] += int(after > 1) - int(before > 1)
        self.have[x] = after

    def _pair(self, total: int, most: int) -> list[int] | None:
        """The pair of this sum with the longest first length, at most `most`."""
        if not self.pairs[total]:
            return None
        a = np.arange(min(most, total - 1), (total - 1) // 2, -1)
        a = a[(self.have[a] > 0) & (self.have[total - a] > 0) & ((2 * a != total) | (self.have[a] > 1))]
        return [int(a[0]), total - int(a[0])] if len(a) else None

    def complement(self, top: int) -> list[int] | None:
        """Lengths that fill the gap beside one piece of length `top` exactly: none, one, two or three, long ones first."""
        gap = self.width - top
        if gap == 0:
            return []
        self.add(top, -1)
        found = [gap] if self.have[gap] else self._pair(gap, gap)
        if found is None:
            c = np.arange(gap - 2, 0, -1)
            for x in c[(self.have[c] > 0) & (self.pairs[gap - c] > 0)].tolist():
                self.add(x, -1)
                two = self._pair(gap - x, x)
                self.add(x, 1)
                if two:
                    found = [x, *two]
                    break
        self.add(top, 1)
        return found


def make_plan(counts: dict[int, int], width: int = 2048) -> Plan:
    """Patterns (multisets of lengths) with how often each is used; every piece of the histogram is in one pattern."""
    start = np.zeros(width + 1, np.int64)
    for length, n in counts.items():
        start[length] = n
    index = SumIndex(start)
    have = index.have
    patterns: list[tuple[dict[int, int], int]] = []

    def use(lengths: list[int]) -> None:
        needs = {x: lengths.count(x) for x in lengths}
        times = min(int(have[x]) // k for x, k in needs.items())
        for x, k in needs.items():
            index.add(x, -k * times)
        patterns.append((needs, times))

    rest: list[tuple[int, int]] = []
    for top in range(width, 0, -1):
        while have[top]:
            found = index.complement(top)
            if found is None:
                rest.append((top, int(have[top])))
                index.add(top, -int(have[top]))
            else:
                use([top, *found])
    for length, n in rest:
        index.add(length, n)
    for top in range(width, 0, -1):
        while have[top]:
            chosen = [top]
            have[top] -= 1
            gap = width - top
            while gap and len(fits := np.flatnonzero(have[1 : gap + 1])):
                x = int(fits[-1]) + 1  # best fit: the longest that still goes in
                chosen.append(x)
                have[x] -= 1
                gap -= x
            for x in chosen:
                have[x] += 1  # as the index still has it
            use(chosen)
    slots, sequence, used = [], 0, np.zeros(width + 1, np.int64)
    for needs, times in patterns:
        offset = 0
        for x, k in needs.items():
            slots.append((x, int(used[x]), sequence, offset, k))
            used[x] += k * times
            offset += x * k
        sequence += times
    slots.sort()
    columns = np.array(slots, np.int64).reshape(-1, 5).T
    return Plan(*columns, sequence)


def pieces(docs: DataFrame, tokenizer: str, width: int = 2048) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every piece: a text's ids, then 0, cut only where longer than width.

    A null or empty text is one piece of length 1. Rows that share a doc_id are cut each for itself.
    """
    small_batches(docs.sparkSession)

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer).encode
        for batch in batches:
            ids, at = encode(*text_buffers(batch["text"]))
            keys = batch["doc_id"].to_pylist()
            rows: list[list] = [[], [], [], [], []]
            for key, a, b in zip(keys, at[:-1].tolist(), at[1:].tolist(), strict=True):
                own = np.append(ids[a:b], np.uint32(0)).astype("<u4")
                for k, s in enumerate(range(0, len(own), width)):
                    part = own[s : s + width]
                    for column, value in zip(rows, (key, k, s, len(part), zlib.crc32(part.tobytes())), strict=True):
                        column.append(value)
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.record_batch([pa.array(x, kind) for x, kind in zip(rows, kinds, strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select("doc_id", "text").mapInArrow(cut, "doc_id long, piece int, start long, length long, ids_crc32 long")


def pack(cut: DataFrame, width: int = 2048) -> DataFrame:
    """The pieces with sequence_id and offset. Sequences are gapless from offset 0 and no longer than width.

    Ranks: pieces are dealt into groups by a hash of doc_id and piece; a group counts its lengths, groups' counts give
    each group its first rank of each length, and rows are numbered within group and length. So no length, however
    common, meets in one task. The driver holds one count for each length.
    """
    spark = cut.sparkSession
    cut = materialize(cut, "pieces")
    groups = 4 * fan_out(spark)
    cut = cut.withColumn("group", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(groups)).cast("int"))
    by_group = cut.groupBy("length", "group").agg(F.count("*").alias("n"))
    plan = make_plan({r["length"]: r["n"] for r in by_group.groupBy("length").agg(F.sum("n").alias("n")).collect()}, width)
    before = by_group.withColumn("before", F.sum("n").over(Window.partitionBy("length").orderBy("group")) - F.col("n")).select("length", "group", "before")
    within = F.row_number().over(Window.partitionBy("length", "group").orderBy("doc_id", "piece", "start", "ids_crc32")) - 1
    ranked = cut.join(before, ["length", "group"]).withColumn("rank", F.col("before") + within)

    def placed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sequence, offset = plan.place(batch["length"].to_numpy(), batch["rank"].to_numpy()) if batch.num_rows else (np.zeros(0, np.int64),) * 2
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(sequence, pa.int64()), pa.array(offset, pa.int64())], names=[*batch.schema.names[:5], "sequence_id", "offset"])

    return ranked.select("doc_id", "piece", "start", "length", "ids_crc32", "rank").mapInArrow(placed, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def pack_documents(docs: DataFrame, tokenizer: str, width: int = 2048) -> DataFrame:
    """pack() of pieces(): a row for each piece of each row of docs, none for an empty table; other columns are not read."""
    return pack(pieces(docs, tokenizer, width), width)
