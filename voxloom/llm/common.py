"""Shared helpers: Arrow batches, hashing of words and shingles in numpy, written intermediate tables."""

from __future__ import annotations

import hashlib
import os
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

U64 = np.uint64
#: Bytes handled by one numpy step; bounds the temporary arrays (8 bytes for each byte and array).
STEP = 1 << 20
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BASE = 0x9E3779B97F4A7C15 | 1
_power = np.ones(1, U64)
_inverse = np.ones(1, U64)


def small_batches(spark: SparkSession, rows: int = 512) -> None:
    """Arrow batches of few rows: a text may be very long."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "8m")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def fan_out(spark: SparkSession) -> int:
    """How many pieces keyed work is dealt into: the session's shuffle partitions, which the cluster sizes to its input."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def checkpoint_root(spark: SparkSession) -> str:
    """The folder that driver and executors share, from spark.checkpoint.dir.

    Where the session names none, a folder of this machine serves on a local master alone; on a cluster this raises.
    """
    at = spark.conf.get("spark.checkpoint.dir", None)
    if at:
        return at.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return f"file://{os.path.join(tempfile.gettempdir(), 'voxloom-checkpoints')}"


def text_key(text: Column) -> Column:
    """128 bits that name a text: half of its SHA-256 digest; null is named as the empty text."""
    return F.substring(F.unhex(F.sha2(F.coalesce(text, F.lit("")), 256)), 1, 16)


#: Bytes of input that one task of keyed work is meant to hold.
TASK_BYTES = 24 << 20


def pieces_by_size(df: DataFrame, column: str) -> int:
    """Tasks for keyed work on a text column: enough that each reads about TASK_BYTES, and no fewer than the session's."""
    total = df.agg(F.sum(F.octet_length(column))).first()[0] or 0
    return max(fan_out(df.sparkSession), -(-total // TASK_BYTES))


def materialize(df: DataFrame, name: str, *by: str) -> DataFrame:
    """Write once to the shared folder, in folders by the columns `by`, and read back: cuts the lineage, survives lost executors.

    The tables stay until the folder of the application is removed, for a later action on the result reads them again.
    """
    spark = df.sparkSession
    path = f"{checkpoint_root(spark)}/voxloom-{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    (df.write.partitionBy(*by) if by else df.write).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column and its n + 1 offsets; null is empty."""
    column = pc.fill_null(column, "") if column.null_count else column
    column = column.cast(pa.large_binary())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if offsets else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    if len(at) == 0:
        at = np.zeros(1, np.int64)
    return raw[at[0] : at[-1]], at - at[0]


def text_list(column: pa.Array) -> list[str]:
    return [x or "" for x in column.to_pylist()]


def slices(offsets: np.ndarray, most: int = STEP) -> Iterator[tuple[int, int]]:
    """Runs of rows of about `most` bytes together; a longer row comes alone."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + most, "right")) - 1)
        yield lo, min(hi, n)
        lo = min(hi, n)


def mix(h: np.ndarray) -> np.ndarray:
    """64-bit finaliser (splitmix64)."""
    h = h ^ (h >> U64(30))
    h *= U64(0xBF58476D1CE4E5B9)
    h ^= h >> U64(27)
    h *= U64(0x94D049BB133111EB)
    h ^= h >> U64(31)
    return h


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base modulo 2**64 and of its inverse, at least n of each."""
    global _power, _inverse
    if len(_power) < n:
        n = max(n, STEP + (1 << 12))
        with np.errstate(over="ignore"):
            _power = np.cumprod(np.concatenate([[U64(1)], np.full(n - 1, _BASE, U64)]), dtype=U64)
            _inverse = np.cumprod(np.concatenate([[U64(1)], np.full(n - 1, pow(_BASE, -1, 1 << 64), U64)]), dtype=U64)
    return _power, _inverse


def prefix_sums(data: np.ndarray) -> np.ndarray:
    """n + 1 polynomial prefix sums; (p[j] - p[i]) * inverse[i] hashes data[i:j]."""
    power, _ = powers(len(data) + 1)
    out = np.zeros(len(data) + 1, U64)
    np.cumsum((data.astype(U64) + U64(1)) * power[: len(data)], out=out[1:])
    return out


_KEEP = np.array([(1 << 8 * k) - 1 for k in range(9)], U64)
#: Bytes up to which a word is hashed in numpy; blake2b hashes longer ones.
_SHORT = 64


def span_hashes(data: np.ndarray, lo: np.ndarray, hi: np.ndarray, both: bool = False) -> tuple[np.ndarray, np.ndarray | None]:
    """A 64-bit hash of each data[lo:hi] and, with `both`, a second one by other constants, so that the two make 128 bits.

    Blocks of 8 bytes go through a nonlinear mixer one after the other, so no family of words collides by its structure.
    """
    size = hi - lo
    block = np.ndarray((len(data) + 1,), "<u8", np.concatenate([data, np.zeros(8, np.uint8)]), strides=(1,))
    h = mix(size.astype(U64) * U64(0xD6E8FEB86659FD93) + U64(0x9E3779B97F4A7C15))
    second = mix(size.astype(U64) * U64(0xA0761D6478BD642F) + U64(0xE7037ED1A0B428DB)) if both else None
    who, at, j = np.flatnonzero(size <= _SHORT), lo, 0
    if len(who) == len(size):
        who = slice(None)
    while True:
        left = size[who] - 8 * j
        b = block[at[who] + 8 * j] & _KEEP[np.minimum(left, 8)]
        h[who] = mix(h[who] ^ b)
        if both:
            second[who] = mix((second[who] ^ b) * U64(0x8EBC6AF09C88C6E3))
        more = left > 8
        if not more.any():
            break
        who = (np.arange(len(size)) if isinstance(who, slice) else who)[more]
        j += 1
    for i in np.flatnonzero(size > _SHORT).tolist():
        raw = hashlib.blake2b(data[lo[i] : hi[i]].tobytes(), digest_size=16).digest()
        h[i] = int.from_bytes(raw[:8], "little")
        if both:
            second[i] = int.from_bytes(raw[8:], "little")
    return h, second


def _words(data: np.ndarray, starts: np.ndarray, separator: np.ndarray, fold: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and hash of each maximal run without separators; `starts`: where rows begin."""
    inside = ~separator[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    cut = starts[starts < len(data)]
    first[cut] = inside[cut]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    cut = cut[cut > 0] - 1
    last[cut] = inside[cut]
    lo, hi = np.flatnonzero(first), np.flatnonzero(last) + 1
    return lo, hi, span_hashes(fold[data], lo, hi)[0]


def words(data: np.ndarray, offsets: np.ndarray, separator: np.ndarray = _SPACE, fold: np.ndarray = _LOWER) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word of every row, in order, and each row's n + 1 places in it.

    Words are maximal runs of bytes that are no separators, after folding.
    Long rows are read in steps that end at a separator, so memory stays bounded unless one word is longer.
    """
    hashes, counts = [], np.zeros(len(offsets) - 1, np.int64)
    for lo, hi in slices(offsets):
        a, b = int(offsets[lo]), int(offsets[hi])
        while True:
            c = b
            if b - a > 2 * STEP:  # one long row
                c = a + STEP
                while c < b and not separator[data[c]]:
                    c += 1
            starts = np.array([0]) if hi - lo == 1 else offsets[lo:hi] - a
            at, _, h = _words(data[a:c], starts, separator, fold)
            hashes.append(h)
            counts[lo:hi] += np.diff(np.searchsorted(at, np.append(starts, c - a)))
            if c >= b:
                break
            a = c
    return (np.concatenate(hashes) if hashes else np.zeros(0, U64)), np.concatenate([[0], np.cumsum(counts)])


def shingles(data: np.ndarray, offsets: np.ndarray, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every run of `width` words of every row, and each row's n + 1 places.

    A row with fewer words has its whole sequence as one; a row without words has none.
    """
    w, at = words(data, offsets)
    n = np.diff(at)
    h = np.zeros(max(0, len(w) - width + 1), U64)
    for j in range(width):
        h += w[j : j + len(h)] * U64(pow(0xC2B2AE3D27D4EB4F, j + 1, 1 << 64))
    count = np.where(n >= width, n - width + 1, np.minimum(n, 1))
    out_at = np.concatenate([[0], np.cumsum(count)])
    first = np.repeat(at[:-1], count) + np.arange(out_at[-1]) - np.repeat(out_at[:-1], count)
    out = np.zeros(out_at[-1], U64)
    full = np.repeat(n >= width, count)
    out[full] = mix(h[first[full]])
    for d in np.flatnonzero((n > 0) & (n < width)):
        value = n[d : d + 1].astype(U64)
        for x in w[at[d] : at[d + 1]]:
            value = mix(value * U64(0xFF51AFD7ED558CCD) + x)
        out[out_at[d]] = value[0]
    return out, out_at


def shingle_sets(data: np.ndarray, offsets: np.ndarray, width: int = 5) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each row."""
    h, at = shingles(data, offsets, width)
    return [np.unique(h[a:b]) for a, b in zip(at[:-1], at[1:], strict=True)]


def ragged(lengths: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Indices starts[i], starts[i] + 1, ... of each run, one run after the other."""
    total = int(lengths.sum())
    ends = np.cumsum(lengths)
    return np.arange(total) + np.repeat(starts - (ends - lengths), lengths)


def by_ranges(rows: DataFrame, key: str, text: str, pieces: int) -> DataFrame:
    """`rows` in order of the key, null first, in `pieces` partitions of about equal rows, with `piece`, the number of the partition.

    Rows of one key follow by a hash of their text and are dealt over partitions too; Spark samples the ranges, so the plan
    stays as small as it is however many there are.
    """
    placed = rows.withColumn("tie", F.xxhash64(text)).withColumn("place", F.monotonically_increasing_id())
    order = (key, "tie", "place")
    return placed.repartitionByRange(pieces, *order).sortWithinPartitions(*order).withColumn("piece", F.spark_partition_id()).drop("tie", "place")
