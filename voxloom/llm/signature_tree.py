"""N-gram Jaccard self-join with signature trees, exact at its threshold.

1. One pass gives each text a key of 128 bits of its shingle set and adds all shingles into a count sketch of fixed size.
   The sketch only orders shingles, rare ones first; any order is valid. Texts with equal sets are one class, kept once
   from here on, so copies of a text meet nowhere.
2. By prefix filtering, two sets that reach the threshold share one of the first |s| - ceil(0.8 |s|) + 1 shingles of that
   order, so classes meet in buckets of such shingles. Buckets with one class are dropped.
3. Within a group of classes, a signature tree joins them: leaves are sets, nodes hold the OR of their token bitmaps and
   their range of sizes. A dual traversal prunes node pairs by the largest overlap they allow, and pairs that are
   connected already; what reaches the leaves is compared exactly.
4. First each class meets part of its most common bucket (split by hash, so no bucket stays whole in a task), which joins
   most copies of a large group. Then every bucket that still holds two components is joined in full: buckets with equal
   members once, large ones as blocks, where only pairs of different components meet. A member of a small bucket stays
   out if no other component there has a set of a size that could reach the threshold with it.

Sets travel as compressed texts and are computed where they meet: a text takes about a quarter of its shingles' hashes.
Shingles are compared by hashes of 64 bits, whole sets by those of all their shingles.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voxloom.llm.common import U64, fan_out, materialize, shingle_sets, slices, small_batches, text_buffers, text_key
from voxloom.llm.graph import components

#: Likeness in hundredths; classes a block of a large bucket holds.
LIKENESS, BLOCK = 80, 256
#: The count sketch: 2**20 counters, 4 MB wherever it is held.
_BITS, _CHUNK = 20, 4096
_NO_ID = -(1 << 63)


def _per_text(batch: pa.RecordBatch, width: int) -> Iterator[tuple[int, np.ndarray]]:
    """(row, its sorted distinct shingles) of a batch with a text column."""
    data, offsets = text_buffers(batch["text"])
    for lo, hi in slices(offsets):
        for i, s in enumerate(shingle_sets(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], width)):
            yield lo + i, s


def _key(s: np.ndarray) -> bytes:
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest()


_KEYED = "doc_id long, n_shingles long, set_key binary, text_key binary"


def keys_and_sketch(docs: DataFrame, width: int = 5) -> tuple[DataFrame, np.ndarray]:
    """doc_id, n_shingles, set_key (null without words) and text_key of every row, and the counters of all shingles."""

    def gather(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counters = np.zeros(1 << _BITS, np.int64)
        schema = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("set_key", pa.binary()), ("text_key", pa.binary()), ("chunk", pa.int32()), ("counts", pa.binary())])
        for batch in batches:
            keys: list[bytes | None] = []
            sizes = []
            for _, s in _per_text(batch, width):
                sizes.append(len(s))
                keys.append(_key(s) if len(s) else None)
                np.add.at(counters, (s >> U64(64 - _BITS)).astype(np.int64), 1)
            n = len(keys)
            yield pa.RecordBatch.from_arrays([batch["doc_id"].cast(pa.int64()), pa.array(sizes, pa.int64()), pa.array(keys, pa.binary()), batch["text_key"].cast(pa.binary()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary())], schema=schema)
        parts = counters.astype("<u4").reshape(-1, _CHUNK)
        some = np.flatnonzero(parts.any(axis=1))
        n = len(some)
        yield pa.RecordBatch.from_arrays([pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.binary()), pa.nulls(n, pa.binary()), pa.array(some, pa.int32()), pa.array([parts[i].tobytes() for i in some], pa.binary())], schema=schema)

    both = materialize(docs.select("doc_id", "text", text_key(F.col("text")).alias("text_key")).mapInArrow(gather, f"{_KEYED}, chunk int, counts binary"), "shingle-sets")

    def add(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for chunk, raw in zip(batch["chunk"].to_pylist(), batch["counts"].to_pylist(), strict=True):
                total[chunk] = total.get(chunk, 0) + np.frombuffer(raw, "<u4").astype(np.int64)
        yield pa.record_batch([pa.array(list(total), pa.int32()), pa.array([np.minimum(x, 2**32 - 1).astype("<u4").tobytes() for x in total.values()], pa.binary())], names=["chunk", "counts"])

    parts = both.where("chunk is not null").select("chunk", "counts").repartition(fan_out(docs.sparkSession), "chunk").mapInArrow(add, "chunk int, counts binary").collect()
    counters = np.zeros(((1 << _BITS) // _CHUNK, _CHUNK), np.uint32)
    for r in parts:
        counters[r["chunk"]] = np.frombuffer(r["counts"], "<u4")
    return both.where("chunk is null").select("doc_id", "n_shingles", "set_key", "text_key"), counters.ravel()


def classes_of(docs: DataFrame, keyed: DataFrame) -> DataFrame:
    """node (a number of its own), set_key, size and compressed text of every class of equal sets, from one of its texts.

    Only the text chosen for a class is joined with its key, so a class of many copies is as light as any other.
    """
    chosen = keyed.where("set_key is not null").groupBy("set_key").agg(F.min(F.struct("doc_id", "text_key", "n_shingles")).alias("k")).select("set_key", "k.*")

    def pack(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor()
        for batch in batches:
            yield pa.record_batch([batch["doc_id"].cast(pa.int64()), batch["text_key"].cast(pa.binary()), pa.array([press.compress((x or "").encode()) for x in batch["text"].to_pylist()], pa.binary())], names=["doc_id", "text_key", "packed"])

    texts = docs.select("doc_id", text_key(F.col("text")).alias("text_key"), "text").mapInArrow(pack, "doc_id long, text_key binary, packed binary")
    found = texts.hint("merge").join(chosen, ["doc_id", "text_key"]).select("set_key", F.col("n_shingles").alias("size"), "packed")

    def first(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows repeated in full follow one another here, unless their partition was split: one of each."""
        seen = None
        for batch in batches:
            keys = batch["set_key"].to_pylist()
            fresh = [k != before for k, before in zip(keys, [seen, *keys])]
            seen = keys[-1] if keys else seen
            yield batch.filter(pa.array(fresh, pa.bool_()))

    once = found.sortWithinPartitions("set_key").mapInArrow(first, "set_key binary, size long, packed binary")
    return materialize(once.withColumn("node", F.monotonically_increasing_id()), "sets")


def prefix(s: np.ndarray, counters: np.ndarray) -> np.ndarray:
    """The first shingles in the order of counter, then value: as many as must share one with any set that links."""
    n = len(s) - (LIKENESS * len(s) + 99) // 100 + 1
    return s[np.lexsort((s, counters[(s >> U64(64 - _BITS)).astype(np.int64)]))[:n]]


def _bitmaps(sets: list[np.ndarray]) -> np.ndarray:
    bits = int(np.clip((4 * max(map(len, sets)) - 1).bit_length(), 8, 15))
    out = np.zeros((len(sets), 1 << bits), np.uint8)
    for row, s in zip(out, sets, strict=True):
        row[(s >> U64(64 - bits)).astype(np.int64)] = 1
    return np.packbits(out, axis=1).view(np.uint64)


def tree_join(sets: list[np.ndarray], component: np.ndarray, role: np.ndarray) -> list[tuple[int, int]]:
    """Links (pairs of positions) that connect all sets that link at the threshold, directly or over others.

    Sets of one component, and of equal role 1 or 2, are not compared; role 3 meets all roles.
    """
    n = len(sets)
    order = np.lexsort(([len(s) for s in sets], [int(s[0]) for s in sets], component))
    size = np.array([len(sets[i]) for i in order])
    maps = _bitmaps([sets[i] for i in order])
    levels = [(maps, size, size, size - np.bitwise_count(maps).sum(axis=1, dtype=np.int64), component[order], role[order])]
    while len(levels[-1][1]) > 1:
        levels.append(_parents(*levels[-1]))
    left = right = np.zeros(1, np.int64)
    for depth in range(len(levels) - 1, -1, -1):
        left, right = _prune(levels[depth], left, right)
        if depth:
            a = np.concatenate([2 * left, 2 * left, 2 * left + 1, (2 * left + 1)[left != right]])
            b = np.concatenate([2 * right, 2 * right + 1, 2 * right + 1, (2 * right)[left != right]])
            fits = (a < len(levels[depth - 1][1])) & (b < len(levels[depth - 1][1]))
            left, right = a[fits], b[fits]
    apart = left != right
    left, right = left[apart], right[apart]
    near = np.argsort(right - left, kind="stable")
    left, right = left[near], right[near]
    label = component[order].copy()
    links = []
    at = 0
    while at < len(left):
        if at % 128 == 0 and at:
            open_ = label[left[at:]] != label[right[at:]]
            left, right, at = left[at:][open_], right[at:][open_], 0
            if not len(left):
                break
        i, j = int(left[at]), int(right[at])
        at += 1
        if label[i] == label[j]:
            continue
        a, b = sets[order[i]], sets[order[j]]
        both = len(np.intersect1d(a, b, assume_unique=True))
        if 100 * both >= LIKENESS * (len(a) + len(b) - both):
            links.append((int(order[i]), int(order[j])))
            label[label == label[j]] = label[i]
    return links


def _parents(maps: np.ndarray, low: np.ndarray, high: np.ndarray, excess: np.ndarray, component: np.ndarray, role: np.ndarray) -> tuple:
    """The next level: children 2i and 2i + 1 of node i combined; component -1 if they differ."""
    pair = lambda f, x: np.concatenate([f(x[: len(x) // 2 * 2 : 2], x[1::2]), x[len(x) // 2 * 2 :]])
    one = lambda a, b: np.where(a == b, a, _NO_ID)
    return pair(np.bitwise_or, maps), pair(np.minimum, low), pair(np.maximum, high), pair(np.maximum, excess), pair(one, component), pair(np.bitwise_or, role)


def _prune(level: tuple, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    maps, low, high, excess, component, role = level
    keep = ~((component[left] == component[right]) & (component[left] != _NO_ID)) & ~((role[left] == role[right]) & (role[left] < 3))
    keep &= (100 * high[left] >= LIKENESS * low[right]) & (100 * high[right] >= LIKENESS * low[left])
    left, right = left[keep], right[keep]
    kept = []
    step = max(1, (1 << 21) // maps.shape[1])
    for k in range(0, len(left), step):
        a, b = left[k : k + step], right[k : k + step]
        common = np.bitwise_count(maps[a] & maps[b]).sum(axis=1, dtype=np.int64)
        most = np.minimum(np.minimum(high[a], high[b]), common + np.minimum(excess[a], excess[b]))
        kept.append((a == b) | ((100 + LIKENESS) * most >= LIKENESS * (low[a] + low[b])))
    some = np.concatenate(kept) if kept else np.zeros(0, bool)
    return left[some], right[some]


def _join_groups(groups: DataFrame, sets: DataFrame, pieces: int, width: int) -> DataFrame:
    """Links (a, b) within the rows of each `place`; groups: place, node, component, role."""

    def links(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place: int | None = None
        held: list[tuple] = []

        def close() -> pa.RecordBatch:
            found = tree_join(_unpacked([h[3] for h in held], width), np.array([h[1] for h in held]), np.array([h[2] for h in held])) if len(held) > 1 else []
            return pa.record_batch([pa.array([held[i][0] for i, _ in found], pa.int64()), pa.array([held[j][0] for _, j in found], pa.int64())], names=["a", "b"])

        for batch in batches:
            for p, key, component, role, packed in zip(*(batch[c].to_pylist() for c in ("place", "node", "component", "role", "packed")), strict=True):
                if held and p != place:
                    yield close()
                    held = []
                place = p
                held.append((key, component, role, packed))
        if held:
            yield close()

    rows = groups.join(sets, "node").select("place", "node", "component", "role", "packed")
    return rows.repartition(pieces, "place").sortWithinPartitions("place", "node").mapInArrow(links, "a long, b long")


def link(docs: DataFrame, width: int = 5) -> DataFrame:
    """doc_id, n_shingles, component_id of every row: components only. Pairs already connected are not compared, so neither all links nor their number are known.

    A text with fewer than `width` words has its whole sequence as its one shingle; without words, or null, it has none
    and links with nothing. Rows that share a doc_id link by their texts alone. A null doc_id counts as the least and is null again in the result.
    """
    member = _members(docs, width)
    least = member.where("component is not null").groupBy("component").agg(F.min("doc_id").alias("component_id"))
    least = materialize(least, "least")  # so that the join below may split a large component
    out = member.join(least, "component", "left")
    real = lambda c: F.when(F.col(c) != _NO_ID, F.col(c)).alias(c)
    return out.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id")).select(real("doc_id"), "n_shingles", real("component_id"))


def keep_one(docs: DataFrame, width: int = 5) -> DataFrame:
    """The columns of docs: of each component exactly the row of least doc_id (null first), then text hash; all rows without words."""
    columns = docs.columns
    member = _members(docs, width).where("component is not null")
    kept = member.groupBy("component").agg(F.min(F.struct("doc_id", "text_key")).alias("k")).select(F.col("k.doc_id").alias("_id"), F.col("k.text_key").alias("_key"))
    worded = F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    rows = docs.where(worded).withColumn("_id", F.coalesce("doc_id", F.lit(_NO_ID))).withColumn("_key", text_key(F.col("text")))
    rows = rows.join(kept, ["_id", "_key"], "left_semi").dropDuplicates(["_id", "_key"])
    return rows.select(*columns).unionByName(docs.where(~worded))


def _members(docs: DataFrame, width: int) -> DataFrame:
    """doc_id (null as the least), n_shingles, set_key, text_key and component (null without words) of every row."""
    spark = docs.sparkSession
    small_batches(spark)
    docs = docs.select(F.coalesce("doc_id", F.lit(_NO_ID)).alias("doc_id"), "text")
    keyed, counters = keys_and_sketch(docs, width)
    sets = classes_of(docs, keyed)
    pieces = 2 * fan_out(spark)

    def postings(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [prefix(s, counters) for s in _unpacked(batch["packed"].to_pylist(), width)]
            tokens = np.concatenate([np.zeros(0, U64), *found])
            yield pa.record_batch([pa.array(tokens.view(np.int64)), pa.array(np.repeat(batch["node"].to_numpy(zero_copy_only=False), [len(p) for p in found]), pa.int64())], names=["token", "node"])

    met = sets.select("node", "packed").mapInArrow(postings, "token long, node long")
    met = materialize(met.withColumn("n", F.count("*").over(Window.partitionBy("token"))).where("n > 1"), "buckets")

    most = met.groupBy("node").agg(F.max(F.struct("n", "token")).alias("m")).select("node", "m.n", "m.token")
    first = most.select(F.xxhash64("token", _share("n")).alias("place"), "node", F.col("node").alias("component"), F.lit(3).alias("role"))
    edges = materialize(_join_groups(first, sets, pieces, width), "links")
    known = components(edges)

    labelled = materialize(_labels(met, known), "labelled")
    mixed = labelled.groupBy("token").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.max("n").alias("n")).where("lo < hi")
    open_ = _with_bucket(labelled, mixed.select("token", "n"))
    small = open_.where(F.col("n") <= BLOCK).join(sets.select("node", "size"), "node")
    lists = small.groupBy("token").agg(F.array_sort(F.collect_list(F.struct("node", "component", "size"))).alias("members"))
    lists = lists.select(F.filter("members", lambda m: F.exists("members", lambda o: _could_link(m, o))).alias("members")).where(F.size("members") > 1).distinct()
    small = lists.select(F.xxhash64("members").alias("place"), F.explode("members").alias("m")).select("place", "m.node", "m.component", F.lit(3).alias("role"))
    large = _blocks(open_.where(F.col("n") > BLOCK))
    more = materialize(_join_groups(small.unionByName(large), sets, pieces, width), "links")
    final = components(edges.union(more))

    named = _labels(sets.select("node", "set_key"), final).groupBy("set_key").agg(F.min("component").alias("component"))
    named = materialize(named, "named")  # so that the join below may split a large class of copies
    return keyed.join(named, "set_key", "left")


def _share(n: str) -> Column:
    """Which block of its bucket of n classes a class falls into."""
    return F.pmod(F.xxhash64("node"), F.ceil(F.col(n) / BLOCK))


def _with_bucket(rows: DataFrame, buckets: DataFrame) -> DataFrame:
    """rows (token, n, node) joined with one row a bucket, block by block, so that no bucket meets in one task."""
    blocks = buckets.withColumn("share", F.explode(F.sequence(F.lit(0).cast("bigint"), F.ceil(F.col("n") / BLOCK) - 1))).drop("n")
    return rows.withColumn("share", _share("n")).join(blocks, ["token", "share"]).drop("share")


def _labels(nodes: DataFrame, known: DataFrame) -> DataFrame:
    """nodes with the component of each: itself where no link is known."""
    return nodes.join(known.withColumnRenamed("component", "linked"), "node", "left").withColumn("component", F.coalesce("linked", "node")).drop("linked")


def _could_link(a: Column, b: Column) -> Column:
    """Whether members of different components have sizes that allow the threshold."""
    return (a["component"] != b["component"]) & (100 * a["size"] >= LIKENESS * b["size"]) & (100 * b["size"] >= LIKENESS * a["size"])


def _unpacked(packed: list[bytes], width: int) -> list[np.ndarray]:
    """The sets of compressed texts."""
    undo = zstandard.ZstdDecompressor()
    raw = [undo.decompress(x) for x in packed]
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in raw])]).astype(np.int64)
    data = np.frombuffer(b"".join(raw), np.uint8)
    return [s for lo, hi in slices(offsets) for s in shingle_sets(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], width)]


def _blocks(rows: DataFrame) -> DataFrame:
    """Large buckets: the largest component in blocks against the others in blocks, and the others among themselves."""
    share = rows.groupBy("token", "component").agg(F.count("*").alias("k"), F.max("n").alias("n"))
    main = share.groupBy("token").agg(F.max(F.struct("k", "component")).alias("m"), F.max("n").alias("n")).select("token", "n", F.col("m.component").alias("main"), F.col("m.k").alias("k"))
    rows = _with_bucket(rows, main).withColumn("inside", F.ceil(F.col("k") / BLOCK)).withColumn("outside", F.ceil((F.col("n") - F.col("k")) / BLOCK))
    is_main = F.col("component") == F.col("main")
    at = lambda n: F.pmod(F.xxhash64("node"), F.col(n))
    series = lambda n: F.sequence(F.lit(0).cast("bigint"), F.col(n) - 1)
    cross = rows.withColumn("i", F.explode(F.when(is_main, F.array(at("inside"))).otherwise(series("inside")))).withColumn("j", F.explode(F.when(is_main, series("outside")).otherwise(F.array(at("outside")))))
    cross = cross.select(F.xxhash64("token", F.lit("cross"), "i", "j").alias("place"), "node", "component", F.when(is_main, 1).otherwise(2).alias("role"))
    others = rows.where(~is_main).withColumn("i", at("outside")).withColumn("j", F.explode(series("outside")))
    others = others.select(F.xxhash64("token", F.lit("others"), F.least("i", "j"), F.greatest("i", "j")).alias("place"), "node", "component", F.lit(3).alias("role"))
    return cross.unionByName(others)
