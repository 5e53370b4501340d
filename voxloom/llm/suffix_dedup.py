"""Removal of bytes that lie in a long string occurring elsewhere, by suffix arrays of shards.

Which strings can repeat is found first. Every string of `length` bytes has one anchor: the k-gram of least hash in it
(a window minimum). Equal strings have equal anchors at equal places, so anchors that occur once rule their strings out,
exactly. Occurrences of the other anchors bring their context, the bytes of all strings anchored there, to the anchor's
shard. A shard builds the suffix array of its contexts (right of the anchor, and reversed to the left of it) over 8-byte
words by Larsson-Sadakane refinement in numpy and the common prefixes by Kasai's rule, all contexts in step. Two
strings with the anchor at distance d from their start are equal if their right parts agree on length - d bytes and
their left parts on d, which the prefixes tell for all d. A hot anchor is split over shards; strings without a partner
in their own shard are then looked up in the sorted strings of all of that anchor's shards by binary search.

Anchors with a thousandth or more of all occurrences are found beforehand (a frequency summary of fixed size a task, at
most 2,000 of them in all), so that the count of occurrences is dealt over many tasks for each of these too.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from voxloom.llm.common import STEP, U64, fan_out, materialize, mix, powers, prefix_sums, ragged, slices, small_batches, text_buffers, text_key

#: Bytes of a string that counts, of an anchor, and anchors that may start in a string.
LENGTH, GRAM = 200, 48
WINDOW = LENGTH - GRAM + 1
#: Occurrences of an anchor that stay in one shard, and contexts a shard holds on average.
HOT, SHARD = 2048, 12_000
#: Counters of a task's frequency summary; an anchor is dealt over many tasks from one occurrence in FREQUENT of all on.
COUNTERS, FREQUENT = 4096, 2000
_PLACE = U64((1 << 24) - 1)


def anchors(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Row, hash, place in the row, and (greatest, least) distance from a string's start packed, of all anchors of all strings."""
    parts = []
    for lo, hi in slices(offsets):
        a, b = int(offsets[lo]), int(offsets[hi])
        if hi - lo > 1 or b - a <= 2 * STEP:
            parts.append(_anchors(data[a:b], offsets[lo : hi + 1] - a, lo, 0))
        else:
            for c in range(a, b - LENGTH + 1, STEP):
                d = min(b, c + STEP + LENGTH - 1)
                parts.append(_anchors(data[c:d], np.array([0, d - c]), lo, c - a))
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True)) if parts else (np.zeros(0, np.int64), np.zeros(0, U64), np.zeros(0, np.int64), np.zeros(0, np.int64))


def _anchors(data: np.ndarray, offsets: np.ndarray, row: int, base: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    sizes = np.maximum(np.diff(offsets) - LENGTH + 1, 0)
    if not sizes.sum():
        return np.zeros(0, np.int64), np.zeros(0, U64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    p = prefix_sums(data)
    _, inverse = powers(len(data) + 1)
    h = mix((p[GRAM:] - p[:-GRAM]) * inverse[: len(data) - GRAM + 1])
    key = (h & ~_PLACE) | np.arange(len(h), dtype=U64)
    blocks = np.full(-(-len(key) // WINDOW) * WINDOW, ~U64(0), U64)
    blocks[: len(key)] = key
    blocks = blocks.reshape(-1, WINDOW)
    ahead = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    behind = np.minimum.accumulate(blocks, axis=1).ravel()
    start = ragged(sizes, offsets[:-1])
    at = (np.minimum(ahead[start], behind[start + WINDOW - 1]) & _PLACE).astype(np.int64)
    new = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
    at, first, last = at[new], start[new], start[np.append(new[1:], len(start)) - 1]
    own = np.searchsorted(offsets, at, "right") - 1
    return own + row, h[at], at - offsets[own] + base, (at - first) << 8 | (at - last)


def suffix_array(text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(suffix array, rank of each suffix) of a text of small integers, by Larsson-Sadakane refinement.

    Suffixes are sorted by their first symbol; then groups that are not yet sorted, and only those, are sorted by the
    rank of the suffix h later, with h doubling. A group's rank is the place of its last suffix.
    """
    order = np.argsort(text, kind="stable")
    n = len(text)
    rank = np.zeros(n, np.int64)
    edge = np.concatenate([text[order[1:]] != text[order[:-1]], [True]])
    last = np.flatnonzero(edge)
    rank[order] = last[np.cumsum(edge) - edge]
    sized = np.diff(np.concatenate([[-1], last]))
    open_ = np.repeat(sized > 1, sized)
    h = 1
    while open_.any():
        place = np.flatnonzero(open_)
        suffix = order[place]
        after = suffix + h
        key = rank[suffix] << 32 | np.where(after < n, rank[np.minimum(after, n - 1)] + 1, 0)
        by = np.argsort(key, kind="stable")
        suffix, key = suffix[by], key[by]
        order[place] = suffix
        edge = np.concatenate([key[1:] != key[:-1], [True]])
        last = np.flatnonzero(edge)
        rank[suffix] = place[last][np.cumsum(edge) - edge]
        sized = np.diff(np.concatenate([[-1], last]))
        open_[place] = np.repeat(sized > 1, sized)
        h *= 2
    return order, rank


def common_prefixes(text: np.ndarray, order: np.ndarray, rank: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """By place in the suffix array: symbols shared with the suffix before it, by Kasai's rule in parallel lanes.

    From one suffix of a lane to the next the shared length falls by one at most, so each lane goes on from its last.
    """
    out = np.zeros(len(text), np.int64)
    shared = np.zeros(len(starts), np.int64)
    n = len(text)
    for j in range(int(sizes.max(initial=0))):
        lane = np.flatnonzero(sizes > j)
        i = starts[lane] + j
        place = rank[i]
        before = order[np.maximum(place - 1, 0)]
        h = np.where(place > 0, np.maximum(shared[lane] - 1, 0), 0)
        going = np.flatnonzero(place > 0)
        while len(going):
            x, y = i[going] + h[going], before[going] + h[going]
            ok = (x < n) & (y < n)
            ok[ok] = text[x[ok]] == text[y[ok]]
            going = going[ok]
            h[going] += 1
        shared[lane] = h
        out[place] = h
    return out


def _sides(contexts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Order of byte strings, and bytes that each shares with the one before it in that order (padding agrees with zeros)."""
    sizes = np.array([-(-len(c) // 8) for c in contexts], np.int64)
    padded = np.zeros(int(sizes.sum()) * 8, np.uint8)
    lengths = np.array([len(c) for c in contexts], np.int64)
    word_starts = np.cumsum(sizes) - sizes
    padded[ragged(lengths, word_starts * 8)] = np.concatenate(contexts) if len(contexts) else np.zeros(0, np.uint8)
    words = padded.view(">u8").astype(U64)
    _, code = np.unique(words, return_inverse=True)
    m = len(contexts)
    starts = word_starts + np.arange(m)  # one terminator after each string
    text = np.zeros(len(words) + m, np.int64)
    text[ragged(sizes, starts)] = code + m
    text[starts + sizes] = np.arange(m)
    order, rank = suffix_array(text)
    shared = common_prefixes(text, order, rank, starts, sizes + 1)
    heads = np.full(len(text), -1, np.int64)
    heads[starts] = np.arange(m)
    place = np.flatnonzero(heads[order] >= 0)
    strings = heads[order[place]]
    least = np.minimum.reduceat(shared[: place[-1] + 1], np.concatenate([[0], place[:-1] + 1])) if m else np.zeros(0, np.int64)
    a, b = strings[:-1], strings[1:]
    full = least[1:]
    word = lambda s: np.where(full < sizes[s], words[np.minimum(word_starts[s] + full, max(0, len(words) - 1))] if len(words) else U64(0), U64(0))
    differ = word(a) ^ word(b)
    extra = np.zeros(len(differ), np.int64)
    for k in range(1, 9):
        extra += differ >> U64(64 - 8 * k) == 0
    return strings, np.concatenate([[0], full * 8 + extra]) if m else np.zeros(0, np.int64)


def resolve(contexts: list[np.ndarray], far: np.ndarray, near: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(context, distance, has a partner, group) of every string; contexts run from the first string's start to the last one's end.

    far and near: greatest and least distance from a string's start to the anchor. Equal strings share a group number.
    """
    right_order, right_shared = _sides([c[f:] for c, f in zip(contexts, far.tolist(), strict=True)])
    left_order, left_shared = _sides([c[:f][::-1] for c, f in zip(contexts, far.tolist(), strict=True)])
    m = len(contexts)
    out: list[tuple] = []
    right, left = np.zeros(m, np.int64), np.zeros(m, np.int64)
    total = 0
    for d in range(int(near.min(initial=0)), int(far.max(initial=-1)) + 1):
        who = np.flatnonzero((near <= d) & (d <= far))
        if not len(who):
            continue
        right[right_order] = np.cumsum(right_shared < LENGTH - d)
        left[left_order] = np.cumsum(left_shared < d) if d else 0
        key = right[who] << 32 | left[who]
        by = np.argsort(key, kind="stable")
        edge = np.concatenate([[True], key[by][1:] != key[by][:-1]])
        group = np.cumsum(edge) - 1
        count = np.bincount(group)
        out.append((who[by], np.full(len(who), d), count[group] > 1, total + group))
        total += len(count)
    return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.zeros(0, np.int64),) * 2 + (np.zeros(0, bool), np.zeros(0, np.int64))


def _runs(key: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Strings that start next to each other in one text as (text key, from, to)."""
    by = np.lexsort((start, key))
    key, start = key[by], start[by]
    new = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (start[1:] - start[:-1] > LENGTH)])) if len(key) else np.zeros(0, np.int64)
    return key[new], start[new], start[np.append(new[1:], len(key)) - 1] + LENGTH if len(key) else start


def _shard(rows: list[tuple]) -> tuple[pa.RecordBatch, ...]:
    """Covered runs of a shard, and of its split anchors the strings to look up elsewhere; rows: (text_key, packed, split, context)."""
    names = sorted({r[0] for r in rows})
    number = {k: i for i, k in enumerate(names)}
    names, key = np.array(names, object), np.array([number[r[0]] for r in rows], np.int64)
    packed = np.array([r[1] for r in rows], np.int64)
    split = np.array([r[2] for r in rows], bool)
    place, far, near = packed >> 16, packed >> 8 & 0xFF, packed & 0xFF
    contexts = [np.frombuffer(r[3], np.uint8) for r in rows]
    who, distance, met, group = resolve(contexts, far, near)
    start = place[who] - distance
    runs = _runs(key[who[met]], start[met])
    none = np.zeros(len(runs[0]), np.int64)
    found = _batch(names[runs[0]], *runs[1:], none, none, none)
    _, first = np.unique(group, return_index=True)
    alone = np.zeros(len(who), bool)
    alone[first] = True  # one of each group stands for it
    ask = np.flatnonzero(alone & split[who])
    if not len(ask):
        return (found,)
    one, two = _digests([contexts[i][f - d : f - d + LENGTH] for i, f, d in zip(who[ask].tolist(), far[who[ask]].tolist(), distance[ask].tolist(), strict=True)])
    return found, _batch(names[key[who[ask]]], start[ask], start[ask] + LENGTH, one, two, np.where(met[ask], 2, 1))


def _digests(strings: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    raw = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in strings]
    both = np.frombuffer(b"".join(raw), np.int64).reshape(-1, 2)
    return both[:, 0], both[:, 1]


_FOUND = "text_key binary, start long, stop long, one long, two long, state int"


def _batch(*columns: np.ndarray) -> pa.RecordBatch:
    kinds = (pa.binary(),) + (pa.int64(),) * 4 + (pa.int32(),)
    return pa.record_batch([pa.array(c, kind) for c, kind in zip(columns, kinds, strict=True)], names=["text_key", "start", "stop", "one", "two", "state"])


def _merge(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Strings of one range of digests from all shards: those that binary search finds a second time."""
    held = list(batches)
    table = pa.Table.from_batches(held) if held else None
    if table is None or not table.num_rows:
        return
    c = {n: table[n].to_numpy(zero_copy_only=False) for n in table.column_names}
    both = np.rec.fromarrays([c["one"], c["two"]])
    runs = np.sort(both, order=("f0", "f1"))
    times = np.searchsorted(runs, both, "right") - np.searchsorted(runs, both, "left")
    hit = (times > 1) & (c["state"] == 1)
    yield _batch(*(c[n][hit] for n in ("text_key", "start", "stop", "one", "two", "state")))


def frequent(parts: Iterable[np.ndarray]) -> tuple[np.ndarray, np.ndarray, int]:
    """Values, their counts and the number of all values, in fixed memory: a count is short by at most all / COUNTERS.

    Whenever there are more than COUNTERS values, the next greatest count is taken off all of them (Misra and Gries).
    """
    values, counts, total, held, size = np.zeros(0, np.int64), np.zeros(0, np.int64), 0, [], 0

    def fold() -> None:
        nonlocal values, counts, held, size
        new, place = np.unique(np.concatenate([values, *held]), return_inverse=True)
        counts = np.bincount(place, np.concatenate([counts, np.ones(size, np.int64)]), len(new)).astype(np.int64)
        values, held, size = new, [], 0
        if len(values) > COUNTERS:
            counts = counts - np.partition(counts, -COUNTERS - 1)[-COUNTERS - 1]
            values, counts = values[counts > 0], counts[counts > 0]

    for part in parts:
        held.append(part)
        size += len(part)
        total += len(part)
        if size > 1 << 18:
            fold()
    fold()
    return values, counts, total


def covered(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(docs with text_key, table of text_key, copies and spans): spans are covered runs of bytes, sorted, not yet joined.

    Texts that occur more than once are one text here; their copies say so.
    """
    spark = docs.sparkSession
    small_batches(spark)
    text = F.coalesce(F.col("text"), F.lit(""))
    docs = docs.withColumn("text", text).withColumn("text_key", text_key(text))

    def found_in(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple]:
        seen: set[bytes] = set()  # a task's copies of a text have the same anchors: one of them tells
        for batch in batches:
            keys = batch["text_key"].to_pylist()
            batch = batch.filter(pa.array([not (k in seen or seen.add(k)) for k in keys], pa.bool_()))
            yield batch["text_key"], *anchors(*text_buffers(batch["text"]))

    def find(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, row, h, at, distances in found_in(batches):
            yield pa.record_batch([pa.array(h.view(np.int64)), keys.cast(pa.binary()).take(pa.array(row)), pa.array(at << 16 | distances)], names=["anchor", "text_key", "packed"])

    def tally(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        values, counts, total = frequent(found[2].view(np.int64) for found in found_in(batches))
        yield pa.record_batch([pa.array([*values.tolist(), None], pa.int64()), pa.array([*counts.tolist(), total], pa.int64())], names=["anchor", "n"])

    plain = docs.select("text_key", "text")
    tallied = materialize(plain.mapInArrow(tally, "anchor long, n long").groupBy("anchor").agg(F.sum("n").alias("n")), "frequent")
    total = max(1, tallied.where("anchor is null").agg(F.sum("n")).head()[0] or 0)
    often = tallied.where("anchor is not null").where(F.col("n") * FREQUENT >= total).collect()  # at most FREQUENT rows
    often = spark.createDataFrame([(r["anchor"], r["n"]) for r in often], "anchor long, often long")

    met = plain.mapInArrow(find, "anchor long, text_key binary, packed long").join(F.broadcast(often), "anchor", "left")
    met = met.withColumn("share", F.when(F.col("often").isNotNull(), F.pmod(F.xxhash64("text_key", "packed"), F.ceil(F.col("often") * FREQUENT / total))).otherwise(0))
    same = Window.partitionBy("anchor", "share")
    for c, k in (("text_key", "t"), ("packed", "p")):
        met = met.withColumn(f"lo_{k}", F.min(c).over(same)).withColumn(f"hi_{k}", F.max(c).over(same))
    met = met.withColumn("n", F.coalesce("often", F.count("*").over(same))).where("often is not null or lo_t < hi_t or lo_p < hi_p").select("anchor", "text_key", "packed", "n").distinct()
    met = materialize(met, "anchors")
    shards = max(1, -(-met.count() // SHARD))
    texts = docs.groupBy("text_key").agg(F.count("*").alias("copies"), F.min("doc_id").alias("chosen"))
    salt = F.when(F.col("n") > HOT, F.pmod(F.xxhash64("text_key", "packed"), F.ceil(F.col("n") / HOT))).otherwise(0)
    met = met.select("text_key", F.struct("packed", (F.col("n") > HOT).alias("split"), F.pmod(F.xxhash64("anchor", salt), F.lit(shards)).cast("int").alias("shard")).alias("occurrence"))
    wanted = met.groupBy("text_key").agg(F.collect_list("occurrence").alias("occurrences")).join(texts.select("text_key", "chosen"), "text_key")

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["shard", "text_key", "packed", "split", "context"]
        kinds = (pa.int32(), pa.binary(), pa.int64(), pa.bool_(), pa.binary())
        for batch in batches:
            for key, text, occurrences in zip(batch["text_key"].to_pylist(), batch["text"].to_pylist(), batch["occurrences"].to_pylist(), strict=True):
                raw, rows = text.encode(), []
                for o in occurrences:
                    at, far, near = o["packed"] >> 16, o["packed"] >> 8 & 0xFF, o["packed"] & 0xFF
                    rows.append((o["shard"], key, o["packed"], o["split"], raw[at - far : at - near + LENGTH]))
                yield pa.record_batch([pa.array(x, kind) for x, kind in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    def solve(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, rows = None, []
        for batch in batches:
            for s, *row in zip(*(batch[c].to_pylist() for c in ("shard", "text_key", "packed", "split", "context")), strict=True):
                if rows and s != shard:
                    yield from _shard(rows)
                    rows = []
                shard = s
                rows.append(row)
        if rows:
            yield from _shard(rows)

    contexts = docs.join(wanted, "text_key").where(F.col("doc_id").eqNullSafe(F.col("chosen"))).select("text_key", "text", "occurrences")
    contexts = contexts.mapInArrow(cut, "shard int, text_key binary, packed long, split boolean, context binary")
    found = materialize(contexts.repartition(min(shards, 4 * fan_out(spark)), "shard").sortWithinPartitions("shard").mapInArrow(solve, _FOUND), "covered")
    asked = found.where("state > 0").repartition(fan_out(spark), "one").mapInArrow(_merge, _FOUND)
    spans = found.where("state = 0").unionByName(asked).groupBy("text_key").agg(F.array_sort(F.collect_set(F.struct("start", "stop"))).alias("spans"))
    return docs, texts.select("text_key", "copies").join(spans, "text_key", "left")


def removed_runs(n: int, copies: int, spans: list[dict] | None) -> list[tuple[int, int]]:
    """Maximal runs of bytes to remove from a text of n bytes."""
    if copies > 1 and n >= LENGTH:
        return [(0, n)]
    out: list[tuple[int, int]] = []
    for s in spans or []:
        if out and s["start"] <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], s["stop"]))
        else:
            out.append((s["start"], s["stop"]))
    return out


def _kept(raw: bytes, runs: list[tuple[int, int]]) -> bytes:
    at, parts = 0, []
    for a, b in runs:
        parts.append(raw[at:a])
        at = b
    return b"".join([*parts, raw[at:]])


def report(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every row; a null text is empty, repeated rows are copies."""
    docs, found = covered(docs.select("doc_id", "text"))

    def told(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string())
        for batch in batches:
            rows = []
            for doc_id, text, copies, spans in zip(*(batch[c].to_pylist() for c in ("doc_id", "text", "copies", "spans")), strict=True):
                raw = text.encode()
                runs = removed_runs(len(raw), copies, spans)
                rows.append((doc_id, len(raw), sum(b - a for a, b in runs), len(runs), hashlib.sha256(_kept(raw, runs)).hexdigest()))
            yield pa.record_batch([pa.array(x, kind) for x, kind in zip(zip(*rows, strict=True) if rows else [[]] * 5, kinds, strict=True)], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    return docs.join(found, "text_key").select("doc_id", "text", "copies", "spans").mapInArrow(told, schema)


def remove_repeats(docs: DataFrame) -> DataFrame:
    """The columns of documents with the repeated bytes of report() cut out of text and n_chars set anew; all rows stay.

    A character that a cut goes through is left out whole. Rows without repeats, null texts included, come back as they were.
    """
    columns = ["doc_id", "text", "lang", "source", "n_chars"]
    schema = docs.select(*columns).schema
    keyed, found = covered(docs.select(*columns).withColumn("was_null", F.col("text").isNull()))

    def cleaned(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, sizes = [], []
            for text, null, n_chars, copies, spans in zip(*(batch[c].to_pylist() for c in ("text", "was_null", "n_chars", "copies", "spans")), strict=True):
                raw = text.encode()
                runs = removed_runs(len(raw), copies, spans)
                if runs:
                    text = _kept(raw, runs).decode(errors="ignore")
                    n_chars = len(text)
                texts.append(None if null else text)
                sizes.append(n_chars)
            yield pa.record_batch([batch["doc_id"], pa.array(texts, pa.string()), batch["lang"], batch["source"], pa.array(sizes, batch.schema.field("n_chars").type)], names=columns)

    return keyed.join(found, "text_key").mapInArrow(cleaned, schema)
