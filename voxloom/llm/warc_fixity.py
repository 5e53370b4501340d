"""WARC archives and a fixity audit of their replicas by Merkle trees.

Pages are written as WARC/1.1 response records, joined into archives of about a megabyte. The tree of an archive has
leaves that hash the bytes of a record at its offsets and inner nodes, all stored, that hash the offsets and digests of up
to FAN children in order; its root, at level ROOT, joins whatever is left. Roots of archives are hashed on to one node for
each piece (the archives that one task wrote), for 4,096 pieces and for all. The audit compares the topmost nodes of both
replicas and then, level by level, the children of nodes that differ and no others.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxloom.llm.common import STEP, materialize, pieces_by_size, small_batches, text_list

FAN, ROOT = 16, 3
#: Bits of an archive's number that count within its piece, and that each level above the pieces drops.
SERIAL, STEP_BITS = 20, 12
#: The level of the one node above all pieces; piece numbers have 24 bits.
TOP = ROOT + 3
_STORED = "archive long, blob binary, page_ids array<long>, stops array<long>"
_HEAD = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"


def record(page_id: int | None, url: str, html: str) -> bytes:
    """A response record; its id derives from its content, its date is fixed, so equal pages give equal bytes."""
    body = _HEAD + html.encode()
    name = uuid.uuid5(uuid.NAMESPACE_URL, f"{page_id}\n{url}\n{hashlib.sha256(body).hexdigest()}")
    head = (
        "WARC/1.1\r\nWARC-Type: response\r\n"
        f"WARC-Record-ID: <urn:uuid:{name}>\r\nWARC-Target-URI: {' '.join(url.split())}\r\nWARC-Date: 1970-01-01T00:00:00Z\r\n"
        f"WARC-Block-Digest: sha256:{hashlib.sha256(body).hexdigest()}\r\n"
        f"Content-Type: application/http;msgtype=response\r\nContent-Length: {len(body)}\r\n\r\n"
    )
    return head.encode() + body + b"\r\n\r\n"


def parse(blob: bytes) -> Iterator[tuple[dict[str, str], bytes, int]]:
    """(header fields, block, offset after the record) of each record; ValueError where the bytes are no WARC record."""
    at = 0
    while at < len(blob):
        end = blob.find(b"\r\n\r\n", at)
        lines = blob[at : max(end, at)].decode(errors="replace").split("\r\n")
        fields = dict(x.split(": ", 1) for x in lines[1:] if ": " in x)
        if end < 0 or not lines[0].startswith("WARC/") or not fields.get("Content-Length", "").isdecimal():
            raise ValueError(f"no WARC record at {at}")
        stop = end + 4 + int(fields["Content-Length"])
        if blob[stop : stop + 4] != b"\r\n\r\n":
            raise ValueError(f"record at {at} ends early")
        yield fields, blob[end + 4 : stop], stop + 4
        at = stop + 4


def write_archives(pages: DataFrame, size: int = STEP) -> DataFrame:
    """archive, blob, page_ids and stops (offset after each record) of every archive, in the shared folder.

    Pages are dealt by ranges of page_id, then of a hash of url and html, then of their place in the input, as many as the
    size of the pages asks for, so neither a page_id nor a page with many rows stays in one task. Within a range they are
    sorted by (page_id, url, html); a larger record is an archive of its own. Null page_ids come first; a null url or html is empty;
    repeated rows are stored as often as they occur.
    """
    small_batches(pages.sparkSession, 64)
    pages = pages.select(F.coalesce(F.col("page_id"), F.lit(-(1 << 63))).alias("key"), F.col("page_id").cast("long"), F.coalesce("url", F.lit("")).alias("url"), F.coalesce("html", F.lit("")).alias("html"))
    placed = pages.withColumn("tie", F.xxhash64("url", "html")).withColumn("place", F.monotonically_increasing_id())
    ordered = placed.repartitionByRange(pieces_by_size(pages, "html"), "key", "tie", "place").sortWithinPartitions("key", "url", "html")

    def written(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        piece, serial, held, ids, stops = 0, 0, [], [], []

        def archive() -> pa.RecordBatch:
            return pa.record_batch([pa.array([piece << SERIAL | serial], pa.int64()), pa.array([b"".join(held)], pa.binary()), pa.array([ids], pa.list_(pa.int64())), pa.array([stops], pa.list_(pa.int64()))], names=["archive", "blob", "page_ids", "stops"])

        for batch in batches:
            for piece, page_id, url, html in zip(batch["piece"].to_pylist(), batch["page_id"].to_pylist(), text_list(batch["url"]), text_list(batch["html"]), strict=True):
                raw = record(page_id, url, html)
                if held and stops[-1] + len(raw) > size:
                    yield archive()
                    serial, held, ids, stops = serial + 1, [], [], []
                held.append(raw)
                ids.append(page_id)
                stops.append((stops[-1] if stops else 0) + len(raw))
        if held:
            yield archive()

    return materialize(ordered.select(F.spark_partition_id().alias("piece"), "page_id", "url", "html").mapInArrow(written, _STORED), "warc")


Node = tuple[int, int, bytes]


def _node(children: list[Node]) -> Node:
    digest = hashlib.sha256(b"\x01" + b"".join(a.to_bytes(8, "big") + b.to_bytes(8, "big") + h for a, b, h in children)).digest()
    return children[0][0], children[-1][1], digest


def tree(blob: bytes, stops: list[int]) -> list[list[Node]]:
    """Levels 0 to ROOT of (start, stop, digest), from the leaves to the root.

    Bytes after the last stop are one more leaf; stops beyond the end give leaves that hash what there is.
    """
    view, at, leaves = memoryview(blob), 0, []
    for stop in [*stops, len(blob)] if len(blob) > (stops[-1] if stops else -1) else stops:
        leaves.append((at, stop, hashlib.sha256(b"\x00" + bytes(view[at:stop])).digest()))
        at = stop
    levels = [leaves]
    while len(levels) < ROOT:
        levels.append([_node(levels[-1][i : i + FAN]) for i in range(0, len(levels[-1]), FAN)])
    return [*levels, [_node(levels[-1])]]


_NODES = "archive long, level int, node int, start long, stop long, digest binary, page_id long"


def nodes(stored: DataFrame) -> DataFrame:
    """All nodes of the trees of all archives: archive, level, node (its number in the level), start, stop, digest, page_id (of leaves)."""

    def hashed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.int64())
        for batch in batches:
            for archive, blob, ids, stops in zip(*(batch[c].to_pylist() for c in ("archive", "blob", "page_ids", "stops")), strict=True):
                rows = [(archive, level, i, a, b, h, ids[i] if level == 0 and i < len(ids) else None) for level, row in enumerate(tree(blob, stops)) for i, (a, b, h) in enumerate(row)]
                yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["archive", "level", "node", "start", "stop", "digest", "page_id"])

    return stored.select("archive", "blob", "page_ids", "stops").mapInArrow(hashed, _NODES)


def _above(roots: DataFrame) -> DataFrame:
    """The nodes above the archives: side, archive (here the number without the dropped bits), level, node 0, digest.

    A node lists the digests of one piece, whose archives one task wrote, or of 4,096 nodes below.
    """
    levels = [roots.select("side", "archive", "digest")]
    for level in range(ROOT + 1, TOP + 1):
        up = F.shiftright("archive", SERIAL if level == ROOT + 1 else STEP_BITS)
        listed = F.array_sort(F.collect_list(F.struct("archive", F.hex("digest").alias("h"))))
        joined = F.array_join(F.transform(listed, lambda x: F.concat_ws(":", x["archive"].cast("string"), x["h"])), ",")
        levels.append(levels[-1].groupBy("side", up.alias("archive")).agg(F.unhex(F.sha2(joined, 256)).alias("digest")))
    out = None
    for level, df in enumerate(levels[1:], ROOT + 1):
        df = df.select("side", "archive", F.lit(level).alias("level"), F.lit(0).alias("node"), "digest")
        out = df if out is None else out.unionByName(df)
    return out


def differing(both: DataFrame, above: DataFrame) -> DataFrame:
    """archive, node of every leaf that differs between the sides or that one side lacks.

    Each level keeps the children of the nodes that differ above it, and of those the ones without an equal on the other side.
    """
    found = None
    for level in range(TOP, -1, -1):
        rows = (above if level > ROOT else both).where(F.col("level") == level).select("side", "archive", "node", "digest")
        if found is not None:
            if level >= ROOT:
                up, at = F.shiftright("archive", SERIAL if level == ROOT else STEP_BITS), F.lit(0)
            else:
                up, at = F.col("archive"), F.lit(0) if level == ROOT - 1 else F.floor(F.col("node") / FAN).cast("int")
            rows = rows.withColumn("up", up).withColumn("at", at).join(found.select(F.col("archive").alias("up"), F.col("node").alias("at")), ["up", "at"], "left_semi")
        met = rows.groupBy("archive", "node").agg(F.count("*").alias("n"), F.min("digest").alias("lo"), F.max("digest").alias("hi"))
        found = met.where("n < 2 or lo <> hi").select("archive", "node")
    return found


def audit(stored: DataFrame, replica: DataFrame) -> DataFrame:
    """page_id, archive, record, start, stop, record_sha256, replica_sha256, damaged of every record of `stored`, and of
    what only the replica holds: bytes after an archive's last record, records and archives of its own.

    record: its number in the archive. replica_sha256: null if the replica lacks the record; record_sha256 is null, and
    page_id the replica's, where `stored` lacks it. Digests are those of the leaves, over a zero byte and the record. A record
    is damaged if its bytes or offsets differ. The replica has the columns of `stored`; without `stops` and `page_ids` its archives are read
    at the offsets of `stored`, and archives that `stored` lacks are one record each.
    """
    if "stops" not in replica.columns:
        held = replica.select("archive", "blob").join(stored.select("archive", "page_ids", "stops"), "archive", "left")
        none = F.array().cast("array<long>")
        replica = held.select("archive", "blob", F.coalesce("page_ids", none).alias("page_ids"), F.coalesce("stops", none).alias("stops"))
    sides = nodes(stored).withColumn("side", F.lit(0)).unionByName(nodes(replica).withColumn("side", F.lit(1)))
    both = materialize(sides, "fixity", "level")
    above = materialize(_above(both.where(F.col("level") == ROOT)), "fixity-tops")
    bad = materialize(differing(both, above), "unlike").withColumn("unlike", F.lit(True))
    leaves = both.where("level = 0")
    left = leaves.where("side = 0").join(bad, ["archive", "node"], "left")
    right = leaves.where("side = 1").join(bad.select("archive", "node"), ["archive", "node"], "left_semi")
    right = right.select("archive", "node", *[F.col(c).alias(f"r_{c}") for c in ("digest", "start", "stop", "page_id")])
    out = left.join(right, ["archive", "node"], "full")
    damaged = F.col("unlike").isNotNull() | F.col("digest").isNull()
    name = lambda c: F.lower(F.hex(c))
    return out.select(
        F.coalesce("page_id", "r_page_id").alias("page_id"), "archive", F.col("node").alias("record"), F.coalesce("start", "r_start").alias("start"), F.coalesce("stop", "r_stop").alias("stop"),
        name("digest").alias("record_sha256"), F.when(damaged, name("r_digest")).otherwise(name("digest")).alias("replica_sha256"), damaged.alias("damaged"),
    )


def spoil(stored: DataFrame, every: int = 97) -> DataFrame:
    """A replica with planted faults: one bit of the middle byte of each record whose page_id is a multiple of `every`."""

    def flipped(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, (blob, ids, stops) in enumerate(zip(*(batch[c].to_pylist() for c in ("blob", "page_ids", "stops")), strict=True)):
                raw = bytearray(blob)
                for page, a, b in zip(ids, [0, *stops], stops):
                    if page is not None and page % every == 0:
                        raw[(a + b) // 2] ^= 1
                row = batch.slice(i, 1)
                yield pa.RecordBatch.from_arrays([row["archive"], pa.array([bytes(raw)], pa.binary()), row["page_ids"], row["stops"]], names=["archive", "blob", "page_ids", "stops"])

    return stored.select("archive", "blob", "page_ids", "stops").mapInArrow(flipped, _STORED)


def report(pages: DataFrame) -> DataFrame:
    """audit() of the archives of all pages against a replica spoilt by spoil(), which is read but never written; no row for an empty table."""
    stored = write_archives(pages.select("page_id", "url", "html"))
    return audit(stored, spoil(stored))
