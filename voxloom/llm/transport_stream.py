"""MPEG transport streams as a media column: multiplexing, program tables, continuity, elementary packets, access points."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from voxloom.llm.common import materialize, small_batches, text_buffers

# Fixed values of ISO/IEC 13818-1.
PACKET = 188
SYNC = 0x47
PAT_PID = 0x0000
STREAM_PRIVATE = 0x06
PRIVATE_STREAM_1 = 0xBD
CLOCK_HZ = 90_000
CRC_POLYNOMIAL = 0x04C11DB7

#: Ours: program 1, its table and stream; 576 one-byte samples last 12 ms.
PROGRAM, PMT_PID, STREAM_PID = 1, 0x1000, 0x0100
FRAME, FRAME_TICKS, FRAMES_PER_UNIT, UNITS_PER_ACCESS_POINT = 576, 1080, 16, 4


def crc32_mpeg(data: bytes) -> int:
    crc = 0xFFFFFFFF
    for byte in data:
        crc ^= byte << 24
        for _ in range(8):
            crc = ((crc << 1) ^ (CRC_POLYNOMIAL if crc & 0x80000000 else 0)) & 0xFFFFFFFF
    return crc


def _section(table_id: int, extension: int, body: bytes) -> bytes:
    head = bytes([table_id]) + (0xB000 | len(body) + 9).to_bytes(2, "big") + extension.to_bytes(2, "big") + b"\xc1\x00\x00" + body
    return head + crc32_mpeg(head).to_bytes(4, "big")


def _table_packet(pid: int, section: bytes) -> bytes:
    return (bytes([SYNC]) + (0x4000 | pid).to_bytes(2, "big") + b"\x10\x00" + section).ljust(PACKET, b"\xff")


_TABLES = _table_packet(PAT_PID, _section(0, 1, PROGRAM.to_bytes(2, "big") + (0xE000 | PMT_PID).to_bytes(2, "big"))) + _table_packet(
    PMT_PID, _section(2, PROGRAM, (0xE000 | STREAM_PID).to_bytes(2, "big") + b"\xf0\x00" + bytes([STREAM_PRIVATE]) + (0xE000 | STREAM_PID).to_bytes(2, "big") + b"\xf0\x00")
)


def _clock(pts: int) -> bytes:
    """The five bytes of a presentation time stamp."""
    return bytes([0x21 | (pts >> 29) & 0x0E, (pts >> 22) & 0xFF, 0x01 | (pts >> 14) & 0xFE, (pts >> 7) & 0xFF, 0x01 | (pts << 1) & 0xFE])


def mux(payload: bytes) -> bytes:
    """Store bytes (a positive multiple of 576) as one program with one private stream."""
    parts, counter, step = [_TABLES], 0, FRAME * FRAMES_PER_UNIT
    for unit, at in enumerate(range(0, len(payload), step)):
        data = payload[at : at + step]
        pts = (CLOCK_HZ + at // FRAME * FRAME_TICKS) & (1 << 33) - 1
        pes = b"\x00\x00\x01" + bytes([PRIVATE_STREAM_1]) + (len(data) + 8).to_bytes(2, "big") + b"\x84\x80\x05" + _clock(pts) + data
        pcr = (pts - FRAME_TICKS) & (1 << 33) - 1
        first = bytes([7, 0x10 | 0x40 * (unit % UNITS_PER_ACCESS_POINT == 0)]) + (pcr << 15 | 0x7E00).to_bytes(6, "big")
        room = PACKET - 4
        count = 1 + max(0, -(-(len(pes) - room + 8) // room))
        packets = np.full((count, PACKET), 0xFF, np.uint8)
        packets[:, 0] = SYNC
        packets[:, 1] = STREAM_PID >> 8
        packets[0, 1] |= 0x40
        packets[:, 2] = STREAM_PID & 0xFF
        packets[:, 3] = 0x10 | (counter + np.arange(count)) & 15
        packets[0, 3] |= 0x20
        counter += count
        packets[0, 4:12] = np.frombuffer(first, np.uint8)
        raw = np.frombuffer(pes, np.uint8)
        packets[0, 12:] = raw[: room - 8]
        rest = raw[room - 8 :]
        whole = len(rest) // room
        packets[1 : 1 + whole, 4:] = rest[: whole * room].reshape(whole, room)
        if left := len(rest) - whole * room:
            packets[-1, 3] |= 0x20
            packets[-1, 4] = room - 1 - left
            if left < room - 1:
                packets[-1, 5] = 0
            packets[-1, PACKET - left :] = rest[whole * room :]
        parts.append(packets.tobytes())
    return b"".join(parts)


@dataclass
class Stream:
    """What a transport stream holds; units: (pts, offset of the unit's first packet, random access, bytes)."""

    programs: dict[int, dict[int, int]] = field(default_factory=dict)
    units: list[tuple[int | None, int, bool, bytes]] = field(default_factory=list)
    continuity_errors: int = 0
    table_errors: int = 0

    @property
    def payload(self) -> bytes:
        return b"".join(x[3] for x in self.units)


def _table(packet: np.ndarray, start: int) -> bytes | None:
    """A section that fits one packet, without its checksum; None if the checksum is wrong."""
    raw = packet[start:].tobytes()
    raw = raw[1 + raw[0] :]
    size = 3 + (int.from_bytes(raw[1:3], "big") & 0xFFF)
    return raw[: size - 4] if size <= len(raw) and crc32_mpeg(raw[:size]) == 0 else None


def demux(media: bytes) -> Stream:
    """Parse the tables, check every counter of the streams they name and put the packets together again.

    A lost sync byte or a cut packet raises ValueError; a wrong counter is counted and the bytes are kept.
    """
    if len(media) % PACKET:
        raise ValueError("not a whole number of transport packets")
    packets = np.frombuffer(media, np.uint8).reshape(-1, PACKET)
    if len(packets) and not (packets[:, 0] == SYNC).all():
        raise ValueError("lost sync byte")
    pid = (packets[:, 1].astype(np.int32) & 0x1F) << 8 | packets[:, 2]
    adapted, filled = (packets[:, 3] & 0x20) > 0, (packets[:, 3] & 0x10) > 0
    start = np.where(adapted, 5 + packets[:, 4].astype(np.int64), 4)
    out, table_pids = Stream(), {}
    for i in np.flatnonzero(pid == PAT_PID):
        body = _table(packets[i], int(start[i]))
        out.table_errors += body is None
        for at in range(8, len(body or b"") - 3, 4):
            table_pids[int.from_bytes(body[at + 2 : at + 4], "big") & 0x1FFF] = int.from_bytes(body[at : at + 2], "big")
    for table_pid, program in table_pids.items():
        for i in np.flatnonzero(pid == table_pid):
            body = _table(packets[i], int(start[i]))
            out.table_errors += body is None
            at = 12 + (int.from_bytes(body[10:12], "big") & 0xFFF) if body else 0
            while body and at + 5 <= len(body):
                out.programs.setdefault(program, {})[int.from_bytes(body[at + 1 : at + 3], "big") & 0x1FFF] = body[at]
                at += 5 + (int.from_bytes(body[at + 3 : at + 5], "big") & 0xFFF)
    for stream_pid in sorted({x for streams in out.programs.values() for x in streams}):
        own = np.flatnonzero((pid == stream_pid) & filled)
        counters = packets[own, 3].astype(np.int64) & 15
        out.continuity_errors += int((np.diff(counters) % 16 != 1).sum())
        size = PACKET - start[own]
        data = packets[own][np.arange(PACKET) >= start[own][:, None]]
        ends = np.cumsum(size)
        opens = np.flatnonzero(packets[own, 1] & 0x40)
        for k, i in enumerate(opens):
            a, b = int(ends[i] - size[i]), int(ends[opens[k + 1] - 1]) if k + 1 < len(opens) else len(data)
            pes = data[a:b].tobytes()
            if pes[:3] != b"\x00\x00\x01" or len(pes) < 9:
                raise ValueError("no elementary packet where one has to start")
            length, body = int.from_bytes(pes[4:6], "big"), 9 + pes[8]
            t = pes[9:14]
            pts = (t[0] >> 1 & 7) << 30 | t[1] << 22 | (t[2] >> 1) << 15 | t[3] << 7 | t[4] >> 1 if pes[7] & 0x80 else None
            access = bool(adapted[own[i]] and packets[own[i], 4] and packets[own[i], 5] & 0x40)
            out.units.append((pts, int(own[i]) * PACKET, access, pes[body : 6 + length] if length else pes[body:]))
    return out


def store_texts(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, media (the stream), pts and access_offsets (arrays) of every text.

    The text is padded with bytes 255 up to a positive multiple of 576; a null or empty text is all padding.
    Repeated rows stay repeated and other columns of docs are not read.
    """
    small_batches(docs.sparkSession)
    schema = "doc_id long, n_bytes long, media binary, pts array<long>, access_offsets array<long>"
    return docs.select("doc_id", "text").mapInArrow(_store, schema)


def _store(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["doc_id", "n_bytes", "media", "pts", "access_offsets"]
    for batch in batches:
        data, at = text_buffers(batch["text"])
        raw = data.tobytes()
        lengths, media, pts, access = [], [], [], []
        for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
            n = b - a
            stored = mux(raw[a:b].ljust(max(1, -(-n // FRAME)) * FRAME, b"\xff"))
            units = max(1, -(-n // (FRAME * FRAMES_PER_UNIT)))
            per_unit = _packets_of(FRAME * FRAMES_PER_UNIT)
            lengths.append(n)
            media.append(stored)
            pts.append([(CLOCK_HZ + u * FRAMES_PER_UNIT * FRAME_TICKS) & (1 << 33) - 1 for u in range(units)])
            access.append([(2 + u * per_unit) * PACKET for u in range(0, units, UNITS_PER_ACCESS_POINT)])
        yield pa.record_batch([batch["doc_id"].cast(pa.int64()), pa.array(lengths, pa.int64()), pa.array(media, pa.binary()), pa.array(pts, pa.list_(pa.int64())), pa.array(access, pa.list_(pa.int64()))], names=names)


def _packets_of(size: int) -> int:
    return 1 + max(0, -(-(size + 14 - (PACKET - 12)) // (PACKET - 4)))


def read_media(stored: DataFrame) -> DataFrame:
    """Read the stored streams back: digests of the recovered bytes and features of the stream.

    The time stamps and access points found must be those in the stored columns, or the row fails.
    """
    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return stored.mapInArrow(_read, schema)


def _read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    for batch in batches:
        rows: list[list] = [[] for _ in range(6)]
        for media, pts, access in zip(batch["media"], batch["pts"], batch["access_offsets"], strict=True):
            media = media.as_py()
            stream = demux(media)
            if [x[0] for x in stream.units] != pts.as_py() or [x[1] for x in stream.units if x[2]] != access.as_py():
                raise ValueError("stored index and stream differ")
            payload = stream.payload
            samples = np.frombuffer(payload, np.uint8)
            feature = ",".join([
                "program=" + "/".join(f"{p}:{s}:{kind}" for p, streams in sorted(stream.programs.items()) for s, kind in sorted(streams.items())),
                f"packets={len(media) // PACKET}", f"units={len(stream.units)}", f"access={sum(x[2] for x in stream.units)}",
                f"pts={stream.units[0][0]}-{stream.units[-1][0]}", f"continuity_errors={stream.continuity_errors}", f"table_errors={stream.table_errors}",
                f"sample_sum={int(samples.sum(dtype=np.int64))}", f"sample_max={int(samples.max())}",
            ])
            for column, value in zip(rows, (len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(media), hashlib.sha256(media).hexdigest(), feature), strict=True):
                column.append(value)
        kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
        yield pa.record_batch([batch["doc_id"], batch["n_bytes"], *(pa.array(x, kind) for x, kind in zip(rows, kinds, strict=True))], names=names)


def media_report(docs: DataFrame) -> DataFrame:
    """read_media() of store_texts(), written as a table and read back; a row for each row of docs, none for an empty table."""
    return read_media(materialize(store_texts(docs), "media"))
