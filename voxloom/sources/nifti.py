"""NIfTI-1 files as one row a volume, x slowest and z fastest as in voxloom.operators.volumes, and back to bytes."""

from __future__ import annotations

import gzip
import struct
from collections.abc import Iterable, Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

# Fixed values of the public NIfTI-1 header: its size and voxel types by code.
HEADER = 348
TYPES = {2: "u1", 4: "i2", 8: "i4", 16: "f4", 64: "f8", 256: "i1", 512: "u2", 768: "u4", 1024: "i8", 1280: "u8"}
SCHEMA = "path string, shape array<int>, zooms array<double>, affine array<double>, dtype string, voxels array<double>"


def decode_header(raw: bytes) -> tuple[tuple[int, ...], list[float], np.ndarray, np.dtype, int, float, float]:
    """(shape, zooms, 4 x 4 affine, type, place of the voxels, slope, intercept) of the first 348 bytes; ValueError if it is no NIfTI-1 file."""
    order = next((o for o in "<>" if len(raw) >= HEADER and struct.unpack_from(o + "i", raw)[0] == HEADER), None)
    if order is None or raw[344:347] not in (b"n+1", b"ni1"):
        raise ValueError("not a NIfTI-1 file")
    dim = struct.unpack_from(order + "8h", raw, 40)
    code = struct.unpack_from(order + "h", raw, 70)[0]
    if code not in TYPES:
        raise ValueError(f"unsupported voxel type {code}")
    pixdim = struct.unpack_from(order + "8f", raw, 76)
    offset, slope, inter = struct.unpack_from(order + "3f", raw, 108)
    qform, sform = struct.unpack_from(order + "2h", raw, 252)
    affine = np.eye(4)
    if sform > 0:
        affine[:3] = np.array(struct.unpack_from(order + "12f", raw, 280)).reshape(3, 4)
    elif qform > 0:
        b, c, d, *origin = struct.unpack_from(order + "6f", raw, 256)
        a = max(0.0, 1 - b * b - c * c - d * d) ** 0.5
        turn = np.array([
            [a * a + b * b - c * c - d * d, 2 * (b * c - a * d), 2 * (b * d + a * c)], [2 * (b * c + a * d), a * a + c * c - b * b - d * d, 2 * (c * d - a * b)],
            [2 * (b * d - a * c), 2 * (c * d + a * b), a * a + d * d - b * b - c * c],
        ])
        affine[:3, :3] = turn * [pixdim[1], pixdim[2], pixdim[3] * (-1 if pixdim[0] < 0 else 1)]
        affine[:3, 3] = origin
    else:
        affine[[0, 1, 2], [0, 1, 2]] = pixdim[1:4]
    return dim[1 : 1 + dim[0]], [float(x) for x in pixdim[1 : 1 + dim[0]]], affine, np.dtype(order + TYPES[code]), int(offset), slope, inter


def decode(raw: bytes) -> tuple[np.ndarray, list[float], np.ndarray, str]:
    """(voxels, zooms, 4 x 4 affine, type) of a file, plain or gzipped; ValueError if it is no NIfTI-1 file."""
    if raw[:2] == b"\x1f\x8b":
        raw = gzip.decompress(raw)
    shape, zooms, affine, kind, offset, slope, inter = decode_header(raw)
    voxels = np.frombuffer(raw, kind, int(np.prod(shape)), offset).reshape(shape, order="F").astype(np.float64)
    if slope and (slope, inter) != (1.0, 0.0):
        voxels = voxels * slope + inter
    return voxels, zooms, affine, kind.name


def encode(voxels: np.ndarray, affine: np.ndarray, compress: bool = False) -> bytes:
    """A single-file NIfTI-1 volume of the array's own type, with its affine as sform."""
    code = next((k for k, t in TYPES.items() if np.dtype(t) == voxels.dtype.newbyteorder("=")), None)
    if code is None:
        raise ValueError(f"unsupported voxel type {voxels.dtype}")
    head = bytearray(HEADER + 4)
    zooms = np.linalg.norm(affine[:3, :3], axis=0)
    struct.pack_into("<i", head, 0, HEADER)
    struct.pack_into("<8h", head, 40, voxels.ndim, *voxels.shape, *[1] * (7 - voxels.ndim))
    struct.pack_into("<2h", head, 70, code, voxels.dtype.itemsize * 8)
    struct.pack_into("<8f", head, 76, 1.0, *zooms, *[1.0] * 4)
    struct.pack_into("<3f", head, 108, HEADER + 4, 1.0, 0.0)
    struct.pack_into("<2h", head, 252, 0, 1)
    struct.pack_into("<12f", head, 280, *affine[:3].ravel())
    head[344:348] = b"n+1\0"
    raw = bytes(head) + voxels.astype(voxels.dtype.newbyteorder("<")).tobytes(order="F")
    return gzip.compress(raw, mtime=0) if compress else raw


def canonical(voxels: np.ndarray, affine: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Axes in the order and direction closest to right, anterior, superior, and the affine that keeps every voxel's place.

    Of the six orders the one with the greatest product of unit-axis parts is taken; flat files get a third axis of one voxel.
    """
    voxels = voxels.reshape(*voxels.shape, *[1] * (3 - voxels.ndim))
    size = np.linalg.norm(affine[:3, :3], axis=0)
    part = np.abs(affine[:3, :3]) / np.where(size > 0, size, 1)
    axes = max(permutations(range(3)), key=lambda order: sum(np.log(max(part[w, a], 1e-12)) for w, a in enumerate(order)))
    out, moved = np.transpose(voxels, [*axes, *range(3, voxels.ndim)]), affine[:, [*axes, 3]].copy()
    for k in range(3):
        if moved[k, k] < 0:
            out = np.flip(out, k)
            moved[:3, 3] += moved[:3, k] * (out.shape[k] - 1)
            moved[:3, k] *= -1
    return out, moved


def read_volumes(spark: SparkSession, path: str, pattern: str = "*.nii*", to_canonical: bool = False) -> DataFrame:
    """A row for each file below `path`; the columns but the path are null where a file is no NIfTI-1 volume."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(path)
    kinds = (pa.string(), pa.list_(pa.int32()), pa.list_(pa.float64()), pa.list_(pa.float64()), pa.string(), pa.list_(pa.float64()))

    def decoded(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, raw in zip(batch["path"].to_pylist(), batch["content"], strict=True):
                row: tuple = (name, None, None, None, None, None)
                try:
                    voxels, zooms, affine, kind = decode(raw.as_py())
                    if to_canonical:
                        voxels, affine = canonical(voxels, affine)
                        zooms = np.linalg.norm(affine[:3, :3], axis=0).tolist() + zooms[3:]
                    row = (name, list(voxels.shape), zooms, affine.ravel().tolist(), kind, voxels.ravel())
                except (ValueError, struct.error, OSError, EOFError):
                    pass
                yield pa.record_batch([pa.array([v], k) for v, k in zip(row, kinds, strict=True)], names=["path", "shape", "zooms", "affine", "dtype", "voxels"])

    return files.select("path", "content").mapInArrow(decoded, SCHEMA)


def with_bytes(volumes: DataFrame, kind: str = "f4", compress: bool = True) -> DataFrame:
    """path and content (the bytes of a NIfTI-1 file) of every volume; null where the voxels are null."""

    def encoded(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(batch["shape"].to_pylist(), batch["affine"].to_pylist(), batch["voxels"], strict=True)
            out = [encode(v.values.to_numpy(zero_copy_only=False).reshape(s).astype(kind), np.array(a).reshape(4, 4), compress) if v.is_valid else None for s, a, v in rows]
            yield pa.record_batch([batch["path"], pa.array(out, pa.binary())], names=["path", "content"])

    return volumes.select("path", "shape", "affine", "voxels").mapInArrow(encoded, "path string, content binary")
