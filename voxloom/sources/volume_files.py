"""NIfTI-1 files as a Spark data source: `spark.read.format("volumes")` and `df.write.format("volumes")`.

Register it once a session: register(spark). Reading gives the columns of nifti.SCHEMA, a row a file; with header_only the
voxels are neither read nor a column. Files are dealt into partitions by size. Writing takes path (its last part names the
file), shape, affine and voxels; files of a task wait in a staging folder until all tasks are done, so that a task or job
that fails leaves none behind. Paths are those of any file system that pyarrow reaches from driver and executors.

Options: path; pattern (*.nii*), canonical (false), header_only (false), partition_bytes (64 MB) to read; dtype (f4) and
compress (where the name ends with .gz) to write.
"""

from __future__ import annotations

import fnmatch
import struct
import uuid
import zlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from voxloom.sources import nifti

_KINDS = {"path": pa.string(), "shape": pa.list_(pa.int32()), "zooms": pa.list_(pa.float64()), "affine": pa.list_(pa.float64()), "dtype": pa.string(), "voxels": pa.list_(pa.float64())}
HEADER_SCHEMA = nifti.SCHEMA.rsplit(",", 1)[0]


def _at(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def _true(options: dict, name: str, default: str = "false") -> bool:
    return str(options.get(name, default)).lower() == "true"


@dataclass
class Files(InputPartition):
    """Files read by one task."""

    paths: list[str]


def deal(files: Sequence[tuple[str, int]], most: int) -> list[list[str]]:
    """Paths in runs of at most `most` bytes together; a larger file comes alone."""
    out: list[list[str]] = []
    room = 0
    for path, size in files:
        if not out or size > room:
            out.append([])
            room = most
        out[-1].append(path)
        room -= size
    return out


class VolumeReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.options = options

    def partitions(self) -> list[Files]:
        system, at = _at(self.options["path"])
        pattern = self.options.get("pattern", "*.nii*")
        found = system.get_file_info(fs.FileSelector(at, recursive=True)) if system.get_file_info(at).type == fs.FileType.Directory else [system.get_file_info(at)]
        files = sorted((f.path, f.size or 0) for f in found if f.type == fs.FileType.File and fnmatch.fnmatch(f.base_name, pattern) and not any(p.startswith("_staging-") for p in f.path.split("/")))
        if not files and found and found[0].type == fs.FileType.NotFound:
            raise ValueError(f"no such file or folder: {self.options['path']}")
        return [Files(paths) for paths in deal(files, int(self.options.get("partition_bytes", 64 << 20)))] or [Files([])]

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        system, _ = _at(self.options["path"])
        header_only = _true(self.options, "header_only")
        names = [n for n in _KINDS if not (header_only and n == "voxels")]
        for path in partition.paths:
            row = dict.fromkeys(_KINDS) | {"path": path}
            try:
                with system.open_input_stream(path, compression=None) as f:
                    row |= _header(f) if header_only else _volume(f.read(), _true(self.options, "canonical"))
            except (ValueError, struct.error, OSError, EOFError, zlib.error):
                pass
            yield pa.record_batch([pa.array([row[n]], _KINDS[n]) for n in names], names=names)


def _volume(raw: bytes, canonical: bool) -> dict:
    voxels, zooms, affine, kind = nifti.decode(raw)
    if canonical:
        voxels, affine = nifti.canonical(voxels, affine)
        zooms = np.linalg.norm(affine[:3, :3], axis=0).tolist() + zooms[3:]
    return {"shape": list(voxels.shape), "zooms": zooms, "affine": affine.ravel().tolist(), "dtype": kind, "voxels": voxels.ravel()}


def _header(f: pa.NativeFile) -> dict:
    raw = f.read(nifti.HEADER)
    if raw[:2] == b"\x1f\x8b":
        unpack, out = zlib.decompressobj(31), b""
        while raw and len(out) < nifti.HEADER:
            out += unpack.decompress(raw, nifti.HEADER - len(out))
            raw = unpack.unconsumed_tail or f.read(4096)
        raw = out
    shape, zooms, affine, kind = nifti.decode_header(raw)[:4]
    return {"shape": list(shape), "zooms": zooms, "affine": affine.ravel().tolist(), "dtype": kind.name}


@dataclass
class Written(WriterCommitMessage):
    """Staged file and file name of each volume of a task."""

    files: list[tuple[str, str]]


class VolumeWriter(DataSourceArrowWriter):
    def __init__(self, options: dict, overwrite: bool) -> None:
        self.options, self.overwrite, self.job = options, overwrite, uuid.uuid4().hex
        system, _, staging = self._staging()
        system.create_dir(staging, recursive=True)  # tasks that outlive an abort must not make it anew

    def _staging(self) -> tuple[fs.FileSystem, str, str]:
        system, at = _at(self.options["path"])
        return system, at.rstrip("/"), f"{at.rstrip('/')}/_staging-{self.job}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        system, _, staging = self._staging()
        task, files = TaskContext.get(), []
        folder = f"{staging}/{task.partitionId()}-{task.taskAttemptId()}"
        system.create_dir(folder, recursive=False)
        for batch in iterator:
            for k in range(len(batch)):
                path, shape, affine, voxels = (batch[n][k] for n in ("path", "shape", "affine", "voxels"))
                if not (path.is_valid and shape.is_valid and affine.is_valid and voxels.is_valid):
                    raise ValueError(f"no volume to write: {path.as_py()}")
                cube = voxels.values.to_numpy(zero_copy_only=False).reshape(shape.as_py()).astype(self.options.get("dtype", "f4"))
                name, staged = path.as_py().rsplit("/", 1)[-1], f"{folder}/{len(files)}"
                raw = nifti.encode(cube, np.array(affine.as_py()).reshape(4, 4), _true(self.options, "compress", str(name.endswith(".gz"))))
                with system.open_output_stream(staged, compression=None) as f:
                    f.write(raw)
                files.append((staged, name))
        return Written(files)

    def commit(self, messages: list[Written | None]) -> None:
        system, at, staging = self._staging()
        files = [f for m in messages if m for f in m.files]
        names = [n for _, n in files]
        twice = sorted({n for n in names if names.count(n) > 1}) if len(set(names)) < len(names) else []
        there = [] if self.overwrite else [i.base_name for i in system.get_file_info([f"{at}/{n}" for n in names]) if i.type != fs.FileType.NotFound]
        if twice or there:
            system.delete_dir(staging)
            raise ValueError(f"volumes of one name: {(twice or there)[:5]}")
        for staged, name in files:
            system.move(staged, f"{at}/{name}")
        system.delete_dir(staging)

    def abort(self, messages: list[Written | None]) -> None:
        system, _, staging = self._staging()
        for _ in range(5):  # a task that still runs may add a file meanwhile
            try:
                system.delete_dir(staging)
            except FileNotFoundError:
                return
            except OSError:
                continue


class VolumeFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return "volumes"

    def schema(self) -> str:
        return HEADER_SCHEMA if _true(self.options, "header_only") else nifti.SCHEMA

    def reader(self, schema) -> VolumeReader:
        return VolumeReader(dict(self.options))

    def writer(self, schema, overwrite: bool) -> VolumeWriter:
        return VolumeWriter(dict(self.options), overwrite)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(VolumeFiles)
