"""Segmentation by an ensemble: from volumes and masks to merged labels in one pass over the rows, and from files to files.

A model looks along its own plane at windows of neighbouring slices. For each row and model: axes in the order of the plane,
height and width padded to the model's least, a window around each slice that the mask touches, prediction in batches, windows
put back (of those that hold a slice the one of greatest place counts), the way back to the volume's axes, zeros outside the
mask. The classes of all models are then merged into one label a voxel. A model is loaded once a Python worker.
Rows with a null volume, mask or shape have null labels.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from voxloom.operators import catalog as C
from voxloom.operators.volumes import PLANES

Predict = Callable[[np.ndarray], np.ndarray]


@dataclass(frozen=True)
class Model:
    """load() gives a function from windows (n, height, width, inputs * channels; slices outward, channels innermost) to
    class probabilities (n, height, width, outputs, classes)."""

    name: str
    load: Callable[[], Predict]
    plane: str = "axial"
    inputs: int = 1
    outputs: int = 1
    classes: int = 2
    least: tuple[int, int] = (1, 1)


_loaded: dict[str, Predict] = {}


def _predict(model: Model, channels: list[np.ndarray], mask: np.ndarray, batch: int) -> np.ndarray:
    """Probabilities (x, y, z, class), 0 outside the mask."""
    if model.name not in _loaded:
        _loaded[model.name] = model.load()
    axes, edge = PLANES[model.plane], max(model.inputs, model.outputs) // 2
    turned = np.transpose(mask, axes) > 0
    more = [max(0, least - n) for least, n in zip(model.least, turned.shape[:2], strict=True)]
    by = [(d // 2, d - d // 2) for d in more] + [(edge, edge)]
    slabs = np.stack([np.pad(np.transpose(c, axes), by) for c in channels], axis=-1)
    out = np.zeros((*slabs.shape[:3], model.classes))
    places = np.flatnonzero(turned.any((0, 1))) + edge
    for k in range(0, len(places), batch):
        some = places[k : k + batch]
        windows = np.stack([slabs[:, :, z - model.inputs // 2 : z - model.inputs // 2 + model.inputs] for z in some])
        found = _loaded[model.name](windows.reshape(*windows.shape[:3], -1))
        for z, one in zip(some.tolist(), found, strict=True):
            lo = z - model.outputs // 2
            out[:, :, lo : lo + model.outputs] = one.reshape(*slabs.shape[:2], model.outputs, model.classes)
    cut = tuple(slice(a, n - b) for n, (a, b) in zip(out.shape, by, strict=False))
    return np.transpose(out[cut], [*np.argsort(axes), 3]) * (mask > 0.5)[..., None]


def merge(found: Sequence[np.ndarray], method: str, tiebreaker: int = 0) -> np.ndarray:
    """Labels of the probabilities of several models: majority_vote, average_prob or max_prob; on a tie the label of model `tiebreaker` (from 1), or 0 for none."""
    own = [f.argmax(-1) for f in found]
    if method == "majority_vote":
        joint = np.stack([sum((o == c).astype(int) for o in own) for c in range(max(f.shape[-1] for f in found))], -1)
        tied = (joint == joint.max(-1, keepdims=True)).sum(-1) > 1
    elif method in ("average_prob", "max_prob"):
        joint = np.sum(found, 0) if method == "average_prob" else np.max(found, 0)
        tied = np.isclose(joint, joint.max(-1, keepdims=True)).sum(-1) > 1
    else:
        raise ValueError(f"unknown merging method: {method}")
    return np.where(tied, own[tiebreaker - 1] if tiebreaker else 0, joint.argmax(-1))


def segment(
    volumes: DataFrame, channels: Sequence[str], mask: str, models: Sequence[Model], method: str = "majority_vote", tiebreaker: int = 0, mapping: dict[int, int] | None = None, batch: int = 16, each: bool = False
) -> DataFrame:
    """The table with `labels` (array of int), from columns of voxels, a mask and `shape`.

    mapping: labels that it lacks become 0. each: also labels_<name> of every model before merging.
    """
    if not models or len({m.name for m in models}) < len(models):
        raise ValueError("models must have names of their own")
    names = ["labels", *([f"labels_{m.name}" for m in models] if each else [])]
    schema = T.StructType([*volumes.schema.fields, *[T.StructField(n, T.ArrayType(T.IntegerType())) for n in names]])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            made: list[list] = [[] for _ in names]
            for k in range(len(rows)):
                cells = [rows[c][k] for c in (*channels, mask, "shape")]
                if not all(c.is_valid for c in cells):
                    for m in made:
                        m.append(None)
                    continue
                shape = cells[-1].as_py()
                cubes = [c.values.to_numpy(zero_copy_only=False).reshape(shape) for c in cells[:-1]]
                found = [_predict(m, cubes[:-1], cubes[-1], batch) for m in models]
                label = merge(found, method, tiebreaker).ravel().astype(np.int32)
                if mapping is not None:
                    table = np.zeros(max([label.max(initial=0), *mapping]) + 1, np.int32)
                    table[list(mapping)] = list(mapping.values())
                    label = table[label]
                for m, x in zip(made, [label, *([f.argmax(-1).ravel().astype(np.int32) for f in found] if each else [])], strict=True):
                    m.append(x)
            yield pa.RecordBatch.from_arrays([*rows.columns, *[pa.array(m, pa.list_(pa.int32())) for m in made]], names=[*rows.schema.names, *names])

    return volumes.mapInArrow(run, schema)


def segment_files(spark: SparkSession, plan: DataFrame, folder: str, target: str, models: Sequence[Model], channels: int, overwrite: bool = False, **options) -> DataFrame:
    """Read, segment and write: `plan` has subject, role (mask, or 0, 1, ... for a channel) and name (file name below `folder`).

    Writes <subject>_seg.nii.gz with the mask's grid below `target` and returns the subjects written. Subjects whose file is
    there are left out unless `overwrite`; one that lacks a file, or whose shapes differ, is an error. Register the data source first.
    """
    out = plan.select("subject").distinct().withColumn("output", F.concat("subject", F.lit("_seg.nii.gz")))
    there = spark.read.format("volumes").option("header_only", "true").load(target).select(F.substring_index("path", "/", -1).alias("output"))
    todo = C.without_outputs(out, there, "output", overwrite)
    files = spark.read.format("volumes").load(folder).withColumn("name", F.substring_index("path", "/", -1))
    parts = plan.join(todo.select("subject"), "subject").join(files, "name", "left")
    of = lambda role, c: F.first(F.when(F.col("role") == role, F.col(c)), True)
    roles = ["mask", *[str(k) for k in range(channels)]]
    shapes = F.array_distinct(F.array(*[of(r, "shape") for r in roles]))
    held = parts.groupBy("subject").agg(*[of(r, "voxels").alias(f"v_{r}") for r in roles], of("mask", "affine").alias("affine"), shapes.alias("shapes"))
    missing = F.array_contains(F.transform("shapes", lambda s: s.isNull()), True)
    wrong = F.when(missing, F.raise_error(F.concat(F.lit("a file is missing of "), "subject"))).when(F.size("shapes") > 1, F.raise_error(F.concat(F.lit("files of unlike shape of "), "subject")))
    ready = held.select("*", F.explode(F.array(F.coalesce(wrong.cast("array<int>"), F.get("shapes", F.lit(0))))).alias("shape")).drop("shapes")
    labels = segment(ready, [f"v_{k}" for k in range(channels)], "v_mask", models, **options)
    written = labels.select(F.concat("subject", F.lit("_seg.nii.gz")).alias("path"), "shape", "affine", F.col("labels").cast("array<double>").alias("voxels"))
    written.write.format("volumes").mode("overwrite" if overwrite else "append").option("dtype", "u1").save(target)
    return todo.select("subject")
