"""Volumes resampled from grid to grid: donor grids, inverse transforms, resizing with a record, and chains of recorded steps.

A grid is a shape (array of 3 ints) and an affine (16 numbers, row by row) from voxels to space; both may differ from row to
row. Maps, shapes and paddings are Column expressions; the voxels of a batch go through numpy once, rows of like maps together,
and nothing is shuffled. Null volumes and null grids give null.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from voxloom.operators.kernels import STEP, numbers, resampled, shape_of, step
from voxloom.operators.volumes import Shape, bind

GRID = "struct<shape:array<int>,affine:array<double>>"


def grid(shape: Sequence[int] | Column, affine: Sequence[float] | Column) -> Column:
    return F.struct(shape_of(shape).alias("shape"), (affine if isinstance(affine, Column) else numbers(affine)).alias("affine"))


def through(volumes: DataFrame, column: str, steps: Sequence[Column] | Column) -> DataFrame:
    """The table with `column` (voxels) after a list of step()s, or after an array of them.

    The steps are computed as a column of their own before the voxels and they go to Python.
    """
    made = (steps if isinstance(steps, Column) else F.array(*steps)).cast(f"array<{STEP}>")
    held = volumes.select("*", F.explode(F.array(made)).alias("_steps"))
    return held.withColumn(column, resampled(F.col(column), F.col("_steps"))).drop("_steps")


def compose(a: Column, b: Column) -> Column:
    """The affine that applies b and then a."""
    cell = lambda p, i, j: sum((F.get(p["a"], F.lit(4 * i + k)) * F.get(p["b"], F.lit(4 * k + j)) for k in range(4)), F.lit(0.0))
    return bind(F.struct(a.alias("a"), b.alias("b")), lambda p: F.when(p["a"].isNotNull() & p["b"].isNotNull(), F.array(*[cell(p, i, j) for i in range(4) for j in range(4)])))


def inverse(a: Column) -> Column:
    """The inverse of an affine; an error where it has none."""

    def inverted(m: Column) -> Column:
        at = lambda i, j: F.get(m, F.lit(4 * i + j))
        minor = lambda i, j: at((i + 1) % 3, (j + 1) % 3) * at((i + 2) % 3, (j + 2) % 3) - at((i + 1) % 3, (j + 2) % 3) * at((i + 2) % 3, (j + 1) % 3)
        size = at(0, 0) * minor(0, 0) + at(0, 1) * minor(0, 1) + at(0, 2) * minor(0, 2)

        def rows(d: Column) -> Column:
            turn = [[minor(j, i) / d for j in range(3)] for i in range(3)]
            cells = [x for i in range(3) for x in (*turn[i], -(turn[i][0] * at(0, 3) + turn[i][1] * at(1, 3) + turn[i][2] * at(2, 3)))]
            return F.array(*cells, *[F.lit(x) for x in (0.0, 0.0, 0.0, 1.0)])

        checked = F.when(F.abs(size) > 0, size).otherwise(F.raise_error(F.lit("a transform without an inverse")))
        return F.when(m.isNotNull(), bind(checked, rows))

    return bind(a, inverted)


def between(source: Column, target: Column) -> Column:
    """The 12 numbers from a voxel of the target affine to the place in the source affine that shows the same point."""
    return F.slice(compose(inverse(source), target), 1, 12)


def to_donor(volumes: DataFrame, column: str, own: Column, donor: Column, order: int = 0) -> DataFrame:
    """The volumes of grid `own` on the grids of their donors, for labels by the nearest voxel."""
    return through(volumes, column, [step(between(own["affine"], donor["affine"]), own["shape"], donor["shape"], order)])


def transform_step(transform: Column, moving: Column, fixed: Column, order: int | Column = 1) -> Column:
    """From the moving grid to the fixed grid by a transform (16 numbers) from points of the fixed space to points of the moving one."""
    return step(F.slice(compose(inverse(moving["affine"]), compose(transform, fixed["affine"])), 1, 12), moving["shape"], fixed["shape"], order)


def inverse_transform_step(transform: Column, moving: Column, fixed: Column, order: int | Column = 1) -> Column:
    """Back from the fixed grid to the moving grid by the inverse of the transform."""
    return step(F.slice(compose(inverse(fixed["affine"]), compose(inverse(transform), moving["affine"])), 1, 12), fixed["shape"], moving["shape"], order)


#: What resizing did to a row: grids, voxel sizes, and the voxels put before and after each axis (negative: cut off).
PADDINGS = "array<array<int>>"
RECORD = f"struct<original_shape:array<int>,original_voxel:array<double>,original_affine:array<double>,zoomed_shape:array<int>,target_shape:array<int>,target_voxel:array<double>,center_padding:{PADDINGS},shape_padding:{PADDINGS},order:int>"


def _box(masks: pa.Array, shapes: pa.Array) -> pa.Array:
    out = []
    for mask, shape in zip(masks, shapes, strict=True):
        box = None
        if mask.is_valid and shape.is_valid:
            voxels = mask.values.to_numpy(zero_copy_only=False)
            if len(voxels) != np.prod(shape.as_py()):
                raise ValueError("the mask has another shape than the volume")
            inside = voxels.reshape(shape.as_py()) > 0
            if inside.any():
                found = [np.flatnonzero(inside.any(tuple(a for a in range(3) if a != axis)))[[0, -1]] for axis in range(3)]
                box = [int(x) for pair in found for x in pair]
        out.append(box)
    return pa.array(out, pa.list_(pa.int32()))


_bounding_box = F.arrow_udf(_box, T.ArrayType(T.IntegerType()))


def bounding_box(mask: Column, shape: Column) -> Column:
    """Least and greatest place of the mask on each axis, six whole numbers; null for an empty mask."""
    return _bounding_box(mask.cast("array<double>"), shape)


def center_padding(box: Column, shape: Column) -> Column:
    """Padding that moves the middle of a bounding box to the middle of the volume; none without a box."""
    by = lambda k: (F.floor(F.get(shape, F.lit(k)) / 2) - F.floor((F.get(box, F.lit(2 * k)) + F.get(box, F.lit(2 * k + 1))) / 2)).cast("int")
    return F.when(box.isNotNull(), F.array(*[F.array(by(k), -by(k)) for k in range(3)])).otherwise(no_padding())


def no_padding() -> Column:
    return F.expr(f"CAST(array(array(0, 0), array(0, 0), array(0, 0)) AS {PADDINGS})")


def voxel_sizes(affine: Column) -> Column:
    at = lambda a, i, j: F.get(a, F.lit(4 * i + j))
    return bind(affine, lambda a: F.when(a.isNotNull(), F.array(*[F.sqrt(at(a, 0, j) * at(a, 0, j) + at(a, 1, j) * at(a, 1, j) + at(a, 2, j) * at(a, 2, j)) for j in range(3)])))


def resize_record(shape: Column, affine: Column, target_shape: Shape, target_voxel: Sequence[float], order: int = 1, center: Column | None = None) -> Column:
    """What resizing to the target will do, as a struct of RECORD: centre, resample to the voxel sizes, pad or crop evenly (the odd voxel after)."""
    wanted, voxel = shape_of(target_shape), numbers(target_voxel)

    def planned(held: Column) -> Column:
        zoomed = F.array(*[F.greatest(F.lit(1), F.bround(F.get(held["s"], F.lit(k)) * F.get(held["v"], F.lit(k)) / target_voxel[k]).cast("int")) for k in range(3)])

        def padded(z: Column) -> Column:
            more = lambda k: F.lit(target_shape[k]) - F.get(z, F.lit(k))
            by = F.array(*[F.array(F.floor(more(k) / 2).cast("int"), (more(k) - F.floor(more(k) / 2)).cast("int")) for k in range(3)])
            part = {"original_shape": held["s"], "original_voxel": held["v"], "original_affine": held["a"], "zoomed_shape": z, "target_shape": wanted, "target_voxel": voxel, "center_padding": held["c"], "shape_padding": by, "order": F.lit(order)}
            return F.struct(*[c.alias(n) for n, c in part.items()]).cast(RECORD)

        return F.when(held["s"].isNotNull() & held["a"].isNotNull(), bind(zoomed, padded))

    middle = no_padding() if center is None else center
    return bind(F.struct(shape_of(shape).alias("s"), voxel_sizes(affine).alias("v"), affine.alias("a"), middle.alias("c")), planned)


def to_json(record: Column) -> Column:
    return F.to_json(record)


def from_json(text: Column) -> Column:
    """The record of its JSON; nothing is evaluated."""
    return F.from_json(text, RECORD)


def _ratio(n: Column, m: Column) -> Column:
    """Steps of the n voxels for one of the m voxels, first and last on each other."""
    return F.when(m > 1, (n - 1) / (m - 1)).otherwise(0.0)


def _diagonal(scale: list[Column], shift: list[Column]) -> Column:
    zero = F.lit(0.0)
    return F.array(*[x for k in range(3) for x in (*[scale[k] if j == k else zero for j in range(3)], shift[k])])


def _parts(record: Column) -> tuple[list[Column], ...]:
    of = lambda name: [F.get(record[name], F.lit(k)) for k in range(3)]
    before = lambda name: [F.get(p, F.lit(0)) for p in of(name)]
    return of("original_shape"), of("zoomed_shape"), of("target_shape"), before("center_padding"), before("shape_padding")


def resize_step(record: Column, order: int | None = None) -> Column:
    """The step that does what the record says."""

    def made(r: Column) -> Column:
        n, m, _, center, pad = _parts(r)
        scale = [_ratio(a, b) for a, b in zip(n, m, strict=True)]
        matrix = _diagonal(scale, [-(p * s) - c for p, s, c in zip(pad, scale, center, strict=True)])
        high = F.array(*[p + b for p, b in zip(pad, m, strict=True)])
        return step(matrix, r["original_shape"], r["target_shape"], r["order"] if order is None else order, False, F.array(*pad), high)

    return bind(record, made)


def unresize_step(record: Column, order: int | None = None) -> Column:
    """The step back to the original grid: voxels that were cut off are 0."""

    def made(r: Column) -> Column:
        n, m, _, center, pad = _parts(r)
        scale = [_ratio(b, a) for a, b in zip(n, m, strict=True)]
        matrix = _diagonal(scale, [c * s + p for c, s, p in zip(center, scale, pad, strict=True)])
        high = F.array(*[b - c for b, c in zip(n, center, strict=True)])
        return step(matrix, r["target_shape"], r["original_shape"], r["order"] if order is None else order, False, F.array(*[-c for c in center]), high)

    return bind(record, made)


def resized_affine(record: Column) -> Column:
    """Target voxel sizes with the signs of the original diagonal, the origin moved by the voxels put before."""
    at = lambda i, j: F.get(record["original_affine"], F.lit(4 * i + j))
    size = lambda k: F.get(record["target_voxel"], F.lit(k))
    origin = lambda k: at(k, 3) - F.get(F.get(record["shape_padding"], F.lit(k)), F.lit(0)) * size(k)
    cells = [x for k in range(3) for x in (*[F.signum(at(k, k)) * size(k) if j == k else F.lit(0.0) for j in range(3)], origin(k))]
    return F.array(*cells, *[F.lit(x) for x in (0.0, 0.0, 0.0, 1.0)])


def resize(volumes: DataFrame, target_shape: Shape, target_voxel: Sequence[float], order: int = 1, roi: str | None = None, record: str | None = None) -> DataFrame:
    """Volumes (shape, affine, voxels) on the target grid, with `record` (JSON) that reverse_resize() needs.

    roi: a column with a mask of the same shape whose middle is moved to the centre first.
    record: a column with the record of an earlier resizing, whose paddings are taken instead.
    """
    box = bounding_box(F.col(roi), F.col("shape")) if roi else F.lit(None).cast("array<int>")
    boxed = volumes.withColumn("_box", box)
    made = resize_record(F.col("shape"), F.col("affine"), target_shape, target_voxel, order, center_padding(F.col("_box"), F.col("shape")))
    made = F.coalesce(from_json(F.col(record)), made) if record else made
    held = boxed.select("*", F.explode(F.array(made)).alias("_record")).drop("_box")
    out = through(held, "voxels", [resize_step(F.col("_record"))])
    return out.withColumn("shape", F.col("_record.target_shape")).withColumn("affine", resized_affine(F.col("_record"))).withColumn("record", to_json(F.col("_record"))).drop("_record")


def reverse_resize(volumes: DataFrame, order: int | None = None) -> DataFrame:
    """Volumes with `record` back on their original grids."""
    held = volumes.select("*", F.explode(F.array(from_json(F.col("record")))).alias("_record"))
    out = through(held, "voxels", [unresize_step(F.col("_record"), order)])
    return out.withColumn("shape", F.col("_record.original_shape")).withColumn("affine", F.col("_record.original_affine")).drop("_record")


#: A recorded step: kind "transform" (a transform with its fixed and moving grid) or "padding" (a record of resizing).
CHAIN = f"array<struct<kind:string,transform:array<double>,fixed:{GRID},moving:{GRID},padding:{RECORD}>>"


def chain_steps(chain: Column, reverse: bool = False, order: int | None = None) -> Column:
    """The resampling steps of a chain in JSON, or in reverse order the inverse of each. Transforms are linear; an unknown kind is an error."""
    forth, back = (transform_step, resize_step), (inverse_transform_step, unresize_step)
    by_transform, by_padding = back if reverse else forth

    def one(s: Column) -> Column:
        unknown = F.raise_error(F.concat(F.lit("unsupported step: "), F.coalesce(s["kind"], F.lit("null")))).cast(STEP)
        return F.when(s["kind"] == "transform", by_transform(s["transform"], s["moving"], s["fixed"])).when(s["kind"] == "padding", by_padding(s["padding"], order)).otherwise(unknown)

    steps = F.from_json(chain, CHAIN)
    return F.transform(F.reverse(steps) if reverse else steps, one)


def apply_chain(volumes: DataFrame, column: str, chain: Column, reverse: bool = False, order: int | None = None) -> DataFrame:
    """The volumes after the steps of their chains: all of them in one pass over the voxels."""
    return through(volumes, column, chain_steps(chain, reverse, order))
