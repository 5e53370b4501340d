"""Volumes as one flat array a row (x slowest, z fastest): every operator is a Column expression without a shuffle.

A geometric operator is a map from output to input places; places outside give 0. Nulls give null.
"""

from __future__ import annotations

import ast
import operator
from collections.abc import Callable, Iterable, Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxloom.operators.kernels import Shape, numbers, resampled, step

Place = tuple[Column, Column, Column]


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once a row; within a lambda it would be computed for each element."""
    return F.get(F.transform(F.array(value), body), 0)


def regrid(values: Column, shape: Shape, out: Shape, source: Callable[[Column, Column, Column], Place]) -> Column:
    """The volume of shape `out` whose voxel (x, y, z) is the input's at source(x, y, z)."""

    def at(held: Column, i: Column) -> Column:
        place = source(F.floor(i / (out[1] * out[2])), F.floor(i / out[2]) % out[1], i % out[2])
        inside = reduce(operator.and_, [(p >= 0) & (p < n) for p, n in zip(place, shape, strict=True)])
        return F.when(inside, F.get(held, ((place[0] * shape[1] + place[1]) * shape[2] + place[2]).cast("int"))).otherwise(F.lit(0.0))

    grid = F.sequence(F.lit(0), F.lit(out[0] * out[1] * out[2] - 1))
    return bind(values, lambda held: F.when(held.isNotNull(), F.transform(grid, lambda i: at(held, i))))


#: Which input axis each output axis shows.
PLANES = {"axial": (0, 1, 2), "sagittal": (1, 2, 0), "coronal": (0, 2, 1)}


def reorder_axes(values: Column, shape: Shape, plane: str) -> tuple[Column, Shape]:
    axes = PLANES[plane]
    out = tuple(shape[a] for a in axes)
    return regrid(values, shape, out, lambda *p: tuple(p[axes.index(k)] for k in range(3))), out


def undo_reorder_axes(values: Column, shape: Shape, plane: str) -> tuple[Column, Shape]:
    """shape: of the reordered volume."""
    axes = PLANES[plane]
    out = tuple(shape[axes.index(k)] for k in range(3))
    return regrid(values, shape, out, lambda *p: tuple(p[a] for a in axes)), out


def pad(values: Column, shape: Shape, by: Sequence[tuple[int, int]]) -> tuple[Column, Shape]:
    """Zeros before and after each axis; negative numbers crop."""
    out = tuple(n + a + b for n, (a, b) in zip(shape, by, strict=True))
    if min(out) < 1:
        raise ValueError(f"nothing is left of {shape} padded by {by}")
    return regrid(values, shape, out, lambda *p: tuple(x - a for x, (a, _) in zip(p, by, strict=True))), out


def pad_to(values: Column, shape: Shape, target: Shape) -> tuple[Column, Shape]:
    """Centred to the target; the floor of half the difference goes before."""
    return pad(values, shape, [((t - n) // 2, t - n - (t - n) // 2) for n, t in zip(shape, target, strict=True)])


def flip(values: Column, shape: Shape, axes: Sequence[int]) -> Column:
    return regrid(values, shape, shape, lambda *p: tuple(shape[k] - 1 - x if k in axes else x for k, x in enumerate(p)))


def resample_nearest(values: Column, shape: Shape, out: Shape) -> Column:
    """Endpoint-aligned; halves go up."""
    step = [(n - 1) / (m - 1) if m > 1 else 0.0 for n, m in zip(shape, out, strict=True)]
    return regrid(values, shape, out, lambda *p: tuple(F.floor(x * s + 0.5) for x, s in zip(p, step, strict=True)))


def resample_linear(values: Column, shape: Shape, out: Shape) -> Column:
    """Endpoint-aligned, from the eight voxels around each place."""
    scale = [(n - 1) / (m - 1) if m > 1 else 0.0 for n, m in zip(shape, out, strict=True)]
    matrix = [x for k in range(3) for x in (*[scale[k] if j == k else 0.0 for j in range(3)], 0.0)]
    return resampled(values, F.array(step(numbers(matrix), shape, out)))


#: A step of a geometric pipeline: ("flip", axes), ("reorder", plane) or ("pad", ((before, after), ...)).
Step = tuple[str, object]


def apply_steps(values: Column, shape: Shape, steps: Sequence[Step], reverse: bool = False) -> tuple[Column, Shape]:
    """The ordered steps of a transform record, or in reverse order the inverse of each."""
    for kind, arg in reversed(steps) if reverse else steps:
        if kind == "flip":
            values = flip(values, shape, arg)
        elif kind == "reorder":
            values, shape = (undo_reorder_axes if reverse else reorder_axes)(values, shape, arg)
        elif kind == "pad":
            values, shape = pad(values, shape, [(-a, -b) for a, b in arg] if reverse else arg)
        else:
            raise ValueError(f"unknown step: {kind}")
    return values, shape


def padded_origin(origin: Column, voxel: Sequence[float], by: Sequence[tuple[int, int]]) -> Column:
    """The origin after padding: less the voxels put before it, on each axis."""
    return F.array(*[F.get(origin, k) - F.lit(a * size) for k, (size, (a, _)) in enumerate(zip(voxel, by, strict=True))])


def all_close(a: Column, b: Column, relative: float = 1e-5, absolute: float = 1e-8) -> Column:
    """Whether arrays have one size and all |a - b| <= absolute + relative |b|."""
    return (F.size(a) == F.size(b)) & F.forall(F.zip_with(a, b, lambda x, y: F.abs(x - y) <= absolute + relative * F.abs(y)), lambda x: x)


def mask_channels(values: Column, mask: Column, channels: int) -> Column:
    """Values of voxels (`channels` of them side by side) whose mask exceeds 0.5, zeros elsewhere."""
    chosen = lambda b: F.transform(b["v"], lambda v, i: F.when(F.get(b["m"], F.floor(i / channels).cast("int")) > 0.5, v).otherwise(0.0))
    return bind(F.struct(values.alias("v"), mask.alias("m")), chosen)


def plane_of_orientation(iop: Column, least: float = 0.8) -> Column:
    """SAG, COR or AX by the largest part of the unit normal of six direction cosines; null if it is below `least`."""
    at = lambda k: F.get(iop, k)
    normal = F.array(at(1) * at(5) - at(2) * at(4), at(2) * at(3) - at(0) * at(5), at(0) * at(4) - at(1) * at(3))

    def named(n: Column) -> Column:
        size = F.sqrt(F.get(n, 0) * F.get(n, 0) + F.get(n, 1) * F.get(n, 1) + F.get(n, 2) * F.get(n, 2))
        part = F.transform(n, lambda x: F.abs(F.try_divide(x, size)))
        return F.when(F.array_max(part) >= least, F.element_at(F.array(F.lit("SAG"), F.lit("COR"), F.lit("AX")), argmax(part) + 1))

    return bind(normal, named)


def levels(values: Column, count: int = 4) -> Column:
    return F.transform(values, lambda v: (F.floor(F.abs(v) * 10) % count).cast("int"))


def level_volume(labels: Column, level: int, voxel: float) -> Column:
    """Volume of the voxels of one level, rounded half to even."""
    return F.bround(F.size(F.filter(labels, lambda v: v == level)) * F.lit(voxel)).cast("long")


def zscore(values: Column, mask: Column) -> Column:
    """(v - mean) / population deviation inside the mask, 0 outside; an empty mask or no deviation is an error."""
    inside = F.transform(F.filter(F.arrays_zip(values.alias("v"), mask.alias("m")), lambda p: p["m"] > 0), lambda p: p["v"])
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, v: s + v)

    def scaled(inside: Column, mean: Column) -> Column:
        std = F.sqrt(F.try_divide(total(F.transform(inside, lambda v: (v - mean) * (v - mean))), F.size(inside)))
        checked = F.when(F.size(inside) == 0, F.raise_error(F.lit("mask is empty"))).when(std == 0, F.raise_error(F.lit("no deviation inside the mask"))).otherwise(std)
        return bind(checked, lambda s: F.zip_with(values, mask, lambda v, m: F.when(m > 0, (v - mean) / s).otherwise(0.0)))

    return bind(inside, lambda a: bind(F.try_divide(total(a), F.size(a)), lambda mean: scaled(a, mean)))


def apply_mask(values: Column, mask: Column) -> Column:
    return F.zip_with(values, mask, lambda v, m: F.when(m > 0, v).otherwise(0.0))


def average(volumes: Sequence[Column]) -> Column:
    total = reduce(lambda a, b: F.zip_with(a, b, lambda x, y: x + y), volumes)
    return F.transform(total, lambda v: v / len(volumes))


def merge_or(masks: Sequence[Column]) -> Column:
    binary = [F.transform(m, lambda v: (v > 0).cast("int")) for m in masks]
    return reduce(lambda a, b: F.zip_with(a, b, lambda x, y: F.greatest(x, y)), binary)


def overlay(volumes: Sequence[Column]) -> Column:
    """The first nonzero value, truncated to whole numbers before it is tested."""
    whole = [F.transform(v, lambda x: x.cast("int")) for v in volumes]
    return reduce(lambda a, b: F.zip_with(a, b, lambda x, y: F.coalesce(F.nullif(x, F.lit(0)), y)), whole)


def remap(labels: Column, mapping: dict[int, int]) -> Column:
    """Labels that are not mapped become 0."""
    table = F.create_map(*[F.lit(x) for pair in mapping.items() for x in pair])
    return F.transform(labels, lambda v: F.coalesce(F.try_element_at(table, v), F.lit(0)))


_BINARY = {ast.Add: operator.add, ast.Sub: operator.sub, ast.Mult: operator.mul, ast.Div: operator.truediv, ast.Pow: F.pow}
_COMPARE = {ast.Gt: operator.gt, ast.Lt: operator.lt, ast.GtE: operator.ge, ast.LtE: operator.le, ast.Eq: operator.eq, ast.NotEq: operator.ne}
_CALLS = {"log": F.ln, "log10": F.log10, "exp": F.exp, "where": lambda c, a, b: F.when(c, a).otherwise(b)}


def volume_expr(text: str, volumes: dict[str, Column]) -> Column:
    """A voxelwise expression over volumes A to Z: + - * / **, comparisons, where, log, log10, exp. Anything else is an error.

    A result that is null or not finite anywhere raises at run time.
    """
    names = sorted(volumes)

    def build(node: ast.AST, at: dict[str, Column]) -> Column:
        match node:
            case ast.Constant(value=int() | float() as v):
                return F.lit(float(v))
            case ast.Name(id=name) if name in at:
                return at[name]
            case ast.BinOp(left=a, op=op, right=b) if type(op) in _BINARY:
                return _BINARY[type(op)](build(a, at), build(b, at))
            case ast.UnaryOp(op=ast.USub(), operand=a):
                return -build(a, at)
            case ast.Compare(left=a, ops=[op], comparators=[b]) if type(op) in _COMPARE:
                return _COMPARE[type(op)](build(a, at), build(b, at))
            case ast.Call(func=ast.Name(id=f), args=args, keywords=[]) if f in _CALLS:
                return _CALLS[f](*[build(a, at) for a in args])
        raise ValueError(f"not allowed in a volume expression: {ast.dump(node)}")

    tree = ast.parse(text, mode="eval").body
    build(tree, {n: F.lit(1.0) for n in names})
    zipped = F.arrays_zip(*[volumes[n].alias(n) for n in names])
    out = F.transform(zipped, lambda p: build(tree, {n: p[n] for n in names}))
    bad = lambda held: F.exists(held, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return bind(out, lambda held: F.when(bad(held), F.raise_error(F.lit(f"not finite: {text}"))).otherwise(held))


def slab_at(values: Column, shape: Shape, width: int, z: Column) -> Column:
    """The slices z - width // 2 and on, `width` of them, zeros beyond the ends: an array of x, y, slice."""

    def at(b: Column, i: Column) -> Column:
        s = b["z"] - width // 2 + i % width
        return F.when((s >= 0) & (s < shape[2]), F.get(b["v"], (F.floor(i / width) * shape[2] + s).cast("int"))).otherwise(0.0)

    places = F.sequence(F.lit(0), F.lit(shape[0] * shape[1] * width - 1))
    return bind(F.struct(values.alias("v"), z.alias("z")), lambda b: F.transform(places, lambda i: at(b, i)))


def reassemble(windows: Column, shape: Shape, width: int) -> Column:
    """The volume from the slab of each z: of the slabs that hold a slice the one of greatest z is taken."""

    def at(held: Column, i: Column) -> Column:
        s = i % shape[2]
        center = F.least(s + width // 2, F.lit(shape[2] - 1))
        return F.get(F.get(held, center.cast("int")), (F.floor(i / shape[2]) * width + s - center + width // 2).cast("int"))

    places = F.sequence(F.lit(0), F.lit(shape[0] * shape[1] * shape[2] - 1))
    return bind(windows, lambda held: F.transform(places, lambda i: at(held, i)))


def per_voxel(values: Column, channels: int, body: Callable[[Column], Column]) -> Column:
    """body of the `channels` values of each voxel, that lie side by side."""
    return bind(values, lambda held: F.transform(F.sequence(F.lit(0), (F.size(held) / channels - 1).cast("int")), lambda j: body(F.slice(held, j * channels + 1, channels))))


def fill_holes(masks: DataFrame, column: str, shape: Shape) -> DataFrame:
    """The masks with zeros that no path of zeros (over faces) joins to the border set to 1; one numpy volume at a time. Null masks stay null."""

    def filled(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for mask in batch[column]:
                if not mask.is_valid:
                    out.append(None)
                    continue
                inside = np.pad(mask.values.to_numpy(zero_copy_only=False).reshape(shape) > 0, 1)
                outside = np.zeros(inside.shape, bool)
                outside[[0, -1]], outside[:, [0, -1]], outside[:, :, [0, -1]] = True, True, True
                before = -1
                while (n := int(outside.sum())) != before:
                    before = n
                    for axis in range(3):
                        moved = np.moveaxis(outside, axis, 0)
                        moved[1:] |= moved[:-1]
                        outside &= ~inside
                        moved[:-1] |= moved[1:]
                        outside &= ~inside
                out.append((~outside)[1:-1, 1:-1, 1:-1].ravel().astype(np.int32))
            columns = [pa.array(out, pa.list_(pa.int32())) if name == column else batch[name] for name in batch.schema.names]
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

    return masks.withColumn(column, F.col(column).cast("array<int>")).mapInArrow(filled, masks.withColumn(column, F.col(column).cast("array<int>")).schema)


def argmax(values: Column) -> Column:
    """Place of the first greatest value, from 0."""
    return (F.array_position(values, F.array_max(values)) - 1).cast("int")


def majority(labels: Sequence[Column], tiebreaker: int = 0) -> Column:
    """Voxelwise most frequent label; on a tie the label of model `tiebreaker` (from 1), or 0 for none."""
    zipped = F.transform(F.arrays_zip(*[c.alias(f"m{i}") for i, c in enumerate(labels)]), lambda p: F.array(*[p[f"m{i}"] for i in range(len(labels))]))

    def vote(a: Column) -> Column:
        counts = F.transform(F.array_distinct(a), lambda v: F.struct(F.size(F.filter(a, lambda w: w == v)).alias("n"), v.alias("v")))
        best = F.array_max(F.transform(counts, lambda s: s["n"]))
        top = F.filter(counts, lambda s: s["n"] == best)
        return F.when(F.size(top) == 1, F.get(top, 0)["v"]).otherwise(F.get(a, tiebreaker - 1) if tiebreaker else F.lit(0))

    return F.transform(zipped, vote)
