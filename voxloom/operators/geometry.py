"""Volumes resampled through affine maps, fitted to a grid with a record, and brought back; votes with ties; class rules.

As in volumes.py a volume is one array a row, and every operator is a Column expression without a shuffle.
"""

from __future__ import annotations

import json
import operator
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from voxloom.operators import volumes as V
from voxloom.operators.kernels import numbers, resampled, step
from voxloom.operators.volumes import Shape, Step

#: Three rows of four numbers or Columns: the input place of the output voxel (x, y, z, 1).
Affine = Sequence[Sequence[float | Column]]


def affine_resample(values: Column, shape: Shape, out: Shape, rows: Affine, order: int = 1) -> Column:
    """Order 0: nearest voxel, halves up; order 1: linear. Places more than half a voxel outside give 0, others are drawn to the border."""

    def places(x: Column, y: Column, z: Column) -> list[Column]:
        return [a * x + b * y + c * z + d for a, b, c, d in rows]

    if order == 0:
        return V.regrid(values, shape, out, lambda *p: tuple(F.floor(x + 0.5) for x in places(*p)))
    if order != 1:
        raise ValueError(f"order {order} is neither 0 nor 1")

    return resampled(values, F.array(step(numbers([x for row in rows for x in row]), shape, out)))


def rotate_slices(values: Column, shape: Shape, degrees: Column, order: int = 1) -> Column:
    """Every slice turned about its centre by the same angle, zeros where nothing was; order 0 for masks and labels."""
    mx, my = (shape[0] - 1) / 2, (shape[1] - 1) / 2

    c, s = F.cos(F.radians(degrees)), F.sin(F.radians(degrees))
    rows = [[c, s, F.lit(0.0), mx - c * mx - s * my], [-s, c, F.lit(0.0), my + s * mx - c * my], [0.0, 0.0, 1.0, 0.0]]
    return affine_resample(values, shape, shape, rows, order)


def shifted(values: Column, shape: Shape, by: Sequence[Column]) -> Column:
    """The volume moved by whole voxels on each axis, zeros where nothing was."""
    return V.regrid(values, shape, shape, lambda *p: tuple(x - s for x, s in zip(p, by, strict=True)))


def roi_shift(mask: Column, shape: Shape) -> list[Column]:
    """Voxels by which the middle of the mask's bounding box is off the centre of the volume, on each axis; null for an empty mask."""
    inside = F.filter(F.sequence(F.lit(0), F.lit(shape[0] * shape[1] * shape[2] - 1)), lambda i: F.get(mask, i) > 0)
    axes = [lambda i: F.floor(i / (shape[1] * shape[2])), lambda i: F.floor(i / shape[2]) % shape[1], lambda i: i % shape[2]]
    return [_off_centre(F.transform(inside, axis), n) for axis, n in zip(axes, shape, strict=True)]


def _off_centre(places: Column, n: int) -> Column:
    return F.lit(n // 2) - F.floor((F.array_min(places) + F.array_max(places)) / 2)


@dataclass(frozen=True)
class Fit:
    """How a volume was fitted: its shape, the shape after resampling, and the padding of each axis (negative: cropped)."""

    shape: Shape
    zoomed: Shape
    by: tuple[tuple[int, int], ...]
    order: int


def fit(values: Column, shape: Shape, voxel: Sequence[float], wanted: Sequence[float], target: Shape, order: int = 1) -> tuple[Column, Fit]:
    """The volume at the wanted voxel sizes, centred in the target grid, with the record that unfit() needs."""
    zoomed = tuple(max(1, round(n * a / b)) for n, a, b in zip(shape, voxel, wanted, strict=True))
    by = tuple(((t - n) // 2, t - n - (t - n) // 2) for n, t in zip(zoomed, target, strict=True))
    resample = V.resample_linear if order else V.resample_nearest
    return V.pad(resample(values, shape, zoomed), zoomed, by)[0], Fit(shape, zoomed, by, order)


def unfit(values: Column, record: Fit) -> Column:
    """Back to the grid before fit(): what was cropped is 0, and resampling twice is exact only where it lost nothing."""
    target = tuple(n + a + b for n, (a, b) in zip(record.zoomed, record.by, strict=True))
    inner, _ = V.pad(values, target, [(-a, -b) for a, b in record.by])
    return (V.resample_linear if record.order else V.resample_nearest)(inner, record.zoomed, record.shape)


def align(values: Column, shape: Shape, plane: str, least: tuple[int, int], slices: int) -> tuple[Column, Shape, list[Step]]:
    """Axes in the order of the plane, height and width at least `least`, `slices` zero slices at both ends; and the steps, for apply_steps()."""
    turned = tuple(shape[a] for a in V.PLANES[plane])
    more = [max(0, m - n) for m, n in zip(least, turned[:2], strict=True)]
    steps: list[Step] = [("reorder", plane), ("pad", (*((d // 2, d - d // 2) for d in more), (slices, slices)))]
    return *V.apply_steps(values, shape, steps), steps


def undo_pad_slices(values: Column, shape: Shape, slices: int) -> tuple[Column, Shape]:
    """The slices at both ends cut off, fewer where none would be left."""
    cut = min(slices, max(shape[2] // 2 - 1, 0))
    return V.pad(values, shape, [(0, 0), (0, 0), (-cut, -cut)])


def to_record(steps: Sequence[Step]) -> str:
    """Steps as JSON."""
    return json.dumps([{"kind": kind, "arg": arg} for kind, arg in steps])


def from_record(text: str) -> list[Step]:
    """Steps of their JSON; an unknown kind is an error once they are applied."""
    return [(s["kind"], s["arg"]) for s in json.loads(text)]


def by_channel(values: Column, channels: int, body: Callable[[Column], Column]) -> Column:
    """body of the volume of each channel, where the `channels` values of a voxel lie side by side."""

    def one(c: int) -> Column:
        return body(F.filter(values, lambda _, i: i % channels == c))

    zipped = F.arrays_zip(*[one(c).alias(f"c{c}") for c in range(channels)])
    return F.flatten(F.transform(zipped, lambda s: F.array(*[s[f"c{c}"] for c in range(channels)])))


def label_with_ties(joint: Column, chosen: Column | None) -> Column:
    """Class of the greatest joint value; where another is as near as rounding, the class of the chosen model's greatest value, or 0 without one."""
    top = F.array_max(joint)
    close = F.filter(joint, lambda p: F.abs(p - top) <= 1e-8 + 1e-5 * F.abs(top))
    return F.when(F.size(close) == 1, V.argmax(joint)).otherwise(F.lit(0) if chosen is None else V.argmax(chosen))


def passes_classes(present: Column, modes: dict[tuple[int, ...], str]) -> Column:
    """Whether the classes present pass every rule: all, any or none of its classes. Without classes all and none pass, any does not."""
    hits = []
    for classes, mode in modes.items():
        wanted = F.array(*map(F.lit, classes)).cast("array<int>")
        if mode == "all":
            hits.append(F.size(F.array_except(wanted, present)) == 0)
        elif mode in ("any", "none"):
            some = F.size(F.array_intersect(wanted, present)) > 0
            hits.append(some if mode == "any" else ~some)
        else:
            raise ValueError(f"neither all, any nor none: {mode}")
    return reduce(operator.and_, hits, F.lit(True))


def input_shape(shape: Shape, plane: str, least: tuple[int, int], slices: int) -> Shape:
    """Shape of a volume after align()."""
    turned = tuple(shape[a] for a in V.PLANES[plane])
    return max(turned[0], least[0]), max(turned[1], least[1]), turned[2] + 2 * slices
