"""Resampling steps as Columns, and the numpy pass that takes the voxels of a batch through them."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

Shape = tuple[int, int, int]
#: Output voxels, and values of a block of rows, handled by one numpy step.
_CHUNK, _BLOCK = 1 << 18, 1 << 22
#: matrix (12 numbers): from an output voxel to an input place; voxels outside low <= i < high are 0; `drawn`: see step().
STEP = "struct<matrix:array<double>,shape:array<int>,out:array<int>,low:array<int>,high:array<int>,order:int,drawn:boolean>"


def numbers(values: Sequence[float | Column]) -> Column:
    return F.array(*[v if isinstance(v, Column) else F.lit(float(v)) for v in values]).cast("array<double>")


def shape_of(values: Sequence[int] | Column) -> Column:
    return (values if isinstance(values, Column) else F.array(*map(F.lit, values))).cast("array<int>")


def step(matrix: Column, shape: Shape | Column, out: Shape | Column, order: int | Column = 1, drawn: bool = True, low: Column | None = None, high: Column | None = None) -> Column:
    """One resampling. Order 0: nearest voxel, halves up; order 1: linear.

    drawn: linear places up to half a voxel outside are drawn to the border and those beyond give 0; else voxels outside count as 0.
    """
    out = shape_of(out)
    order = order if isinstance(order, Column) else F.lit(order)
    part = {"matrix": matrix, "shape": shape_of(shape), "out": out, "low": F.array(*[F.lit(0)] * 3) if low is None else low, "high": out if high is None else high, "order": order, "drawn": F.lit(drawn)}
    return F.struct(*[c.alias(n) for n, c in part.items()]).cast(STEP)


def _resample(values: np.ndarray, s: dict) -> np.ndarray:
    """Rows of values through one step."""
    shape, out = s["shape"], s["out"]
    turn, shift = np.array(s["matrix"]).reshape(3, 4)[:, :3], np.array(s["matrix"]).reshape(3, 4)[:, 3:]
    result = np.zeros((len(values), out[0] * out[1] * out[2]))
    limit = np.array(shape, float)[:, None]
    for lo in range(0, result.shape[1], _CHUNK):
        i = np.arange(lo, min(result.shape[1], lo + _CHUNK))
        voxel = np.stack([i // (out[1] * out[2]), i // out[2] % out[1], i % out[2]])
        inside = ((voxel >= np.array(s["low"])[:, None]) & (voxel < np.array(s["high"])[:, None])).all(0)
        place = turn @ voxel + shift
        if s["order"] == 0:
            near = np.floor(place + 0.5)
            inside &= ((near >= 0) & (near < limit)).all(0)
            x, y, z = near[:, inside].astype(np.int64)
            result[:, i[inside]] = values[:, (x * shape[1] + y) * shape[2] + z]
            continue
        if s["order"] != 1:
            raise ValueError(f"order {s['order']} is neither 0 nor 1")
        if s["drawn"]:
            inside &= ((place >= -0.5) & (place < limit - 0.5)).all(0)
            place = np.clip(place, 0, limit - 1)
        else:
            inside &= ((place > -1) & (place < limit)).all(0)
        place = place[:, inside]
        low = np.floor(place).astype(np.int64)
        part = place - low
        total = np.zeros((len(values), place.shape[1]))
        for corner in range(8):
            bits = np.array([corner >> 2 & 1, corner >> 1 & 1, corner & 1])[:, None]
            at = low + bits
            weight = np.where(bits, part, 1 - part).prod(0) * ((at >= 0) & (at < limit)).all(0)
            x, y, z = np.clip(at, 0, np.array(shape)[:, None] - 1)
            total += values[:, (x * shape[1] + y) * shape[2] + z] * weight
        result[:, i[inside]] = total
    return result


def _through(values: pa.Array, steps: pa.Array) -> pa.Array:
    if isinstance(values, pa.ChunkedArray):
        values, steps = values.combine_chunks(), steps.combine_chunks()
    chains, parts, sizes = steps.to_pylist(), [], []
    held = np.asarray(values.is_valid())
    starts, ends = np.asarray(values.offsets)[:-1], np.asarray(values.offsets)[1:]
    data = values.values.to_numpy(zero_copy_only=False)
    usable = [bool(ok) and c is not None and all(x is not None and None not in (x["matrix"], x["shape"], x["out"]) for x in c) for ok, c in zip(held, chains, strict=True)]
    k = 0
    while k < len(chains):
        if not usable[k]:
            sizes.append(0)
            k += 1
            continue
        size, stop = ends[k] - starts[k], k + 1
        most = max(1, _BLOCK // max([size, *[int(np.prod(x["out"])) for x in chains[k]]]))
        while stop < len(chains) and stop - k < most and usable[stop] and chains[stop] == chains[k] and ends[stop] - starts[stop] == size and starts[stop] == ends[stop - 1]:
            stop += 1
        block = data[starts[k] : ends[stop - 1]].reshape(stop - k, size)
        for s in chains[k]:
            if block.shape[1] != int(np.prod(s["shape"])):
                raise ValueError(f"{block.shape[1]} voxels are no volume of shape {s['shape']}")
            block = _resample(block, s)
        parts.append(block.ravel())
        sizes += [block.shape[1]] * (stop - k)
        k = stop
    out = pa.array(np.concatenate(parts) if parts else np.zeros(0), pa.float64())
    offsets = pa.array(np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)]), pa.int32(), mask=np.array([*[not u for u in usable], False]))
    return pa.ListArray.from_arrays(offsets, out)


_chain = F.arrow_udf(_through, T.ArrayType(T.DoubleType()))


def resampled(values: Column, steps: Column) -> Column:
    """The volume after an array of steps. Neither argument may hold nested lambda functions, for Spark then leaves the call where it is."""
    return _chain(values.cast("array<double>"), steps.cast(f"array<{STEP}>"))
