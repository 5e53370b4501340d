"""Registration of volume pairs: a translation, rigid or affine transform by mutual information or correlation, a pair a row.

The transform (16 numbers) takes points of the fixed space to points of the moving one, as resampling.transform_step reads it.
It starts with the centres of both grids on each other and follows the gradient of the metric in steps of a given length,
which is halved whenever the direction turns back, until a step is too short or the iterations are used up.
Volumes are looked at coarsely first where they are large, then at every voxel up to a bound that is a parameter.
A pair with a null has a null transform.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


@dataclass(frozen=True)
class Search:
    """kind: translation, rigid or affine. metric: information (of a joint histogram) or correlation.

    step and least: first and last step length in units of space; voxels: how many of the fixed volume are compared at most,
    those of a regular grid; the coarse pass takes an eighth of them.
    """

    kind: str = "rigid"
    metric: str = "information"
    bins: int = 50
    iterations: int = 200
    step: float = 2.0
    least: float = 1e-4
    voxels: int = 1 << 17


_SIZES = {"translation": 3, "rigid": 6, "affine": 12}


def matrix(kind: str, p: np.ndarray, center: np.ndarray, radius: float) -> np.ndarray:
    """The transform of parameters in units of space: angles and stretches are taken at `radius` from the centre."""
    out = np.eye(4)
    if kind == "rigid":
        a, b, c = p[3:] / radius
        x = np.array([[1, 0, 0], [0, np.cos(a), -np.sin(a)], [0, np.sin(a), np.cos(a)]])
        y = np.array([[np.cos(b), 0, np.sin(b)], [0, 1, 0], [-np.sin(b), 0, np.cos(b)]])
        z = np.array([[np.cos(c), -np.sin(c), 0], [np.sin(c), np.cos(c), 0], [0, 0, 1]])
        out[:3, :3] = z @ y @ x
    elif kind == "affine":
        out[:3, :3] += p[3:].reshape(3, 3) / radius
    out[:3, 3] = p[:3] + center - out[:3, :3] @ center
    return out


def sampled(cube: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Linear values at places (3, n), and which of them lie within the voxel centres."""
    limit = np.array(cube.shape)[:, None] - 1
    inside = ((place >= 0) & (place <= limit)).all(0)
    place = place[:, inside]
    low = np.minimum(np.floor(place).astype(np.int64), np.maximum(limit - 1, 0))
    part = place - low
    flat, total = cube.ravel(), np.zeros(place.shape[1])
    for corner in range(8):
        bits = np.array([corner >> 2 & 1, corner >> 1 & 1, corner & 1])[:, None]
        x, y, z = np.minimum(low + bits, limit)
        total += flat[(x * cube.shape[1] + y) * cube.shape[2] + z] * np.where(bits, part, 1 - part).prod(0)
    return total, inside


def information(fixed: np.ndarray, moving: np.ndarray, bins: int, most: tuple[float, float, float, float]) -> float:
    """Mutual information of two samples: fixed values in bins, moving ones spread over the two nearest."""
    lo, hi, low, high = most
    row = np.clip((fixed - lo) / max(hi - lo, 1e-12) * (bins - 1) + 0.5, 0, bins - 1).astype(np.int64)
    at = np.clip((moving - low) / max(high - low, 1e-12) * (bins - 1), 0, bins - 1)
    left = np.minimum(at.astype(np.int64), bins - 2)
    part = at - left
    joint = np.bincount(row * bins + left, 1 - part, bins * bins) + np.bincount(row * bins + left + 1, part, bins * bins)
    joint = joint.reshape(bins, bins) / len(fixed)
    each = joint.sum(1)[:, None] * joint.sum(0)[None]
    some = joint > 0
    return float((joint[some] * np.log(joint[some] / each[some])).sum())


def correlation(fixed: np.ndarray, moving: np.ndarray) -> float:
    a, b = fixed - fixed.mean(), moving - moving.mean()
    size = np.sqrt((a @ a) * (b @ b))
    return float(a @ b / size) if size > 0 else 0.0


def register(fixed: np.ndarray, fixed_affine: np.ndarray, moving: np.ndarray, moving_affine: np.ndarray, s: Search = Search()) -> tuple[np.ndarray, float]:
    """(transform, value of the metric) that lays the moving volume on the fixed one."""
    if s.kind not in _SIZES:
        raise ValueError(f"neither translation, rigid nor affine: {s.kind}")
    if s.metric not in ("information", "correlation"):
        raise ValueError(f"neither information nor correlation: {s.metric}")
    middle = lambda cube, affine: (affine @ [*((np.array(cube.shape) - 1) / 2), 1])[:3]
    center = middle(fixed, fixed_affine)
    start = middle(moving, moving_affine) - center
    voxel = np.linalg.norm(fixed_affine[:3, :3], axis=0)
    radius = float(max(np.linalg.norm(voxel * np.array(fixed.shape)) / 2, 1e-6))
    back = np.linalg.inv(moving_affine)
    most = (fixed.min(), fixed.max(), moving.min(), moving.max())
    p, value = np.concatenate([start, np.zeros(_SIZES[s.kind] - 3)]), 0.0
    coarse = [(s.voxels // 8, s.step, max(s.least, s.step / 100))]
    for bound, step, least in [*coarse, (s.voxels, s.step / 4, s.least)] if fixed.size > s.voxels // 8 else [(s.voxels, s.step, s.least)]:
        stride = max(1, int(np.ceil((fixed.size / bound) ** (1 / 3))))
        grid = np.stack(np.meshgrid(*[np.arange(0, n, stride) for n in fixed.shape], indexing="ij")).reshape(3, -1)
        values = fixed[tuple(grid)]
        points = np.vstack([fixed_affine[:3, :3] @ grid + fixed_affine[:3, 3:], np.ones(grid.shape[1])])

        def measure(q: np.ndarray) -> float:
            found, inside = sampled(moving, (back @ matrix(s.kind, q, center, radius) @ points)[:3])
            if inside.sum() < max(8, len(inside) // 10):
                return -1.0
            own = values[inside]
            return information(own, found, s.bins, most) if s.metric == "information" else correlation(own, found)

        p, value = _ascend(measure, p, step, least, s.iterations, float(voxel.min()) * stride / 4)
    return matrix(s.kind, p, center, radius), value


def _ascend(measure: Callable[[np.ndarray], float], p: np.ndarray, step: float, least: float, iterations: int, apart: float) -> tuple[np.ndarray, float]:
    """Steps along the gradient, by differences `apart`; the best place met."""
    best, value = p, measure(p)
    before = np.zeros(len(p))
    unit = np.eye(len(p)) * apart
    for _ in range(iterations):
        slope = np.array([measure(p + u) - measure(p - u) for u in unit])
        size = np.linalg.norm(slope)
        if size == 0 or step < least:
            break
        slope /= size
        if slope @ before < 0:
            step /= 2
        before = slope
        p = p + step * slope
        now = measure(p)
        if now > value:
            best, value = p, now
        elif step > apart:
            step /= 2
    return best, value


def register_pairs(pairs: DataFrame, fixed: str, moving: str, fixed_grid: Column, moving_grid: Column, search: Search = Search()) -> DataFrame:
    """The pairs with `transform` and `metric`; columns of voxels, and their grids (shape, affine). Nothing is shuffled."""
    held = pairs.select("*", F.explode(F.array(F.struct(fixed_grid.alias("f"), moving_grid.alias("m")))).alias("_grids"))
    schema = T.StructType([*held.schema.fields, T.StructField("transform", T.ArrayType(T.DoubleType())), T.StructField("metric", T.DoubleType())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            transforms, metrics = [], []
            for k, grids in enumerate(batch["_grids"].to_pylist()):
                found = None
                if batch[fixed][k].is_valid and batch[moving][k].is_valid and all(grids[g] and None not in grids[g].values() for g in "fm"):
                    cube = lambda c, g: batch[c][k].values.to_numpy(zero_copy_only=False).reshape(grids[g]["shape"])
                    affine = lambda g: np.array(grids[g]["affine"]).reshape(4, 4)
                    found = register(cube(fixed, "f"), affine("f"), cube(moving, "m"), affine("m"), search)
                transforms.append(found[0].ravel() if found else None)
                metrics.append(found[1] if found else None)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(transforms, pa.list_(pa.float64())), pa.array(metrics, pa.float64())], names=[*batch.schema.names, "transform", "metric"])

    return held.mapInArrow(run, schema).drop("_grids")
