"""Ensembles of linear models in place of networks, over the volumes of volume_queries.py. Each query with its SQL."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from voxloom.operators import ensemble as E
from voxloom.operators import resampling as R
from voxloom.plans.volume_queries import _VOX, SHAPE, query, volumes, voxels

#: For each plane and class the weights of the slice before, the slice itself and the one after, and a constant.
WEIGHTS = {
    "axial": [(0.5, 1.0, -0.5, 0.1), (-1.0, 2.0, 0.25, 0.0), (0.0, -3.0, 1.0, 0.05)],
    "sagittal": [(1.0, -1.0, 1.0, 0.0), (0.25, 2.5, 0.5, -0.1), (-0.75, 0.5, 2.0, 0.1)],
    "coronal": [(0.0, 0.5, 0.0, 0.2), (2.0, 1.0, -1.0, 0.0), (-2.0, -1.0, 1.5, 0.1)],
}
MAPPING = {1: 4, 2: 1}


def _linear(plane: str):
    weights = np.array(WEIGHTS[plane])

    def load():
        def predict(windows: np.ndarray) -> np.ndarray:
            raised = np.exp(windows @ weights[:, :3].T + weights[:, 3])
            return (raised / raised.sum(-1, keepdims=True))[..., None, :]

        return predict

    return load


MODELS = [E.Model(f"linear_{plane}", _linear(plane), plane, inputs=3, classes=3, least=(5, 6)) for plane in WEIGHTS]
_AXES = {"axial": ("z", "x, y"), "sagittal": ("x", "y, z"), "coronal": ("y", "x, z")}
_SIDES = ", ".join(
    f"coalesce(lag(v) OVER (PARTITION BY vec_id, {rest} ORDER BY {axis}), 0) AS {axis}0, coalesce(lead(v) OVER (PARTITION BY vec_id, {rest} ORDER BY {axis}), 0) AS {axis}2, bool_or(m) OVER (PARTITION BY vec_id, {axis}) AS {axis}m"
    for axis, rest in _AXES.values()
)
_RAISED = ", ".join(f"exp({a} * {_AXES[p][0]}0 + {b} * v + {c} * {_AXES[p][0]}2 + {d}) AS {p}{k}" for p, rows in WEIGHTS.items() for k, (a, b, c, d) in enumerate(rows))
_PARTS = ", ".join(f"CASE WHEN m AND {_AXES[p][0]}m THEN {p}{k} / ({p}0 + {p}1 + {p}2) ELSE 0 END AS p_{p}{k}" for p in WEIGHTS for k in range(3))
_FOUND = _VOX + f", s AS (SELECT *, {_SIDES} FROM vox), e AS (SELECT *, {_RAISED} FROM s), p AS (SELECT vec_id, i, {_PARTS} FROM e), "
_JOINT = "j AS (SELECT vec_id, i, " + ", ".join(" + ".join(f"p_{p}{k}" for p in WEIGHTS) + f" AS j{k}" for k in range(3)) + " FROM p) "
_CLOSE = " + ".join(f"(abs(j{k} - greatest(j0, j1, j2)) <= 1e-8 + 1e-5 * greatest(j0, j1, j2))::INT" for k in range(3))


@query(_FOUND + _JOINT + f"SELECT vec_id, i, CASE WHEN {_CLOSE} > 1 THEN 0 WHEN j1 > j0 AND j1 > j2 THEN 4 WHEN j2 > j0 AND j2 > j1 THEN 1 ELSE 0 END AS label FROM j")
def ensemble_average(spark, sf_dir):
    rows = volumes(spark, sf_dir).select("vec_id", "v", "mask", R.shape_of(SHAPE).alias("shape"))
    return voxels(E.segment(rows, ["v"], "mask", MODELS, "average_prob", mapping=MAPPING).select("vec_id", "labels"), "vec_id", F.col("labels"), "label")


_OWN = ", ".join(f"CASE WHEN p_{p}1 > p_{p}0 AND p_{p}1 >= p_{p}2 THEN 1 WHEN p_{p}2 > p_{p}0 AND p_{p}2 > p_{p}1 THEN 2 ELSE 0 END AS l_{p}" for p in WEIGHTS)


@query(_FOUND + f"l AS (SELECT vec_id, i, {_OWN} FROM p) SELECT vec_id, i, CASE WHEN l_axial = l_sagittal OR l_axial = l_coronal THEN l_axial WHEN l_sagittal = l_coronal THEN l_sagittal ELSE l_sagittal END AS label FROM l")
def ensemble_majority(spark, sf_dir):
    """Three models, the second breaks ties."""
    rows = volumes(spark, sf_dir).select("vec_id", "v", "mask", R.shape_of(SHAPE).alias("shape"))
    return voxels(E.segment(rows, ["v"], "mask", MODELS, "majority_vote", tiebreaker=2).select("vec_id", "labels"), "vec_id", F.col("labels"), "label")
