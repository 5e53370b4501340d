"""Grids, inverse transforms, resizing with a record, and chains, on volumes of unlike shapes."""

import json

import numpy as np
import pytest

from pyspark.sql import functions as F

from voxloom.operators import kernels
from voxloom.operators import resampling as R

SCHEMA = "id long, voxels array<double>, shape array<int>, affine array<double>, mask array<double>"
UNIT = np.eye(4).ravel().tolist()


def affine(rng, diagonal=(1.5, -1.0, 2.0)):
    a = np.eye(4)
    a[:3, :3] = np.diag(diagonal) + rng.normal(0, 0.1, (3, 3))
    a[:3, 3] = rng.normal(0, 2, 3)
    return a


def frame(spark, rows):
    return spark.createDataFrame([(i, v, s, a, m) for i, (v, s, a, m) in enumerate(rows)], SCHEMA)


def by_id(df):
    return {r["id"]: r for r in df.collect()}


def test_inverse_and_product(spark):
    rng = np.random.default_rng(0)
    rows = [(affine(rng), affine(rng)) for _ in range(20)]
    df = spark.createDataFrame([(a.ravel().tolist(), b.ravel().tolist()) for a, b in rows] + [(None, UNIT)], "a array<double>, b array<double>")
    got = df.select(R.inverse(F.col("a")).alias("i"), R.compose(F.col("a"), F.col("b")).alias("p")).collect()
    for (a, b), r in zip(rows, got, strict=False):
        assert np.allclose(np.array(r["i"]).reshape(4, 4), np.linalg.inv(a)) and np.allclose(np.array(r["p"]).reshape(4, 4), a @ b)
    assert got[-1]["i"] is None and got[-1]["p"] is None
    with pytest.raises(Exception, match="without an inverse"):
        spark.createDataFrame([([0.0] * 16,)], "a array<double>").select(R.inverse(F.col("a"))).collect()


def test_own_grid_as_donor_changes_nothing_and_unlike_grids_share_points(spark):
    rng = np.random.default_rng(1)
    rows, donors = [], []
    for _ in range(12):
        shape = rng.integers(1, 6, 3).tolist()
        rows.append((rng.normal(size=int(np.prod(shape))).tolist(), shape, affine(rng).ravel().tolist(), None))
    rows.append((None, [1, 1, 1], UNIT, None))
    df = frame(spark, rows)
    own = R.grid(F.col("shape"), F.col("affine"))
    assert all(r["voxels"] == rows[i][0] for i, r in by_id(R.to_donor(df, "voxels", own, own)).items())
    donor = affine(rng)
    donors = by_id(R.to_donor(df, "voxels", own, R.grid((3, 4, 5), donor.ravel().tolist())))
    for i, (voxels, shape, a, _) in enumerate(rows[:-1]):
        want = np.zeros((3, 4, 5))
        for at in np.ndindex(3, 4, 5):
            place = np.floor((np.linalg.inv(np.array(a).reshape(4, 4)) @ donor @ [*at, 1])[:3] + 0.5).astype(int)
            if (place >= 0).all() and (place < shape).all():
                want[at] = np.array(voxels).reshape(shape)[tuple(place)]
        assert np.allclose(donors[i]["voxels"], want.ravel())
    assert donors[len(rows) - 1]["voxels"] is None


def test_linear_steps_are_those_of_eight_neighbours():
    rng = np.random.default_rng(2)
    for drawn in (True, False):
        shape, out, values = (3, 4, 2), (4, 3, 5), rng.normal(size=(2, 24))
        matrix = np.concatenate([np.eye(3) * 0.7 + rng.normal(0, 0.2, (3, 3)), rng.normal(0, 1, (3, 1))], axis=1)
        got = kernels._resample(values, {"matrix": matrix.ravel().tolist(), "shape": shape, "out": out, "low": [0, 1, 0], "high": [4, 3, 4], "order": 1, "drawn": drawn})
        for k in range(2):
            cube = values[k].reshape(shape)
            for n, at in enumerate(np.ndindex(out)):
                place, total = matrix @ [*at, 1], 0.0
                if at[1] < 1 or at[2] >= 4 or (drawn and any(p < -0.5 or p >= s - 0.5 for p, s in zip(place, shape, strict=True))):
                    place = None
                elif drawn:
                    place = [min(max(p, 0), s - 1) for p, s in zip(place, shape, strict=True)]
                if place is not None:
                    total = sum(cube[c] * np.prod([max(0, 1 - abs(p - x)) for p, x in zip(place, c, strict=True)]) for c in np.ndindex(shape))
                assert abs(got[k, n] - total) < 1e-12


def test_resizing_and_back(spark):
    """Where the target loses nothing the way back gives every voxel, with a centre moved to either side, and the recorded grid."""
    rng = np.random.default_rng(3)
    rows = []
    for where in [(0, 0, 0), (4, 1, 2), (2, 3, 0)]:
        shape = (5, 4, 3)
        cube, mask = np.zeros(shape), np.zeros(shape)
        cube[where], mask[where] = 7.0, 1
        cube[2, 2, 1] = rng.normal()
        # 9, 7 and 5 voxels for 5, 4 and 3: every old voxel stands on a new one
        grid = np.diag([1.8, -1.75, 5 / 3, 1.0])
        grid[:3, 3] = rng.normal(0, 2, 3)
        rows.append((cube.ravel().tolist(), list(shape), grid.ravel().tolist(), mask.ravel().tolist()))
    rows.append((rows[0][0], [5, 4, 3], rows[0][2], [0.0] * 60))
    rows.append((None, None, None, None))
    out = R.resize(frame(spark, rows), (20, 20, 20), (1.0, 1.0, 1.0), roi="mask")
    back = by_id(R.reverse_resize(out))
    for i, r in by_id(out).items():
        if i == 4:
            assert r["voxels"] is None and back[i]["voxels"] is None
            continue
        record = json.loads(r["record"])
        s = [p[0] for p in record["center_padding"]]
        assert record["center_padding"] == [[k, -k] for k in s] and r["shape"] == [20, 20, 20]
        inside = np.zeros((5, 4, 3), bool)
        inside[tuple(slice(max(0, -k), min(n, n - k)) for k, n in zip(s, (5, 4, 3), strict=True))] = True
        want = np.where(inside.ravel(), rows[i][0], 0)
        assert np.allclose(back[i]["voxels"], want) and back[i]["affine"] == rows[i][2] and back[i]["shape"] == [5, 4, 3]
    assert json.loads(by_id(out)[0]["record"])["center_padding"] == [[2, -2], [2, -2], [1, -1]]
    assert json.loads(by_id(out)[1]["record"])["center_padding"] == [[-2, 2], [1, -1], [-1, 1]]
    again = by_id(R.resize(R.reverse_resize(out).drop("mask"), (20, 20, 20), (1.0, 1.0, 1.0), record="record"))
    assert all(again[i]["record"] == r["record"] for i, r in by_id(out).items())


def test_masks_of_another_shape_are_refused(spark):
    with pytest.raises(Exception, match="another shape"):
        R.resize(frame(spark, [([1.0] * 8, [2, 2, 2], UNIT, [1.0] * 4)]), (2, 2, 2), (1.0, 1.0, 1.0), roi="mask").collect()


def test_chains_there_and_back_and_unknown_kinds(spark):
    shift = np.eye(4)
    shift[:3, 3] = [1, -1, 0]
    cube = np.zeros((4, 4, 4))
    cube[1, 2, 1], cube[2, 1, 2] = 3.0, 5.0
    fixed = {"shape": [4, 4, 4], "affine": UNIT}
    step = {"kind": "transform", "transform": shift.ravel().tolist(), "fixed": fixed, "moving": fixed}
    df = frame(spark, [(cube.ravel().tolist(), [4, 4, 4], UNIT, None)])
    record = json.loads(R.resize(df, (7, 7, 9), (4 / 7, 1.0, 1.0)).first()["record"])
    chain = json.dumps([step, {"kind": "padding", "padding": record}])
    there = R.apply_chain(df.withColumn("chain", F.lit(chain)), "voxels", F.col("chain"))
    assert len(there.first()["voxels"]) == 7 * 7 * 9
    back = np.array(R.apply_chain(there, "voxels", F.col("chain"), reverse=True).first()["voxels"]).reshape(4, 4, 4)
    assert np.allclose(back, cube)
    for bad in ("warp", None):
        with pytest.raises(Exception, match="unsupported step"):
            R.apply_chain(df.withColumn("chain", F.lit(json.dumps([step, {"kind": bad}]))), "voxels", F.col("chain")).collect()


def test_a_volume_of_many_chunks(spark, monkeypatch):
    rng = np.random.default_rng(4)
    values = rng.normal(size=(1, 20 * 30 * 25))
    s = {"matrix": [0.5, 0, 0, 0.1, 0, 0.7, 0, 0, 0, 0, 1, 0.25], "shape": (20, 30, 25), "out": (40, 40, 25), "low": [0, 0, 0], "high": [40, 40, 25], "order": 1, "drawn": True}
    whole = kernels._resample(values, s)
    monkeypatch.setattr(kernels, "_CHUNK", 777)
    assert np.array_equal(kernels._resample(values, s), whole)
