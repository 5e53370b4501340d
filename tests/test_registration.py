"""Registration finds known translations and rotations of smooth volumes."""

import numpy as np
import pytest

from voxloom.operators import registration as G
from voxloom.operators import resampling as R


def blobs(n, seed, place=np.eye(4)):
    """Twelve smooth spots at fixed points of space, seen on a grid of n voxels a side through `place`."""
    rng = np.random.default_rng(seed)
    grid = np.stack(np.meshgrid(*[np.arange(n)] * 3, indexing="ij")).reshape(3, -1).astype(float)
    points, out = (place @ np.vstack([grid, np.ones(grid.shape[1])]))[:3], np.zeros(grid.shape[1])
    for _ in range(12):
        spot, width, height = rng.uniform(4, 12, 3), rng.uniform(1.5, 3), rng.uniform(0.3, 1)
        out += height * np.exp(-((points - spot[:, None]) ** 2).sum(0) / (2 * width * width))
    return out.reshape(n, n, n)


def apart(a, b):
    points = np.vstack([np.random.default_rng(0).uniform(3, 13, (3, 50)), np.ones(50)])
    return np.abs(((a - b) @ points)[:3]).max()


@pytest.mark.parametrize("metric", ["information", "correlation"])
def test_translations_within_a_tenth_of_a_voxel(metric):
    for seed in range(2):
        known = np.eye(4)
        known[:3, 3] = np.random.default_rng(seed).uniform(-1.5, 1.5, 3)
        fixed, moving = blobs(16, seed, known), blobs(16, seed)
        moving = moving if metric == "correlation" else 1 - moving**2
        found, _ = G.register(fixed, np.eye(4), moving, np.eye(4), G.Search("translation", metric, least=1e-2))
        assert apart(found, known) < 0.1


def test_rotations_within_half_a_voxel_on_unlike_grids():
    center, radius = np.full(3, 7.5), 13.0
    known = G.matrix("rigid", np.array([0.8, -0.5, 0.3, 1.2, -0.8, 1.0]), center, radius)
    grid = np.diag([0.8, 0.8, 0.8, 1.0])
    found, value = G.register(blobs(16, 5, known), np.eye(4), blobs(20, 5, grid), grid, G.Search("rigid", "correlation", least=1e-3))
    assert apart(found, known) < 0.5 and value > 0.99


def test_transform_of_parameters():
    assert np.allclose(G.matrix("rigid", np.zeros(6), np.ones(3), 2.0), np.eye(4)) and np.allclose(G.matrix("affine", np.zeros(12), np.ones(3), 2.0), np.eye(4))
    turned = G.matrix("rigid", np.array([0, 0, 0, 0, 0, np.pi]), np.array([1.0, 2, 3]), 2.0)
    assert np.allclose(turned @ [1, 2, 3, 1], [1, 2, 3, 1]) and np.allclose(turned @ [2, 2, 3, 1], [1, 3, 3, 1])
    for bad in (G.Search("warp"), G.Search(metric="sum")):
        with pytest.raises(ValueError):
            G.register(np.ones((2, 2, 2)), np.eye(4), np.ones((2, 2, 2)), np.eye(4), bad)


def test_pairs_become_transforms_that_resampling_reads(spark):
    from pyspark.sql import functions as F

    known = np.eye(4)
    known[:3, 3] = [1.0, -1.0, 0.5]
    fixed, moving, unit = blobs(16, 3, known).ravel().tolist(), blobs(16, 3).ravel().tolist(), np.eye(4).ravel().tolist()
    df = spark.createDataFrame([(1, fixed, moving), (2, None, moving), (3, [1.0] * 4096, [1.0] * 4096)], "id int, f array<double>, m array<double>")
    grid = R.grid((16, 16, 16), unit)
    found = G.register_pairs(df, "f", "m", grid, grid, G.Search("translation", "correlation", least=1e-2))
    got = {r["id"]: r for r in found.collect()}
    assert apart(np.array(got[1]["transform"]).reshape(4, 4), known) < 0.1 and got[1]["metric"] > 0.99
    assert got[2]["transform"] is None and got[3]["transform"] == unit
    laid = R.through(found.where("id = 1"), "m", [R.transform_step(F.col("transform"), grid, grid)]).first()
    inner = np.s_[3:13, 3:13, 3:13]
    assert np.abs(np.array(laid["m"]).reshape(16, 16, 16)[inner] - np.array(fixed).reshape(16, 16, 16)[inner]).max() < 0.1
