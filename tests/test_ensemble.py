"""The ensemble against a plain loop, with several channels and output slices, and from files to files."""

import os

import numpy as np
import pytest

from voxloom.operators import ensemble as E
from voxloom.operators import volumes as V
from voxloom.sources import nifti, volume_files


def counting(path, weights, outputs, classes):
    """A linear model that notes in `path` that it was loaded."""

    def load():
        with open(path, "a") as f:
            f.write(f"{os.getpid()}\n")

        def predict(windows):
            flat = windows @ weights
            return flat.reshape(*windows.shape[:3], outputs, classes)

        return predict

    return load


def plain(channels, mask, model, predict):
    axes = V.PLANES[model.plane]
    cubes, m = [np.transpose(c, axes) for c in channels], np.transpose(mask, axes)
    more = [max(0, a - b) for a, b in zip(model.least, m.shape[:2], strict=True)]
    pads = [(d // 2, d - d // 2) for d in more]
    padded = [np.pad(c, [*pads, (0, 0)]) for c in cubes]
    out = np.zeros((*padded[0].shape, model.classes))
    for z in range(m.shape[2]):
        if not (m[:, :, z] > 0).any():
            continue
        parts = []
        for at in range(z - model.inputs // 2, z - model.inputs // 2 + model.inputs):
            for c in padded:
                parts.append(c[:, :, at] if 0 <= at < m.shape[2] else np.zeros(padded[0].shape[:2]))
        found = predict(np.stack(parts, -1)[None])[0]
        for o in range(model.outputs):
            at = z - model.outputs // 2 + o
            if 0 <= at < m.shape[2]:
                out[:, :, at] = found[:, :, o]
    out = out[pads[0][0] : pads[0][0] + m.shape[0], pads[1][0] : pads[1][0] + m.shape[1]]
    back = np.zeros((*mask.shape, model.classes))
    for index in np.ndindex(*m.shape):
        place = [0, 0, 0]
        for k, a in enumerate(axes):
            place[a] = index[k]
        back[tuple(place)] = out[index]
    return back * (mask > 0.5)[..., None]


def models(path):
    rng = np.random.default_rng(0)
    kinds = [("axial", 3, 1, (1, 1)), ("sagittal", 5, 3, (7, 2)), ("coronal", 4, 2, (4, 9))]
    return [E.Model(f"m{k}", counting(path, rng.normal(size=(2 * n, o * 3)), o, 3), plane, n, o, 3, least) for k, (plane, n, o, least) in enumerate(kinds)]


SCHEMA = "id int, a array<double>, b array<double>, mask array<double>, shape array<int>"


def rows():
    rng = np.random.default_rng(1)
    out = []
    for k in range(8):
        shape = rng.integers(2, 7, 3).tolist()
        n = int(np.prod(shape))
        out.append((k, rng.normal(size=n).tolist(), rng.normal(size=n).tolist(), ((rng.random(n) < 0.3) * (k > 0)).astype(float).tolist(), shape))
    return out


@pytest.mark.parametrize("method", ["majority_vote", "average_prob", "max_prob"])
def test_labels_are_those_of_a_plain_loop(spark, tmp_path, method):
    made, data = models(str(tmp_path / "loads")), rows()
    df = spark.createDataFrame([*data, (99, None, None, None, [1, 1, 1])], SCHEMA).repartition(3)
    got = {r["id"]: r for r in E.segment(df, ["a", "b"], "mask", made, method, 2, {1: 7, 2: 5}, batch=2, each=True).collect()}
    assert got[99]["labels"] is None
    predicts = [m.load() for m in made]
    for k, a, b, mask, shape in data:
        cubes = [np.array(x).reshape(shape) for x in (a, b, mask)]
        found = [plain(cubes[:2], cubes[2], m, p) for m, p in zip(made, predicts, strict=True)]
        for m, f in zip(made, found, strict=True):
            assert got[k][f"labels_{m.name}"] == f.argmax(-1).ravel().tolist()
        want = []
        for voxel in zip(*[f.reshape(-1, 3) for f in found], strict=True):
            own = [int(np.argmax(v)) for v in voxel]
            joint = [own.count(c) for c in range(3)] if method == "majority_vote" else np.sum(voxel, 0) if method == "average_prob" else np.max(voxel, 0)
            ties = sum(abs(x - max(joint)) <= (0 if method == "majority_vote" else 1e-8 + 1e-5 * abs(max(joint))) for x in joint)
            want.append({0: 0, 1: 7, 2: 5}[own[1] if ties > 1 else int(np.argmax(joint))])
        assert got[k]["labels"] == want


def test_models_are_loaded_once_a_worker(spark, tmp_path):
    made = [E.Model(f"once{k}", counting(str(tmp_path / f"loads{k}"), np.ones((2, 2)), 1, 2)) for k in range(2)]
    df = spark.createDataFrame([(k, *r[1:]) for k, r in enumerate(rows() * 6)], SCHEMA).repartition(12)
    E.segment(df, ["a", "b"], "mask", made).collect()
    for k in range(2):
        pids = (tmp_path / f"loads{k}").read_text().split()
        assert len(pids) == len(set(pids))


def test_wrong_arguments(spark):
    df = spark.createDataFrame(rows(), SCHEMA)
    with pytest.raises(ValueError):
        E.segment(df, ["a"], "mask", [])
    with pytest.raises(ValueError):
        E.merge([np.zeros((1, 2))], "vote")


def test_files_to_files(spark, tmp_path):
    volume_files.register(spark)
    rng, plan, cubes = np.random.default_rng(2), [], {}
    (tmp_path / "in").mkdir()
    (tmp_path / "out").mkdir()
    for s in ("p1", "p2", "p3"):
        affine = np.diag([2.0, 2.0, 3.0, 1.0])
        for role in ("mask", "0", "1"):
            cube = (rng.random((4, 5, 3)) < 0.5).astype("f4") if role == "mask" else rng.normal(size=(4, 5, 3)).astype("f4")
            cubes[s, role] = cube.astype(float)
            (tmp_path / "in" / f"{s}_{role}.nii.gz").write_bytes(nifti.encode(cube, affine, True))
            plan.append((s, role, f"{s}_{role}.nii.gz"))
    (tmp_path / "out" / "p3_seg.nii.gz").write_bytes(nifti.encode(np.zeros((1, 1, 1), "u1"), np.eye(4), True))
    made = models(str(tmp_path / "loads"))
    todo = spark.createDataFrame(plan, "subject string, role string, name string")
    at = [f"file://{tmp_path}/in", f"file://{tmp_path}/out"]
    E.segment_files(spark, todo, *at, made, 2, method="average_prob")
    predicts = [m.load() for m in made]
    for s in ("p1", "p2"):
        found = [plain([cubes[s, "0"], cubes[s, "1"]], cubes[s, "mask"], m, p) for m, p in zip(made, predicts, strict=True)]
        voxels, _, affine, kind = nifti.decode((tmp_path / "out" / f"{s}_seg.nii.gz").read_bytes())
        assert kind == "uint8" and (voxels == E.merge(found, "average_prob")).all() and affine[2, 2] == 3.0
    assert nifti.decode((tmp_path / "out" / "p3_seg.nii.gz").read_bytes())[0].shape == (1, 1, 1)
    with pytest.raises(Exception, match="a file is missing of p9"):
        E.segment_files(spark, spark.createDataFrame([("p9", "mask", "p1_mask.nii.gz"), ("p9", "0", "none.nii")], todo.schema), *at, made, 1)
