"""The volume data source: round trips, headers alone, partitions by size, and failures that leave no file."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxloom.sources import nifti, volume_files


@pytest.fixture
def files(spark, tmp_path):
    volume_files.register(spark)
    rng, want = np.random.default_rng(0), {}
    (tmp_path / "in" / "deep").mkdir(parents=True)
    for k in range(7):
        cube, affine = rng.normal(size=(3, 4, 2 + k)).astype("f4"), np.diag([2.0, -1.0, 1.5, 1.0])
        affine[:3, 3] = rng.integers(-9, 9, 3)
        name = f"v{k}.nii" + (".gz" if k % 2 else "")
        (tmp_path / "in" / ("deep" if k > 4 else "") / name).write_bytes(nifti.encode(cube, affine, bool(k % 2)))
        want[name] = (cube, affine)
    (tmp_path / "in" / "bad.nii").write_bytes(b"no volume")
    (tmp_path / "in" / "bad.nii.gz").write_bytes(b"\x1f\x8b no volume")
    (tmp_path / "in" / "other.txt").write_bytes(b"x")
    return tmp_path, want


def read(spark, at, **options):
    return spark.read.format("volumes").options(**options).load(f"file://{at}")


def names(rows):
    return {r["path"].rsplit("/", 1)[1]: r for r in rows}


def test_round_trip(spark, files):
    at, want = files
    found = read(spark, at / "in")
    got = names(found.collect())
    assert set(got) == {*want, "bad.nii", "bad.nii.gz"} and got["bad.nii"]["voxels"] is None and got["bad.nii.gz"]["shape"] is None
    found.where("voxels is not null").write.format("volumes").mode("append").option("compress", "false").save(f"file://{at}/out")
    assert sorted(os.listdir(at / "out")) == sorted(want)
    for name, r in names(read(spark, at / "out").collect()).items():
        cube, affine = want[name]
        assert r["shape"] == list(cube.shape) and np.array_equal(np.array(r["voxels"]).reshape(cube.shape), cube) and np.array_equal(np.array(r["affine"]).reshape(4, 4), affine)


def test_headers_alone_and_partitions(spark, files):
    at, want = files
    heads = read(spark, at / "in", header_only="true")
    assert "voxels" not in heads.columns
    got = names(heads.collect())
    assert all(got[n]["shape"] == list(c.shape) and np.allclose(got[n]["affine"], a.ravel()) and got[n]["dtype"] == "float32" for n, (c, a) in want.items()) and got["bad.nii.gz"]["shape"] is None
    assert read(spark, at / "in", partition_bytes="1").rdd.getNumPartitions() == 9 and read(spark, at / "in").rdd.getNumPartitions() == 1
    turned = names(read(spark, at / "in", canonical="true", pattern="v1*").collect())
    assert list(turned) == ["v1.nii.gz"] and (np.diag(np.array(turned["v1.nii.gz"]["affine"]).reshape(4, 4)) > 0).all()
    assert volume_files.deal([("a", 5), ("b", 5), ("c", 20), ("d", 1)], 10) == [["a", "b"], ["c"], ["d"]]


def test_failures_leave_no_file(spark, files):
    at, _ = files
    good = read(spark, at / "in").where("voxels is not null")
    (at / "out").mkdir()
    broken = good.withColumn("voxels", F.when(F.col("path").endswith("v6.nii"), None).otherwise(F.col("voxels"))).repartition(4)
    with pytest.raises(Exception, match="no volume to write"):
        broken.write.format("volumes").mode("append").save(f"file://{at}/out")
    assert os.listdir(at / "out") == []
    with pytest.raises(Exception, match="volumes of one name"):
        good.unionByName(good).write.format("volumes").mode("append").save(f"file://{at}/out")
    assert os.listdir(at / "out") == []
    good.write.format("volumes").mode("append").save(f"file://{at}/out")
    with pytest.raises(Exception, match="volumes of one name"):
        good.write.format("volumes").mode("append").save(f"file://{at}/out")
    good.write.format("volumes").mode("overwrite").save(f"file://{at}/out")
    assert len(os.listdir(at / "out")) == 7


def test_flat_and_oblique_volumes_become_canonical():
    flat, affine = nifti.canonical(np.arange(6.0).reshape(2, 3), np.diag([-1.0, 1, 1, 1]))
    assert flat.shape == (2, 3, 1) and affine[0, 0] == 1 and flat[0, 0, 0] == 3
    turn = np.eye(4)
    turn[:3, :3] = np.array([[0.0, 0.6, 0.79], [0.7, -0.5, 0.4], [0.7, 0.6, -0.4]])
    out, moved = nifti.canonical(np.random.default_rng(0).random((2, 3, 4)), turn)
    assert (np.diag(moved)[:3] > 0).all() and sorted(out.shape) == [2, 3, 4]
