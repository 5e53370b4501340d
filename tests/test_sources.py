import struct

import numpy as np
import pytest

from pyspark.sql import functions as F

from voxloom.functions import headers
from voxloom.operators import catalog, series
from voxloom.sources import dicom, nifti


@pytest.mark.parametrize("kind", ["u1", "i2", "i4", "f4", "f8", "u2"])
def test_nifti_round_trip(kind):
    voxels = np.arange(24).reshape(2, 3, 4).astype(kind)
    affine = np.array([[0, -2.0, 0, 5], [1.5, 0, 0, -3], [0, 0, 3, 1], [0, 0, 0, 1]])
    for compress in (False, True):
        got, zooms, found, name = nifti.decode(nifti.encode(voxels, affine, compress))
        assert (got == voxels).all() and zooms == [1.5, 2.0, 3.0] and (found == affine).all() and np.dtype(name) == np.dtype(kind)


def test_nifti_scaling_and_byte_order():
    raw = bytearray(nifti.encode(np.array([[[1, 2]]], "i2"), np.eye(4)))
    struct.pack_into("<2f", raw, 112, 2.0, 10.0)
    assert nifti.decode(bytes(raw))[0].ravel().tolist() == [12.0, 14.0]
    with pytest.raises(ValueError):
        nifti.decode(b"no volume")


def test_canonical_keeps_every_voxel_in_its_place():
    affine = np.array([[0, -2.0, 0, 5], [1.5, 0, 0, -3], [0, 0, -3, 1], [0, 0, 0, 1]])
    voxels = np.random.default_rng(0).random((2, 3, 4))
    out, moved = nifti.canonical(voxels, affine)
    assert (np.diag(moved)[:3] > 0).all()
    place = {tuple(np.round((affine @ [*i, 1])[:3], 6)): v for i, v in np.ndenumerate(voxels)}
    assert place == {tuple(np.round((moved @ [*i, 1])[:3], 6)): v for i, v in np.ndenumerate(out)}


def test_read_volumes(spark, tmp_path):
    voxels = np.arange(24, dtype="f4").reshape(2, 3, 4)
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "one.nii.gz").write_bytes(nifti.encode(voxels, np.eye(4), True))
    (tmp_path / "bad.nii").write_bytes(b"x")
    rows = {r["path"].rsplit("/", 1)[1]: r for r in nifti.read_volumes(spark, f"file://{tmp_path}", to_canonical=True).collect()}
    assert rows["one.nii.gz"]["voxels"] == voxels.ravel().tolist() and rows["one.nii.gz"]["shape"] == [2, 3, 4] and rows["bad.nii"]["voxels"] is None
    back = {r["path"]: r["content"] for r in nifti.with_bytes(nifti.read_volumes(spark, f"file://{tmp_path}")).collect()}
    assert sum(x is None for x in back.values()) == 1
    assert (nifti.decode(bytes(next(x for x in back.values() if x)))[0] == voxels).all()


def element(tag, kind, value, explicit=True):
    value = value if isinstance(value, bytes) else value.encode()
    value += b" " * (len(value) % 2)
    head = struct.pack("<HH", tag >> 16, tag & 0xFFFF)
    if not explicit:
        return head + struct.pack("<I", len(value)) + value
    return head + kind + (struct.pack("<HI", 0, len(value)) if kind in dicom._LONG else struct.pack("<H", len(value))) + value


def dicom_file(tags, syntax="1.2.840.10008.1.2.1"):
    names = {v: k for k, v in dicom.TAGS.items()}
    explicit = syntax != dicom.IMPLICIT
    nested = struct.pack("<HH", 0x0008, 0x1140) + (b"SQ\0\0" if explicit else b"") + struct.pack("<I", 0xFFFFFFFF)
    nested += struct.pack("<HHI", 0xFFFE, 0xE000, 0xFFFFFFFF) + element(0x00080022, b"DA", "19000101", explicit) + struct.pack("<HHI", 0xFFFE, 0xE00D, 0) + struct.pack("<HHI", 0xFFFE, 0xE0DD, 0)
    body = [element(0x00020010, b"UI", syntax), nested]
    for name, value in sorted(tags.items(), key=lambda x: names[x[0]]):
        number = name in ("Rows", "Columns")
        body.append(element(names[name], b"US" if number else b"LO", struct.pack("<H", value) if number else value, explicit))
    return b"\0" * 128 + b"DICM" + b"".join(body) + element(dicom.PIXELS, b"OW", b"\1\2" * 50, explicit)


@pytest.mark.parametrize("syntax", ["1.2.840.10008.1.2.1", dicom.IMPLICIT])
def test_dicom_header(syntax):
    tags = {"SeriesDescription": "AX T1", "Rows": 256, "Columns": 320, "PixelSpacing": "0.5\\0.6", "AcquisitionDate": "20200131"}
    assert dicom.header(dicom_file(tags, syntax)) == {k: str(v) for k, v in tags.items()}
    for bad in (b"", b"\0" * 200, dicom_file(tags)[:140]):
        try:
            dicom.header(bad)
        except (ValueError, struct.error):
            pass


def test_series_table(spark, tmp_path):
    common = {"AcquisitionDate": "20200131", "SeriesInstanceUID": "1.2.3", "Rows": 256, "Columns": 320, "PixelSpacing": "0.5\\0.6", "SliceThickness": "3"}
    series = {
        "s1": {"SeriesDescription": "AX T1", "SeriesNumber": "1", "AcquisitionTime": "100000"}, "s2": {"SeriesDescription": "DSC perfusion", "SeriesNumber": "2", "AcquisitionTime": "101000"},
        "s3": {"SeriesDescription": "AX T1", "SeriesNumber": "3", "AcquisitionTime": "102000"}, "s4": {"SeriesDescription": "ep", "DiffusionBValue": "1000", "SeriesNumber": "4"},
    }
    for name, tags in series.items():
        (tmp_path / "exam" / name).mkdir(parents=True)
        (tmp_path / "exam" / name / "a.dcm").write_bytes(b"broken")
        for k in range(2):
            (tmp_path / "exam" / name / f"b{k}.DCM").write_bytes(dicom_file(common | tags))
    got = {r["series"].rsplit("/", 1)[1]: r for r in dicom.series_table(dicom.read_headers(spark, f"file://{tmp_path}")).collect()}
    assert {k: r["final_label"] for k, r in got.items()} == {"s1": "T1n", "s2": "Perfusion", "s3": "T1c", "s4": "DWI"}
    assert (got["s1"]["n_files"], got["s1"]["matrix"], got["s1"]["voxel_mm"], got["s1"]["plane"]) == (3, "320x256", "0.50x0.60x3.00", "AX")
    assert got["s1"]["dirname"].startswith("1_AX_T1_")


def test_table_files(spark, tmp_path):
    df = spark.createDataFrame([(1, "a,b"), (2, None)], "id int, t string")
    for ext in ("csv", "tsv", "txt"):
        path = f"file://{tmp_path}/x.{ext}"
        catalog.write_table(df, path)
        catalog.write_table(df, path, append=True)
        assert sorted(map(str, catalog.read_table(spark, path, "id int, t string").collect())) == sorted(map(str, df.collect() * 2))
    with pytest.raises(ValueError):
        catalog.separator("x.xlsx")


def test_ini_and_path_lists(spark, tmp_path):
    (tmp_path / "c.ini").write_text("; note\n[DEFAULT]\nA = 1\nb=x = y\n\n[other]\nc: 3\n")
    got = {(r["section"], r["key"]): r["value"] for r in catalog.read_ini(spark, f"file://{tmp_path}/c.ini").collect()}
    assert got == {("DEFAULT", "a"): "1", ("DEFAULT", "b"): "x = y", ("other", "c"): "3"}
    (tmp_path / "p.txt").write_text(" /a/b \n\n/c\n")
    assert [r["path"] for r in catalog.read_paths(spark, f"file://{tmp_path}/p.txt").collect()] == ["/a/b", "", "/c"]


def test_ini_files_keep_their_own_sections(spark, tmp_path):
    (tmp_path / "a.ini").write_text("x0=0\n[A]\nx=1\ny=2\n")
    (tmp_path / "b.ini").write_text("[B]\nx=3\n[C]\ny=4\n")
    got = {(r["path"].rsplit("/", 1)[1], r["section"], r["key"], r["value"]) for r in catalog.read_ini(spark, f"file://{tmp_path}/*.ini").collect()}
    assert got == {("a.ini", None, "x0", "0"), ("a.ini", "A", "x", "1"), ("a.ini", "A", "y", "2"), ("b.ini", "B", "x", "3"), ("b.ini", "C", "y", "4")}


def test_places_over_many_ranges_and_equal_draws(spark, monkeypatch):
    monkeypatch.setattr(catalog, "RANGE_ROWS", 50)
    rows = spark.range(1000).repartition(7)
    assert [(r["id"], r["rank"]) for r in catalog.ranked(rows, "id").orderBy("id").collect()] == [(i, i) for i in range(1000)]
    monkeypatch.setattr(catalog, "_drawn", lambda key, seed: F.md5((F.col(key) % 3).cast("string")))
    once, twice = ([(r["id"], r["place"]) for r in catalog.shuffled(rows.repartition(n), "id", 5).orderBy("place").collect()] for n in (3, 8))
    assert once == twice and [p for _, p in once] == list(range(1000))


def test_null_masks_stay_null(spark):
    from voxloom.operators import volumes

    ring = [[1, 1, 1], [1, 0, 1], [1, 1, 1]]
    solid = np.array([np.ones((3, 3)), ring, np.ones((3, 3))]).astype(int).ravel().tolist()
    df = spark.createDataFrame([(1, solid), (2, None), (3, [0] * 27)], "id int, m array<int>")
    got = {r["id"]: r["m"] for r in volumes.fill_holes(df, "m", (3, 3, 3)).collect()}
    assert got == {1: [1] * 27, 2: None, 3: [0] * 27}


def test_nearest_in_time_over_a_long_key(spark):
    import random

    rng = random.Random(1)
    times = rng.sample(range(100_000), 3000)
    rows = [(i, t, rng.random() < 0.5, float(i)) for i, t in enumerate(times)]
    df = spark.createDataFrame(rows, "i long, s long, d boolean, v double").selectExpr("1 AS k", "i", "timestamp_seconds(s) AS t", "d", "v")
    got = {r["i"]: r["near"] for r in series.nearest(df, ["k"], "t", "i", F.col("d"), "v", "near").collect()}
    plain = sorted((t, i) for i, t, d, _ in rows if not d)
    for i, t, d, _ in rows:
        if d:
            assert got[i] == float(min((abs(t - s), j) for s, j in plain)[1])


def test_class_maps_are_never_evaluated():
    assert headers.parse_class_map("{(1, 2): 1, (3,): 'all'}") == {(1, 2): 1, (3,): "all"}
    assert headers.parse_class_map(" None ") == headers.parse_class_map(None) == {}
    for bad in ("{1: 2}", "__import__('os')", "[1]"):
        with pytest.raises(ValueError):
            headers.parse_class_map(bad)


def test_zip_refuses_lists_of_unequal_length(spark):
    with pytest.raises(ValueError):
        catalog.zipped(spark.range(3), "id", spark.range(4).withColumnRenamed("id", "k"), "k")


def test_demix_greedy_takes_what_a_sequential_choice_takes(spark):
    from voxloom.plans.metadata_queries import _counts
    from voxloom.plans.volume_queries import QUERIES

    sf, want = "/root/testdata/sf0.001", set()
    rows = sorted(((r["l_orderkey"], -r["n"], r["l_linenumber"], r["l_returnflag"]) for r in _counts(spark, sf).collect()))
    taken = set()
    for parent, n, leaf, key in rows:
        if (parent, "leaf", leaf) not in taken and (parent, "key", key) not in taken:
            taken |= {(parent, "leaf", leaf), (parent, "key", key)}
            want.add((parent, leaf, key, -n))
    assert {tuple(r) for r in QUERIES["demix_greedy"](spark, sf).collect()} == want
