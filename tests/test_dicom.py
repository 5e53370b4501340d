"""DICOM files with nested groups, series assembled into volumes, and the whole series table."""

import random
import struct

import numpy as np
import pytest
from test_sources import dicom_file, element

from voxloom.sources import dicom, nifti

NUMBERS = {v: k for k, v in dicom.TAGS.items()}
SEQUENCES = {v: k for k, v in dicom.GROUPS.items()}


def sequence(tag, items, explicit=True, open_end=False):
    body = b""
    for item in items:
        body += struct.pack("<HHI", 0xFFFE, 0xE000, 0xFFFFFFFF if open_end else len(item)) + item
        body += struct.pack("<HHI", 0xFFFE, 0xE00D, 0) if open_end else b""
    head = struct.pack("<HH", tag >> 16, tag & 0xFFFF) + (b"SQ\0\0" if explicit else b"")
    return head + struct.pack("<I", 0xFFFFFFFF if open_end else len(body)) + body + (struct.pack("<HHI", 0xFFFE, 0xE0DD, 0) if open_end else b"")


def text(name, value, explicit=True):
    return element(NUMBERS[name], b"LO", value, explicit)


def nested_file(tags, shared, frames, explicit=True, open_end=False, pixels=b"", preamble=True):
    def group(item):
        return b"".join(sequence(SEQUENCES[g], [b"".join(text(n, v, explicit) for n, v in own.items())], explicit, open_end) for g, own in item.items())

    numbers = {"Rows", "Columns", "BitsAllocated", "PixelRepresentation", "SamplesPerPixel"}
    body = b"".join(element(NUMBERS[n], b"US", struct.pack("<H", v), explicit) if n in numbers else text(n, v, explicit) for n, v in sorted(tags.items(), key=lambda x: NUMBERS[x[0]]))
    body += sequence(dicom.SHARED, [group(shared)], explicit, open_end) + sequence(dicom.PER_FRAME, [group(f) for f in frames], explicit, open_end)
    body += element(dicom.PIXELS, b"OW", pixels, explicit)
    meta = element(dicom.TRANSFER_SYNTAX, b"UI", dicom.EXPLICIT if explicit else dicom.IMPLICIT)
    return (b"\0" * 128 + b"DICM" + meta if preamble else b"") + body


@pytest.mark.parametrize("explicit", [True, False])
@pytest.mark.parametrize("open_end", [True, False])
@pytest.mark.parametrize("preamble", [True, False])
def test_nested_groups_are_read(explicit, open_end, preamble):
    shared = {"PixelMeasures": {"PixelSpacing": "0.5\\0.7"}, "MRImageFrameType": {"FrameType": "derived\\mip"}}
    frames = [{"PlanePosition": {"ImagePositionPatient": f"0\\0\\{k}"}, "PixelMeasures": {"SliceThickness": str(k)}} for k in range(3)]
    h = dicom.parse(nested_file({"SeriesDescription": "AX T1", "NumberOfFrames": "3"}, shared, frames, explicit, open_end, preamble=preamble))
    assert h.tags == {"SeriesDescription": "AX T1", "NumberOfFrames": "3"}
    assert h.shared == {"PixelSpacing": "0.5\\0.7", "FrameType": "derived\\mip"}
    assert h.frames == [{"ImagePositionPatient": f"0\\0\\{k}", "SliceThickness": str(k)} for k in range(3)]


def test_broken_files_raise():
    whole = nested_file({"SeriesDescription": "AX"}, {"PixelMeasures": {"PixelSpacing": "1\\2"}}, [], open_end=True)
    for bad in (b"", b"broken", b"\0" * 400, whole[:-40], b"x" * 500):
        with pytest.raises((ValueError, struct.error)):
            dicom.parse(bad)


def planes(n, rows=3, cols=4):
    return np.random.default_rng(n).integers(-300, 300, (n, rows, cols)).astype(np.int16)


def series_files(pixels, turn, gap, uid="1.2.3", **more):
    turn, start = np.array(turn, float), np.array([10.0, -20.0, 30.0])
    normal = np.cross(turn[:3], turn[3:])
    join = lambda x: "\\".join(repr(float(v)) for v in x)
    tags = {"SeriesInstanceUID": uid, "ImageOrientationPatient": join(turn), "PixelSpacing": "0.5\\0.75", "SliceThickness": "4"} | more
    out = [(f"/e/s/{i}.dcm", dicom.encode(tags | {"ImagePositionPatient": join(start + normal * gap * k)}, p)) for i, (k, p) in enumerate(zip(range(len(pixels)), pixels, strict=True))]
    random.Random(len(pixels)).shuffle(out)
    return out


def volumes(spark, files, to_canonical=False):
    df = spark.createDataFrame(files, "path string, content binary").repartition(4)
    return dicom.series_volumes(dicom.slices_of(df), to_canonical).collect()


OBLIQUE = [0.8, 0.6, 0.0, 0.0, 0.0, -1.0]


@pytest.mark.parametrize("turn", [[1, 0, 0, 0, 1, 0], [0, 1, 0, 0, 0, -1], OBLIQUE])
@pytest.mark.parametrize("n", [1, 2, 7])
def test_shuffled_slices_give_the_voxels_and_the_affine(spark, turn, n):
    pixels = planes(n)
    (r,) = volumes(spark, series_files(pixels, turn, 2.5))
    assert r["error"] is None and r["shape"] == [4, 3, n] and r["dtype"] == "int16"
    assert (np.array(r["voxels"]).reshape(4, 3, n) == pixels.transpose(2, 1, 0)).all()
    affine, turn = np.array(r["affine"]).reshape(4, 4), np.array(turn, float)
    for c, row, k in [(0, 0, 0), (3, 2, n - 1), (1, 2, n // 2)]:
        here = np.array([10.0, -20.0, 30.0]) + turn[:3] * 0.75 * c + turn[3:] * 0.5 * row + np.cross(turn[:3], turn[3:]) * 2.5 * k
        assert np.allclose((affine @ [c, row, k, 1])[:3], here * [-1, -1, 1])


def test_volumes_survive_reorientation_and_a_file(spark):
    pixels = planes(5)
    files = series_files(pixels, [1, 0, 0, 0, 1, 0], 2.5, RescaleSlope="2", RescaleIntercept="-7")
    (plain,), (turned,) = volumes(spark, files), volumes(spark, files, True)
    assert (np.diag(np.array(turned["affine"]).reshape(4, 4)) > 0).all() and plain["dtype"] == "float64"
    place = lambda r: {tuple(np.round(np.array(r["affine"]).reshape(4, 4) @ [*i, 1], 6)): v for i, v in np.ndenumerate(np.array(r["voxels"]).reshape(r["shape"]))}
    assert place(plain) == place(turned) and sorted(turned["voxels"]) == sorted((pixels * 2.0 - 7).ravel().tolist())
    raw = nifti.encode(np.array(turned["voxels"], "f4").reshape(turned["shape"]), np.array(turned["affine"]).reshape(4, 4))
    assert (nifti.decode(raw)[0].ravel() == np.array(turned["voxels"])).all()


def test_frames_of_one_file_make_a_volume(spark):
    pixels = planes(4)
    order = [2, 0, 3, 1]
    frames = [{"PlanePosition": {"ImagePositionPatient": f"0\\0\\{3 * k}"}} for k in order]
    shared = {"PlaneOrientation": {"ImageOrientationPatient": "1\\0\\0\\0\\1\\0"}, "PixelMeasures": {"PixelSpacing": "1\\2"}}
    tags = {"SeriesInstanceUID": "9", "Rows": 3, "Columns": 4, "NumberOfFrames": "4", "BitsAllocated": 16, "PixelRepresentation": 1}
    (r,) = volumes(spark, [("/e/s/a.dcm", nested_file(tags, shared, frames, pixels=pixels[order].tobytes()))])
    assert r["error"] is None and (np.array(r["voxels"]).reshape(r["shape"]) == pixels.transpose(2, 1, 0)).all()
    assert [abs(x) for x in r["zooms"]] == [2.0, 1.0, 3.0]


def test_series_that_make_no_volume_say_why(spark):
    turn, good = [1, 0, 0, 0, 1, 0], planes(4)
    cases = {
        "two slices": series_files(good, turn, 2.0, "1") + [("/e/s/x.dcm", series_files(good, turn, 2.0, "1")[0][1])], "uneven": [f for f in series_files(planes(6), turn, 2.0, "2") if f[0] != "/e/s/2.dcm"],
        "no pixels": [("/e/s/y.dcm", dicom_file({"SeriesInstanceUID": "3"})[:-112])], "without position": [("/e/s/z.dcm", dicom.encode({"SeriesInstanceUID": "4"}, good[0]))],
        "unlike n_rows": series_files(good, turn, 2.0, "5")[:3] + [("/e/s/w.dcm", series_files(planes(4, 5), turn, 2.0, "5")[0][1])],
    }
    for why, files in cases.items():
        (r,) = volumes(spark, files)
        assert r["voxels"] is None and why in r["error"], (why, r["error"])
    assert volumes(spark, []) == []


def test_series_table_in_full(spark, tmp_path):
    day = {"AcquisitionDate": "20200131", "SeriesInstanceUID": "1", "Rows": 256, "Columns": 320}
    at = lambda name, hour, **more: day | {"SeriesDescription": name, "AcquisitionTime": hour} | more
    turn = {"ImageOrientationPatient": "0\\1\\0\\0\\0\\-1"}
    series = {
        "s1": [nested_file(at("T1 brain", "100000", SeriesNumber="7", NumberOfFrames="30"), {"PixelMeasures": {"PixelSpacing": "0.5\\0.6", "SliceThickness": "2"}, "PlaneOrientation": turn}, [])],
        "s2": [nested_file(at("AX T1", "100500", SeriesNumber="3", ImageType="DERIVED\\MPR"), {}, [{"PixelMeasures": {"SpacingBetweenSlices": str(x)}} for x in (5, 1, 2)])],
        "s3": [nested_file(at("AX T1", "101000", PixelSpacing="0.9\\0.8"), {}, [{"MRImageFrameType": {"FrameType": "original\\phase"}}])],
        "s4": [nested_file(at("AX flair", "1", SeriesNumber="3", ImageOrientationPatient="1\\0\\0\\0\\1\\0", ImagePositionPatient=f"0\\0\\{z}", **({"ImagerPixelSpacing": f"{z}\\{z}"} if z > 2 else {})), {}, []) for z in (0, 2.5, 5.0, 7.5)],
    }
    for name, files in series.items():
        (tmp_path / "exam" / name).mkdir(parents=True)
        for k, raw in enumerate(files):
            (tmp_path / "exam" / name / f"{k}.dcm").write_bytes(raw)
    rows = dicom.series_table(dicom.read_headers(spark, f"file://{tmp_path}")).collect()
    assert [r["series"].rsplit("/", 1)[1] for r in rows] == ["s4", "s2", "s1", "s3"]
    got = {r["series"].rsplit("/", 1)[1]: r for r in rows}
    assert {k: (r["plane"], r["n_slices"], r["z_spacing_mm"]) for k, r in got.items()} == {"s1": ("SAG", 30, 2.0), "s2": ("AX", 1, 2.0), "s3": ("AX", 1, None), "s4": ("AX", 4, 2.5)}
    spacing = {k: (r["pixdim_row_mm"], r["pixdim_col_mm"]) for k, r in got.items()}
    assert spacing == {"s1": (0.5, 0.6), "s2": (0.5, 0.6), "s3": (0.9, 0.8), "s4": (5.0, 5.0)}
    assert got["s2"]["is_derived"] and got["s2"]["voxel_mm"] is None and got["s1"]["voxel_mm"] == "0.50x0.60x2.00"
    assert got["s3"]["image_types"] == ["ORIGINAL", "PHASE"] and got["s2"]["image_type"] == ["DERIVED", "MPR"] and got["s1"]["acq_dt_iso"] == "2020-01-31T10:00:00"
