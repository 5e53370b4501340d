"""DICOM files: headers with their nested groups, one row a series with what the classification reads, and series as volumes."""

from __future__ import annotations

import struct
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxloom.functions import headers as H
from voxloom.operators import series as S
from voxloom.operators import volumes as V
from voxloom.sources import nifti

# Fixed values of the public DICOM dictionary: tags that are read, as group and element.
TAGS = {
    0x00080008: "ImageType", 0x00080020: "StudyDate", 0x00080021: "SeriesDate", 0x00080022: "AcquisitionDate", 0x00080023: "ContentDate", 0x00080030: "StudyTime", 0x00080031: "SeriesTime",
    0x00080032: "AcquisitionTime", 0x00080033: "ContentTime", 0x00080060: "Modality", 0x00080070: "Manufacturer", 0x0008103E: "SeriesDescription", 0x00089007: "FrameType", 0x00089209: "AcquisitionContrast",
    0x00100010: "PatientName", 0x00100020: "PatientID", 0x00180010: "ContrastBolusAgent", 0x00180020: "ScanningSequence", 0x00180021: "SequenceVariant", 0x00180022: "ScanOptions", 0x00180023: "MRAcquisitionType",
    0x00180024: "SequenceName", 0x00180050: "SliceThickness", 0x00180080: "RepetitionTime", 0x00180081: "EchoTime", 0x00180082: "InversionTime", 0x00180088: "SpacingBetweenSlices", 0x00181030: "ProtocolName",
    0x00181041: "ContrastBolusVolume", 0x00181164: "ImagerPixelSpacing", 0x00181314: "FlipAngle", 0x00189005: "PulseSequenceName", 0x00189087: "DiffusionBValue", 0x0020000D: "StudyInstanceUID",
    0x0020000E: "SeriesInstanceUID", 0x00200011: "SeriesNumber", 0x00200013: "InstanceNumber", 0x00200032: "ImagePositionPatient", 0x00200037: "ImageOrientationPatient", 0x00201002: "ImagesInAcquisition",
    0x00280002: "SamplesPerPixel", 0x00280008: "NumberOfFrames", 0x00280010: "Rows", 0x00280011: "Columns", 0x00280030: "PixelSpacing", 0x00280100: "BitsAllocated", 0x00280103: "PixelRepresentation",
    0x00281052: "RescaleIntercept", 0x00281053: "RescaleSlope",
}
# Sequences whose items are read; those after the first two stand in the items of these.
SHARED, PER_FRAME = 0x52009229, 0x52009230
GROUPS = {
    SHARED: "SharedFunctionalGroups", PER_FRAME: "PerFrameFunctionalGroups", 0x00289110: "PixelMeasures", 0x00189226: "MRImageFrameType", 0x00209113: "PlanePosition", 0x00209116: "PlaneOrientation",
    0x00289145: "PixelValueTransformation",
}
PIXELS, ITEM, ITEM_END, SEQUENCE_END, TRANSFER_SYNTAX = 0x7FE00010, 0xFFFEE000, 0xFFFEE00D, 0xFFFEE0DD, 0x00020010
IMPLICIT, EXPLICIT, BIG_ENDIAN = "1.2.840.10008.1.2", "1.2.840.10008.1.2.1", "1.2.840.10008.1.2.2"
_LONG = {b"OB", b"OW", b"OF", b"OD", b"OL", b"SQ", b"UC", b"UN", b"UR", b"UT", b"SV", b"UV", b"OV"}
_NUMBERS = {b"US": "H", b"SS": "h", b"UL": "I", b"SL": "i", b"FL": "f", b"FD": "d"}
#: Tags that hold numbers, for files that do not say so.
_IMPLIED = {0x00280002: "H", 0x00280010: "H", 0x00280011: "H", 0x00280100: "H", 0x00280103: "H", 0x00189087: "d"}
_OPEN = 0xFFFFFFFF


class Header(NamedTuple):
    """Known tags as text, those of the groups shared by all frames, those of each frame, the pixels' bytes, and the transfer syntax."""

    tags: dict[str, str]
    shared: dict[str, str]
    frames: list[dict[str, str]]
    pixels: memoryview | None
    syntax: str


def _element(raw: bytes, at: int, explicit: bool) -> tuple[int, bytes, int, int]:
    """(tag, representation, place of the value, its length)."""
    group, number = struct.unpack_from("<HH", raw, at)
    tag, kind = group << 16 | number, raw[at + 4 : at + 6]
    if tag >> 16 == 0xFFFE or not (explicit or group == 2):
        return tag, b"", at + 8, struct.unpack_from("<I", raw, at + 4)[0]
    if kind in _LONG:
        return tag, kind, at + 12, struct.unpack_from("<I", raw, at + 8)[0]
    return tag, kind, at + 8, struct.unpack_from("<H", raw, at + 6)[0]


def _text(tag: int, kind: bytes, held: bytes) -> str:
    code = _NUMBERS.get(kind, None if kind else _IMPLIED.get(tag))
    if code:
        return "\\".join(str(x) for x in struct.unpack(f"<{len(held) // struct.calcsize(code)}{code}", held))
    return held.rstrip(b"\0 ").decode("latin-1")


def _elements(raw: bytes, at: int, stop: int, explicit: bool, out: dict) -> int:
    """Read elements into `out` (tag: text, or a list of such for a sequence) until `stop`, an item's end or the pixels; the place after."""
    while at + 8 <= stop:
        tag, kind, value, size = _element(raw, at, explicit)
        if tag == ITEM_END:
            return value
        if tag == PIXELS:
            out[PIXELS] = (value, size)
            return stop
        if size == _OPEN or tag in GROUPS:
            items, at = _items(raw, value, size, explicit and kind != b"UN")
            if tag in GROUPS:
                out[tag] = items
            continue
        if value + size > stop:
            raise ValueError("an element beyond the end of its file or item")
        if tag in TAGS or tag == TRANSFER_SYNTAX:
            out[tag] = _text(tag, kind, raw[value : value + size])
        at = value + size
        if tag >> 16 == 2 and at + 2 <= stop and struct.unpack_from("<H", raw, at)[0] != 2:
            return at
    return at


def _items(raw: bytes, at: int, size: int, explicit: bool) -> tuple[list[dict], int]:
    """The items of a sequence of known or open length, and the place after it."""
    stop, items = len(raw) if size == _OPEN else at + size, []
    while at + 8 <= stop:
        tag, _, value, n = _element(raw, at, explicit)
        if tag == SEQUENCE_END:
            return items, value
        if tag != ITEM:
            raise ValueError("a sequence holds something that is no item")
        items.append({})
        after = _elements(raw, value, stop if n == _OPEN else value + n, explicit, items[-1])
        at = after if n == _OPEN else value + n
    if size == _OPEN:
        raise ValueError("a sequence without its end")
    return items, stop


def _flat(item: dict) -> dict[str, str]:
    """Tags of a functional group and of the first item of each sequence in it."""
    out = {TAGS[t]: v for t, v in item.items() if t in TAGS}
    for tag, items in item.items():
        if tag in GROUPS and items:
            out |= {TAGS[t]: v for t, v in items[0].items() if t in TAGS}
    return out


def parse(raw: bytes) -> Header:
    """The header of a file, with or without its preamble; ValueError where it holds no known element."""
    at = 132 if raw[128:132] == b"DICM" else 0
    meta: dict = {}
    if raw[at : at + 2] == b"\2\0":
        at = _elements(raw, at, len(raw), True, meta)
    syntax = meta.get(TRANSFER_SYNTAX) or (EXPLICIT if raw[at + 4 : at + 6].isalpha() and raw[at + 4 : at + 6].isupper() else IMPLICIT)
    if syntax == BIG_ENDIAN:
        raise ValueError("big-endian files are not read")
    found: dict = {}
    _elements(raw, at, len(raw), syntax != IMPLICIT, found)
    tags = {TAGS[t]: v for t, v in found.items() if t in TAGS}
    if not tags:
        raise ValueError("not a DICOM file")
    pixels = None
    if PIXELS in found:
        value, size = found[PIXELS]
        pixels = memoryview(raw)[value : len(raw) if size == _OPEN else value + size]
    shared = found.get(SHARED) or [{}]
    return Header(tags, _flat(shared[0]), [_flat(x) for x in found.get(PER_FRAME, [])], pixels, syntax)


def header(raw: bytes) -> dict[str, str]:
    """The known tags of a file outside its sequences."""
    return parse(raw).tags


HEADERS = "path string, tags map<string,string>, shared map<string,string>, frames array<map<string,string>>"


def read_headers(spark: SparkSession, path: str, pattern: str = "*.[dD][cC][mM]") -> DataFrame:
    """path, tags, shared and frames (maps of text) of every file below `path`; null where a file cannot be read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(path)
    return headers_of(files)


def headers_of(files: DataFrame) -> DataFrame:
    """The same of a table of path and content."""
    text = pa.map_(pa.string(), pa.string())

    def parsed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: list = []
            for raw in batch["content"]:
                try:
                    h = parse(raw.as_py() or b"")
                    found.append((list(h.tags.items()), list(h.shared.items()), [list(x.items()) for x in h.frames]))
                except (ValueError, struct.error):
                    found.append((None, None, None))
            columns = [pa.array([x[k] for x in found], kind) for k, kind in enumerate((text, text, pa.list_(text)))]
            yield pa.record_batch([batch["path"], *columns], names=["path", "tags", "shared", "frames"])

    return files.select("path", "content").mapInArrow(parsed, HEADERS)


#: Files of a series whose spacings are looked at where the first one has none.
SPACING_FILES = 50


def series_table(files: DataFrame) -> DataFrame:
    """A row for each folder with a readable file: the header of its least readable one, counts, spacings, fields and labels
    of the classification, in order of exam, series number and time. The folder above is the exam.

    In-plane spacing comes from the file, its groups, the detector or the median of other files; the distance of slices
    from the header or from the positions of all files; the plane from the name or else the orientation. A derived series
    without in-plane spacing takes that of the series nearest in time of its exam and base type that is not derived.
    """
    parts = files.select(F.regexp_extract("path", "^(.*)/[^/]*$", 1).alias("series"), F.substring_index("path", "/", -1).alias("name"), "tags", "shared", "frames")
    first = F.min_by(F.struct("tags", "shared", "frames"), F.when(F.col("tags").isNotNull(), F.col("name")))
    own = H.file_spacing(F.col("tags"), F.col("shared"), F.col("frames"))
    near = F.slice(F.transform(F.sort_array(F.collect_list(F.when(F.get(own, 0).isNotNull(), F.struct("name", own.alias("s"))))), lambda x: x["s"]), 1, SPACING_FILES)
    one = parts.groupBy("series").agg(F.count("*").alias("n_files"), first.alias("h"), near.alias("near")).where("h.tags is not null").select("series", "n_files", "near", "h.*")
    numbers = lambda c, n: F.transform(F.split(c, r"\\"), H.safe_float)
    placed = parts.select("series", numbers(F.try_element_at("tags", F.lit("ImageOrientationPatient")), 6).alias("iop"), numbers(F.try_element_at("tags", F.lit("ImagePositionPatient")), 3).alias("ipp"))
    gaps = S.z_spacing(placed.where((F.size("iop") == 6) & (F.size("ipp") == 3)), "series", F.col("iop"), F.col("ipp")).withColumnRenamed("z_spacing", "gap")
    get = lambda t: F.try_element_at("tags", F.lit(t))
    hints = H.vendor_hints(F.col("tags"))
    of_files = lambda k: H.median_of(F.transform("near", lambda s: F.get(s, k)), SPACING_FILES)
    spacing = [F.coalesce(F.get(H.file_spacing(F.col("tags"), F.col("shared"), F.col("frames")), k), of_files(k)) for k in (0, 1)]
    slices = H.slice_metrics(F.col("tags"), F.col("shared"), F.col("frames"))
    kinds = H.upper_list(get("ImageType"))
    when = H.parse_dt(*[(get(f"{k}Date"), get(f"{k}Time")) for k in ("Acquisition", "Content", "Series", "Study")])
    name = S.name_tokens(get("SeriesDescription"), get("ProtocolName"), get("SequenceName"))
    orientation = numbers(F.coalesce(get("ImageOrientationPatient"), F.try_element_at("shared", F.lit("ImageOrientationPatient"))), 6)
    rows = one.join(gaps, "series", "left").select(
        F.regexp_extract("series", "^(.*)/[^/]*$", 1).alias("exam"), "series", "n_files", H.safe_int(get("SeriesNumber")).alias("series_number"), get("SeriesDescription").alias("description"),
        name.alias("tokens"), *[H.safe_float(get(t)).alias(c) for t, c in (("EchoTime", "te"), ("RepetitionTime", "tr"), ("InversionTime", "ti"), ("FlipAngle", "flip_angle"))],
        when.cast("timestamp").alias("acq_dt"), H.iso_time(when).alias("acq_dt_iso"), get("Modality").alias("modality"),
        kinds.alias("image_type"), H.image_flags(F.col("tags"), F.col("shared"), F.col("frames")).alias("image_types"), H.primary_secondary(kinds).alias("primary_secondary"),
        H.safe_int(get("Rows")).alias("rows_px"), H.safe_int(get("Columns")).alias("cols_px"), H.matrix(H.safe_int(get("Columns")), H.safe_int(get("Rows"))).alias("matrix"),
        get("SequenceName").alias("sequence_name"), get("ProtocolName").alias("protocol_name"), spacing[0].alias("pixdim_row_mm"), spacing[1].alias("pixdim_col_mm"),
        slices["thickness"].alias("slice_thickness_mm"), slices["between"].alias("spacing_between_slices_mm"), F.coalesce(H.first_nonzero(slices["between"], slices["thickness"]), F.col("gap")).alias("z_spacing_mm"),
        slices["frames"].alias("num_frames"), H.safe_int(get("ImagesInAcquisition")).alias("images_in_acq"), H.first_nonzero(slices["frames"], H.safe_int(get("ImagesInAcquisition")), F.col("n_files")).alias("n_slices"),
        *[hints[n].alias(n) for n in hints], F.coalesce(S.first_rule(name, S.PLANE_RULES), V.plane_of_orientation(F.when(F.size(orientation) == 6, orientation))).alias("plane"),
        H.series_dirname(H.safe_int(get("SeriesNumber")), get("SeriesDescription"), get("SeriesInstanceUID")).alias("dirname"),
    )
    known = S.classify(rows).withColumn("voxel_mm", H.voxel_mm(F.col("pixdim_row_mm"), F.col("pixdim_col_mm"), F.col("z_spacing_mm")))
    return inherit_spacing(known).orderBy("exam", F.asc_nulls_last("series_number"), F.asc_nulls_last("acq_dt"), "series")


def inherit_spacing(series: DataFrame) -> DataFrame:
    """Derived series without in-plane spacing take what they lack from the nearest in time of their exam and base type that is not derived."""
    lacking = F.col("is_derived") & (F.col("pixdim_row_mm").isNull() | F.col("pixdim_col_mm").isNull())
    narrow = series.where(F.col("acq_dt").isNotNull() & (lacking | ~F.col("is_derived"))).select("exam", "base_type", "series", "acq_dt", "is_derived", F.struct("pixdim_row_mm", "pixdim_col_mm").alias("own"))
    found = S.nearest(narrow, ["exam", "base_type"], "acq_dt", "series", F.col("is_derived"), "own", "parent")
    usable = (F.col("parent.pixdim_row_mm") != 0) & (F.col("parent.pixdim_col_mm") != 0)
    joined = series.join(found.where(usable).select("exam", "series", "parent"), ["exam", "series"], "left")
    filled = [F.when(lacking, F.coalesce(c, F.col(f"parent.{c}"))).otherwise(F.col(c)).alias(c) if c.startswith("pixdim") else F.col(c) for c in series.columns]
    return joined.select(*filled)


#: One frame of one file: its series, place and pixels (little-endian, row by row); `error` says why a file gives none.
SLICES = "path string, series string, frame int, n_rows int, n_cols int, position array<double>, orientation array<double>, spacing array<double>, thickness double, slope double, intercept double, kind string, pixels binary, error string"


def _frames(path: str, raw: bytes) -> Iterator[tuple]:
    h = parse(raw)
    if h.pixels is None:
        raise ValueError("no pixels")
    if h.syntax not in (IMPLICIT, EXPLICIT):
        raise ValueError(f"compressed pixels ({h.syntax})")
    rows, cols, bits, count = int(h.tags["Rows"]), int(h.tags["Columns"]), int(h.tags.get("BitsAllocated", 16)), int(h.tags.get("NumberOfFrames", 1))
    if int(h.tags.get("SamplesPerPixel", 1)) != 1 or bits not in (8, 16, 32):
        raise ValueError("pixels are not single numbers of 8, 16 or 32 bits")
    kind, size = ("i" if h.tags.get("PixelRepresentation") == "1" else "u") + str(bits // 8), rows * cols * bits // 8
    if len(h.pixels) < size * count:
        raise ValueError("fewer pixels than rows, columns and frames")
    series = h.tags.get("SeriesInstanceUID") or path.rsplit("/", 1)[0]
    for k in range(count):
        tags = h.tags | h.shared | (h.frames[k] if k < len(h.frames) else {})
        numbers = lambda name, n, tags=tags: x if (text := tags.get(name)) and len(x := [float(v) for v in text.split("\\")]) == n else None
        one = lambda name, other, tags=tags: float(tags[name]) if tags.get(name) else other
        yield (
            path, series, k, rows, cols, numbers("ImagePositionPatient", 3), numbers("ImageOrientationPatient", 6), numbers("PixelSpacing", 2), one("SliceThickness", None), one("RescaleSlope", 1.0),
            one("RescaleIntercept", 0.0), kind, bytes(h.pixels[k * size : (k + 1) * size]), None,
        )


def slices_of(files: DataFrame) -> DataFrame:
    """A row for each frame of each file of a table of path and content."""
    reals = pa.list_(pa.float64())
    kinds = [pa.string(), pa.string(), pa.int32(), pa.int32(), pa.int32(), reals, reals, reals, pa.float64(), pa.float64(), pa.float64(), pa.string(), pa.binary(), pa.string()]
    names = [x.split()[0] for x in SLICES.split(", ")]

    def decoded(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, raw in zip(batch["path"].to_pylist(), batch["content"], strict=True):
                try:
                    rows = list(_frames(path, raw.as_py() or b""))
                except (ValueError, KeyError, struct.error) as e:
                    rows = [(path, path.rsplit("/", 1)[0], *[None] * 11, f"{path}: {e}")]
                yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    return files.select("path", "content").mapInArrow(decoded, SLICES)


#: Share of the usual gap by which the gap of two slices may differ from it.
UNEVEN = 0.1


def _assemble(t: pa.Table) -> tuple[np.ndarray, np.ndarray, str]:
    """(voxels by column, row and slice; affine to right, anterior, superior; type) of one series; ValueError where its slices make no volume."""
    errors = [x for x in t["error"].to_pylist() if x]
    if errors:
        raise ValueError("; ".join(sorted(errors)))
    get = lambda c: t[c].to_pylist()
    if any(x is None for c in ("position", "orientation", "spacing") for x in get(c)):
        raise ValueError("a slice without position, orientation or spacing")
    for c in ("n_rows", "n_cols", "kind", "spacing"):
        if len({str(x) for x in get(c)}) > 1:
            raise ValueError(f"slices of unlike {c}")
    orientation, place = np.array(get("orientation")), np.array(get("position"))
    if np.abs(orientation - orientation[0]).max() > 1e-4:
        raise ValueError("slices of unlike orientation")
    across, down = orientation[0, :3], orientation[0, 3:]
    along = place @ np.cross(across, down)
    order = np.argsort(along, kind="stable")
    gaps = np.diff(along[order])
    if len(gaps) and gaps.min() < 1e-6:
        raise ValueError("two slices at one place")
    if len(gaps) and np.abs(gaps - np.median(gaps)).max() > UNEVEN * np.median(gaps):
        raise ValueError("uneven gaps between slices")
    shape, kind, spacing = (get("n_rows")[0], get("n_cols")[0]), get("kind")[0], get("spacing")[0]
    scale = list(zip(get("slope"), get("intercept"), strict=True))
    scaled, pixels = any(s != (1.0, 0.0) for s in scale), t["pixels"]
    out = np.empty((shape[1], shape[0], len(order)), np.float64 if scaled else np.dtype(kind))
    for k, i in enumerate(order.tolist()):
        plane = np.frombuffer(pixels[i].as_buffer(), np.dtype(f"<{kind}")).reshape(shape).T
        out[:, :, k] = plane * scale[i][0] + scale[i][1] if scaled else plane
    affine = np.eye(4)
    affine[:3, 0], affine[:3, 1], affine[:3, 3] = across * spacing[1], down * spacing[0], place[order[0]]
    step = (place[order[-1]] - place[order[0]]) / len(gaps) if len(gaps) else np.cross(across, down) * (get("thickness")[0] or 1.0)
    affine[:3, 2] = step
    affine[:2] *= -1  # left and posterior become right and anterior
    return out, affine, out.dtype.name


def series_volumes(slices: DataFrame, to_canonical: bool = True) -> DataFrame:
    """A volume for each series of slices, as of nifti.read_volumes with the series as path, and `error`: why it has none.

    The slices are put in order along their common normal; all of a series meet in one task, as they must in one volume.
    """
    reals, names = pa.list_(pa.float64()), ["path", "shape", "zooms", "affine", "dtype", "voxels", "error"]
    kinds = [pa.string(), pa.list_(pa.int32()), reals, reals, pa.string(), reals, pa.string()]

    def assembled(t: pa.Table) -> pa.Table:
        name = t["series"][0].as_py()
        try:
            voxels, affine, kind = _assemble(t)
            if to_canonical:
                voxels, affine = nifti.canonical(voxels, affine)
            row = (name, list(voxels.shape), np.linalg.norm(affine[:3, :3], axis=0).tolist(), affine.ravel().tolist(), kind, voxels.astype(np.float64).ravel(), None)
        except ValueError as e:
            row = (name, None, None, None, None, None, str(e))
        return pa.table([pa.array([v], k) for v, k in zip(row, kinds, strict=True)], names=names)

    return slices.groupBy("series").applyInArrow(assembled, f"{nifti.SCHEMA}, error string")


def read_series(spark: SparkSession, path: str, to_canonical: bool = True, pattern: str = "*.[dD][cC][mM]") -> DataFrame:
    """The volumes of all series below `path`."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(path)
    return series_volumes(slices_of(files), to_canonical)


def encode(tags: dict[str, str | int], pixels: np.ndarray) -> bytes:
    """A single-frame file (explicit, little-endian) of whole-number pixels by row and column, with the tags given."""
    numbers = {v: k for k, v in TAGS.items()}
    own = {"Rows": pixels.shape[0], "Columns": pixels.shape[1], "BitsAllocated": pixels.dtype.itemsize * 8, "SamplesPerPixel": 1, "PixelRepresentation": int(pixels.dtype.kind == "i")}

    def element(tag: int, kind: bytes, value: bytes) -> bytes:
        value += (b"\0" if kind in (b"UI", b"OW") else b" ") * (len(value) % 2)
        size = struct.pack("<HI", 0, len(value)) if kind in _LONG else struct.pack("<H", len(value))
        return struct.pack("<HH", tag >> 16, tag & 0xFFFF) + kind + size + value

    body = [element(TRANSFER_SYNTAX, b"UI", EXPLICIT.encode())]
    for tag, value in sorted((numbers[n], v) for n, v in (tags | own).items()):
        body.append(element(tag, b"US", struct.pack("<H", value)) if _IMPLIED.get(tag) == "H" else element(tag, b"LO", str(value).encode("latin-1")))
    return b"\0" * 128 + b"DICM" + b"".join(body) + element(PIXELS, b"OW", pixels.astype(pixels.dtype.newbyteorder("<")).tobytes())
