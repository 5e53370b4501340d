"""Queries over DICOM files made of the driver's tables: series as volumes, nested groups, inherited spacing. Each with its SQL."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxloom.functions import headers as H
from voxloom.operators import volumes as V
from voxloom.plans.metadata_queries import _table
from voxloom.plans.volume_queries import query
from voxloom.sources import dicom

#: Side of the slices that a page's bytes are packed into.
SIDE = 16
#: Direction cosines of a row and of a column by page_id % 3: axial, sagittal and coronal.
ORIENTATIONS = ((1, 0, 0, 0, 1, 0), (0, 1, 0, 0, 0, -1), (1, 0, 0, 0, 0, -1))


def _slices(page_id: int, html: str) -> list[tuple[str, bytes]]:
    """A page's bytes as files of one slice each, the last slice first."""
    raw = html.encode()
    n = max(1, -(-len(raw) // SIDE**2))
    pixels = np.frombuffer(raw.ljust(n * SIDE**2, b"\0"), np.uint8).reshape(n, SIDE, SIDE)
    turn = ORIENTATIONS[page_id % 3]
    normal, gap, out = np.cross(turn[:3], turn[3:]), 1.5 + page_id % 4, []
    for k in range(n):
        place = np.array([page_id % 7, -(page_id % 5), 2.5]) + normal * gap * k
        text = lambda x: "\\".join(str(float(v)) for v in x)
        tags = {"SeriesInstanceUID": f"1.2.{page_id}", "ImagePositionPatient": text(place), "ImageOrientationPatient": text(turn), "PixelSpacing": f"{0.5 + page_id % 2}\\0.75", "SliceThickness": "9"}
        out.append((f"/exam/{page_id}/{n - k:06d}.dcm", dicom.encode(tags, pixels[k])))
    return out


def packed_pages(pages: DataFrame) -> DataFrame:
    """path and content of the files of all pages."""

    def packed(batches):
        for batch in batches:
            for page_id, html in zip(batch["page_id"].to_pylist(), batch["html"].to_pylist(), strict=True):
                paths, contents = zip(*_slices(page_id, html or ""), strict=True)
                yield pa.record_batch([pa.array(paths, pa.string()), pa.array(contents, pa.binary())], names=["path", "content"])

    return pages.select("page_id", "html").mapInArrow(packed, "path string, content binary")


_TURN = "CASE page_id % 3 WHEN 0 THEN {} WHEN 1 THEN {} ELSE {} END"
#: Rows of the affine to right, anterior, superior: column step, row step, slice step and origin.
_AFFINE = [
    (_TURN.format("-0.75", "0.0", "-0.75"), "0.0", _TURN.format("0.0", "gap", "0.0"), "-(page_id % 7)"),
    (_TURN.format("0.0", "-0.75", "0.0"), _TURN.format("-row_mm", "0.0", "0.0"), _TURN.format("0.0", "0.0", "-gap"), "page_id % 5"),
    ("0.0", _TURN.format("0.0", "-row_mm", "-row_mm"), _TURN.format("gap", "0.0", "0.0"), "2.5"),
]


@query(
    "WITH p AS (SELECT page_id, hex(encode(html)) AS h, greatest(1, (octet_length(encode(html)) + 255) // 256) AS n, 1.5 + page_id % 4 AS gap, 0.5 + page_id % 2 AS row_mm FROM pages), "
    "b AS (SELECT page_id, i, CAST('0x' || substr(h, 2 * i + 1, 2) AS INT) AS v FROM (SELECT page_id, h, unnest(range(0, length(h) // 2)) AS i FROM p)), "
    "s AS (SELECT page_id, CAST(sum(v * (i % 1009 + 1)) AS BIGINT) AS checksum FROM b GROUP BY page_id) "
    "SELECT page_id, CAST(n AS INT) AS slices, coalesce(checksum, 0) AS checksum, "
    + ", ".join(f"round(CASE WHEN {j} = 2 AND n = 1 THEN ({cell}) / gap * 9 ELSE {cell} END, 6) + 0.0 AS a{i}{j}" for i, row in enumerate(_AFFINE) for j, cell in enumerate(row))
    + " FROM p LEFT JOIN s USING (page_id)"
)
def dicom_volumes(spark, sf_dir):
    """Each page is a series of shuffled slices; its volume must hold every byte in its place, and the affine of its slices."""
    out = dicom.series_volumes(dicom.slices_of(packed_pages(_table(spark, sf_dir, "pages"))), to_canonical=False)
    n = F.get("shape", F.lit(2))
    place = lambda i, n: (i % n) * SIDE**2 + F.floor(i / n) % SIDE * SIDE + F.floor(i / (n * SIDE))
    weighted = V.bind(F.struct("voxels", n.alias("n")), lambda s: F.aggregate(F.transform(s["voxels"], lambda v, i: v.cast("long") * (place(i, s["n"]) % 1009 + 1)), F.lit(0).cast("long"), lambda a, x: a + x))
    cells = [(F.round(F.get("affine", F.lit(4 * i + j)), 6) + 0.0).alias(f"a{i}{j}") for i in range(3) for j in range(4)]
    return out.select(F.substring_index("path", ".", -1).cast("long").alias("page_id"), n.alias("slices"), weighted.alias("checksum"), *cells)


def _nested(spark, sf_dir) -> DataFrame:
    """Headers made of events: spacings in the file, in its shared groups, in its frames, at the detector or nowhere, by event_id % 6."""
    k, v = F.col("event_id") % 6, F.col("value")
    pair = lambda x: F.concat_ws("\\", x.cast("string"), (x + 1).cast("string"))
    entry = lambda x: F.create_map(F.lit("PixelSpacing"), pair(x), F.lit("SliceThickness"), x.cast("string"), F.lit("FrameType"), F.concat(F.lit("derived\\"), F.col("event_type")))
    none = F.expr("CAST(map() AS map<string,string>)")
    tags = F.map_concat(
        F.create_map(F.lit("ImageType"), F.concat(F.lit("ORIGINAL\\PRIMARY\\"), F.col("event_type"))),
        F.when(k == 0, F.create_map(F.lit("PixelSpacing"), pair(v), F.lit("SpacingBetweenSlices"), v.cast("string"))).when(k == 4, F.create_map(F.lit("ImagerPixelSpacing"), pair(v + 3))).otherwise(none),
    )
    frames = F.when(k == 2, F.array(entry(v + 10), none, entry(v), entry(v + 2))).when(k == 3, F.array(entry(v + 1), entry(v)))
    frames = frames.otherwise(F.array().cast("array<map<string,string>>"))
    return _table(spark, sf_dir, "events").select("event_id", tags.alias("tags"), F.when(k == 1, entry(v * 2)).otherwise(none).alias("shared"), frames.alias("frames"))


_FOUND = "CASE event_id % 6 WHEN 1 THEN {0} * 2 WHEN 2 THEN {0} + 2 WHEN 3 THEN (({0} + 1) + {0}) / 2 {1} END"


@query(
    "SELECT event_id, " + _FOUND.format("value", "WHEN 0 THEN value WHEN 4 THEN value + 3") + " AS row_mm, "
    "CASE event_id % 6 WHEN 0 THEN value + 1 WHEN 1 THEN value * 2 + 1 WHEN 2 THEN (value + 2) + 1 WHEN 3 THEN (((value + 1) + 1) + (value + 1)) / 2 WHEN 4 THEN (value + 3) + 1 END AS column_mm, "
    + _FOUND.format("value", "") + " AS thickness, CASE WHEN event_id % 6 = 0 THEN value END AS between, "
    "array_to_string(list_sort(CASE WHEN event_id % 6 IN (1, 2, 3) THEN ['DERIVED'] ELSE [] END || [upper(event_type), 'ORIGINAL', 'PRIMARY']), ',') AS flags, 'PRIMARY' AS kind FROM events"
)
def nested_groups(spark, sf_dir):
    maps = F.col("tags"), F.col("shared"), F.col("frames")
    spacing, slices = H.file_spacing(*maps), H.slice_metrics(*maps)
    kind = H.primary_secondary(H.upper_list(F.try_element_at("tags", F.lit("ImageType"))))
    return _nested(spark, sf_dir).select(
        "event_id", F.get(spacing, 0).alias("row_mm"), F.get(spacing, 1).alias("column_mm"), slices["thickness"].alias("thickness"), slices["between"].alias("between"),
        F.array_join(H.image_flags(*maps), ",").alias("flags"), kind.alias("kind"),
    )


@query(
    "WITH s AS (SELECT event_id, user_id // 5 AS exam, event_type AS base, ts, event_id % 4 = 0 AS derived, CASE WHEN event_id % 8 NOT IN (0, 3) THEN value END AS r, CASE WHEN event_id % 4 <> 0 AND event_id % 16 <> 7 THEN value + 1 END AS c FROM events), "
    "p AS (SELECT d.event_id, n.r, n.c, row_number() OVER (PARTITION BY d.event_id ORDER BY abs(epoch_us(d.ts) - epoch_us(n.ts)), n.event_id) AS k FROM s d JOIN s n ON n.exam = d.exam AND n.base = d.base AND NOT n.derived WHERE d.derived) "
    "SELECT s.event_id, CASE WHEN derived THEN coalesce(s.r, CASE WHEN p.c <> 0 THEN nullif(p.r, 0) END) ELSE s.r END AS row_mm, CASE WHEN derived THEN coalesce(s.c, CASE WHEN p.r <> 0 THEN nullif(p.c, 0) END) ELSE s.c END AS column_mm FROM s LEFT JOIN p ON p.event_id = s.event_id AND p.k = 1"
)
def inherited_spacing(spark, sf_dir):
    i = F.col("event_id")
    series = _table(spark, sf_dir, "events").select(
        F.floor(F.col("user_id") / 5).alias("exam"), F.col("event_type").alias("base_type"), i.alias("series"), F.col("ts").alias("acq_dt"), (i % 4 == 0).alias("is_derived"),
        F.when(~(i % 8).isin(0, 3), F.col("value")).alias("pixdim_row_mm"), F.when((i % 4 != 0) & (i % 16 != 7), F.col("value") + 1).alias("pixdim_col_mm"),
    )
    out = dicom.inherit_spacing(series)
    return out.select(F.col("series").alias("event_id"), F.col("pixdim_row_mm").alias("row_mm"), F.col("pixdim_col_mm").alias("column_mm"))
