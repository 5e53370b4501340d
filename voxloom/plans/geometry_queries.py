"""Affine, fitting and voting operators over the volumes of volume_queries.py. Each query with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from voxloom.functions import headers as H
from voxloom.operators import catalog as C
from voxloom.operators import geometry as G
from voxloom.operators import volumes as V
from voxloom.plans.catalog_queries import over_events
from voxloom.plans.metadata_queries import _table, dealt
from voxloom.plans.volume_queries import _GRID, _PAIRS, _VOX, SHAPE, _pairs, query, subjects, volumes, voxels

#: A quarter turn, half a step along z and shifts that leave the volume.
AFFINE = [[0.0, 1.0, 0.0, 0.25], [-1.0, 0.0, 0.0, 4.0], [0.0, 0.0, 0.5, 0.25]]
_PLACES = ", p AS (SELECT vec_id, i, (i // 6) % 4 + CAST(0.25 AS DOUBLE) AS a, CAST(4 - i // 24 AS DOUBLE) AS b, (i % 6) * CAST(0.5 AS DOUBLE) + CAST(0.25 AS DOUBLE) AS c FROM g) "
_LINEAR = "SELECT p.vec_id, p.i, round(coalesce(sum(v * (1 - abs(x - least(greatest(a, 0), 3))) * (1 - abs(y - least(greatest(b, 0), 3))) * (1 - abs(z - least(greatest(c, 0), 3)))), 0), 6) + 0.0 AS v FROM p LEFT JOIN vox ON vox.vec_id = p.vec_id AND a >= -0.5 AND a < 3.5 AND b >= -0.5 AND b < 3.5 AND c >= -0.5 AND c < 3.5 AND abs(x - least(greatest(a, 0), 3)) < 1 AND abs(y - least(greatest(b, 0), 3)) < 1 AND abs(z - least(greatest(c, 0), 3)) < 1 GROUP BY p.vec_id, p.i"


@query(_VOX + _GRID.format(n=96) + _PLACES + "SELECT p.vec_id, p.i, coalesce(v, 0) AS v FROM p LEFT JOIN vox ON vox.vec_id = p.vec_id AND x = floor(a + 0.5) AND y = floor(b + 0.5) AND z = floor(c + 0.5)")
def affine_nearest(spark, sf_dir):
    return voxels(volumes(spark, sf_dir), "vec_id", G.affine_resample(F.col("v"), SHAPE, (4, 4, 6), AFFINE, 0), "v")


@query(_VOX + _GRID.format(n=96) + _PLACES + _LINEAR)
def affine_linear(spark, sf_dir):
    return voxels(volumes(spark, sf_dir), "vec_id", G.affine_resample(F.col("v"), SHAPE, (4, 4, 6), AFFINE, 1), "v", 6)


@query(
    _VOX + _GRID.format(n=64) + ", r AS (SELECT vec_id, i, cos(radians(vec_id % 12 * 30)) AS co, sin(radians(vec_id % 12 * 30)) AS si, i // 16 - 1.5 AS dx, (i // 4) % 4 - 1.5 AS dy FROM g), "
    "p AS (SELECT vec_id, i, co * dx + si * dy + 1.5 AS a, co * dy - si * dx + 1.5 AS b, CAST(i % 4 AS DOUBLE) AS c FROM r) " + _LINEAR
)
def rotate_slices(spark, sf_dir):
    return voxels(volumes(spark, sf_dir), "vec_id", G.rotate_slices(F.col("v"), SHAPE, F.col("vec_id") % 12 * 30), "v", 6)


@query(
    _VOX + ", b AS (SELECT vec_id, 2 - (min(x) + max(x)) // 2 AS sx, 2 - (min(y) + max(y)) // 2 AS sy, 2 - (min(z) + max(z)) // 2 AS sz FROM vox WHERE m GROUP BY vec_id), g AS (SELECT *, CAST(unnest(range(0, 64)) AS INT) AS i FROM b) "
    "SELECT g.vec_id, g.i, coalesce(v, 0) AS v FROM g LEFT JOIN vox ON vox.vec_id = g.vec_id AND x = g.i // 16 - sx AND y = (g.i // 4) % 4 - sy AND z = g.i % 4 - sz"
)
def center_roi(spark, sf_dir):
    rows = volumes(spark, sf_dir).where(F.array_max("mask") > 0).select("vec_id", "v", *[s.alias(f"s{k}") for k, s in enumerate(G.roi_shift(F.col("mask"), SHAPE))])
    return voxels(rows, "vec_id", G.shifted(F.col("v"), SHAPE, [F.col(f"s{k}") for k in range(3)]), "v")


@query(
    _VOX + _GRID.format(n=108) + ", p AS (SELECT vec_id, i, (i // 18 + 1) * 3 / 7 AS a, CAST((i // 3) % 6 - 1 AS DOUBLE) AS b, (i % 3) * 3.0 AS c, (i // 3) % 6 BETWEEN 1 AND 4 AND i % 3 < 2 AS inside FROM g) "
    "SELECT p.vec_id, p.i, round(coalesce(sum(v * (1 - abs(x - a)) * (1 - abs(y - b)) * (1 - abs(z - c))), 0), 6) + 0.0 AS v FROM p LEFT JOIN vox ON vox.vec_id = p.vec_id AND inside AND abs(x - a) < 1 AND abs(y - b) < 1 AND abs(z - c) < 1 GROUP BY p.vec_id, p.i"
)
def fit_to_grid(spark, sf_dir):
    fitted, _ = G.fit(F.col("v"), SHAPE, (1.0, 1.0, 1.0), (0.5, 1.0, 2.0), (6, 6, 3))
    return voxels(volumes(spark, sf_dir), "vec_id", fitted, "v", 6)


@query(_VOX + "SELECT vec_id, i, v FROM vox")
def fit_and_back(spark, sf_dir):
    fitted, record = G.fit(F.col("v"), SHAPE, (1.75, 1.75, 1.75), (1.0, 1.0, 1.0), (9, 8, 10), 0)
    return voxels(volumes(spark, sf_dir), "vec_id", G.unfit(fitted, record), "v")


@query(_VOX + _GRID.format(n=216) + "SELECT g.vec_id, g.i, coalesce(v, 0) AS v FROM g LEFT JOIN vox ON vox.vec_id = g.vec_id AND y = g.i // 36 - 1 AND z = (g.i // 6) % 6 - 1 AND x = g.i % 6 - 1")
def robust_align(spark, sf_dir):
    return voxels(volumes(spark, sf_dir), "vec_id", G.align(F.col("v"), SHAPE, "sagittal", (6, 6), 1)[0], "v")


@query(_VOX + "SELECT vec_id, CAST(2 * i AS INT) AS i, v FROM vox UNION ALL SELECT vec_id, CAST(2 * i + 1 AS INT), 0.0 - v FROM vox")
def undo_all_transforms(spark, sf_dir):
    """Two channels a voxel, aligned and brought back by the record."""
    aligned, shape, steps = G.align(F.col("v"), SHAPE, "coronal", (5, 6), 2)
    both = F.flatten(F.transform(aligned, lambda v: F.array(v, 0.0 - v)))
    back = G.by_channel(F.col("both"), 2, lambda c: V.apply_steps(c, shape, G.from_record(G.to_record(steps)), reverse=True)[0])
    return voxels(volumes(spark, sf_dir).select("vec_id", both.alias("both")), "vec_id", back, "v")


@query(
    _VOX + ", s AS (SELECT vec_id // 3 AS subject, i // 4 AS voxel, i % 4 AS class, count(*) AS c, sum(floor(v * 10) / 10) AS p, max(floor(v * 10) / 10) FILTER (vec_id % 3 = 1) AS m FROM vox GROUP BY ALL), "
    "t AS (SELECT *, max(p) OVER w AS top, max(m) OVER w AS mtop FROM s WHERE c = 3 WINDOW w AS (PARTITION BY subject, voxel)), u AS (SELECT *, abs(p - top) <= 1e-8 + 1e-5 * abs(top) AS near FROM t) "
    "SELECT subject, voxel, CAST(CASE WHEN count(*) FILTER (near) = 1 THEN min(class) FILTER (near) ELSE min(class) FILTER (m = mtop) END AS INT) AS label FROM u GROUP BY subject, voxel"
)
def average_prob_ties(spark, sf_dir):
    """Values in tenths, so that classes tie; the second model decides ties."""
    tenths = lambda k: F.transform(f"v{k}", lambda x: F.floor(x * 10) / 10)
    rows = subjects(spark, sf_dir, 3).select("subject", *[tenths(k).alias(f"t{k}") for k in range(3)])
    joint = F.zip_with(F.zip_with("t0", "t1", lambda a, b: a + b), "t2", lambda a, b: a + b)
    rows = rows.select("subject", "t1", joint.alias("joint"))
    of = lambda c, j: F.slice(F.col(c), j * 4 + 1, 4)
    labels = F.transform(F.sequence(F.lit(0), F.lit(15)), lambda j: G.label_with_ties(of("joint", j), of("t1", j)))
    return rows.select("subject", F.posexplode(labels).alias("voxel", "label"))


@query(_VOX + "SELECT vec_id, z, bool_or(lab = 1) AND bool_or(lab = 2) AS all_, bool_or(lab = 3) OR bool_or(lab = 0) AS any_, NOT bool_or(lab = 3) AS none_, bool_or(lab = 1) AND bool_or(lab = 2) AND NOT bool_or(lab = 3) AS both FROM vox GROUP BY vec_id, z")
def passes_require_classes(spark, sf_dir):
    slices = volumes(spark, sf_dir).select("vec_id", "lab", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("z"))
    slices = slices.select("vec_id", "z", F.filter("lab", lambda _, i: i % 4 == F.col("z")).alias("present"))
    rules = {"all_": {(1, 2): "all"}, "any_": {(0, 3): "any"}, "none_": {(3,): "none"}, "both": {(1, 2): "all", (3,): "none"}}
    return slices.select("vec_id", "z", *[G.passes_classes(F.col("present"), r).alias(n) for n, r in rules.items()])


@query(
    _PAIRS + ", k AS (SELECT c, count(*) FILTER (gt = c) AS support, count(*) FILTER (pred = c) AS claimed, count(*) FILTER (gt = c AND pred = c) AS hit, count(*) AS n FROM p, range(0, 4) r(c) GROUP BY c) "
    "SELECT round(sum(coalesce(hit / nullif(claimed, 0), 0) * support) / max(n), 6) AS precision, round(sum(coalesce(hit / nullif(support, 0), 0) * support) / max(n), 6) AS recall, round(sum(hit) / max(n), 6) AS accuracy FROM k"
)
def weighted_macro(spark, sf_dir):
    """Precision and recall of the classes weighted by their support, and the share of voxels that agree."""
    counts = _pairs(spark, sf_dir).groupBy("gt", "pred").agg(F.count("*").alias("n"))
    of = counts.withColumn("class", F.explode(F.sequence(F.lit(0), F.lit(3))))
    gt, pred = F.col("gt") == F.col("class"), F.col("pred") == F.col("class")
    n = lambda c: F.sum(F.when(c, F.col("n")).otherwise(0))
    by_class = of.groupBy("class").agg(n(gt).alias("support"), n(pred).alias("claimed"), n(gt & pred).alias("hit"))
    mean = lambda part: F.round(F.try_divide(F.sum(part), F.sum("support")), 6)
    ratio = lambda b: F.coalesce(F.try_divide("hit", F.col(b)), F.lit(0.0)) * F.col("support")
    return by_class.agg(mean(ratio("claimed")).alias("precision"), mean(ratio("support")).alias("recall"), mean(F.col("hit")).alias("accuracy"))


@query(_VOX + ", g AS (SELECT DISTINCT vec_id, z FROM vox), h AS (SELECT *, CAST(unnest(range(0, 32)) AS INT) AS i FROM g) SELECT h.vec_id, h.z, h.i, coalesce(lab, 0) AS lab FROM h LEFT JOIN vox ON vox.vec_id = h.vec_id AND vox.x * 4 + vox.y = h.i // 2 AND vox.z = h.z - 1 + h.i % 2")
def label_windows(spark, sf_dir):
    """The label slices that belong to each input window."""
    slices = volumes(spark, sf_dir).select("vec_id", F.transform("lab", lambda c: c.cast("double")).alias("lab"), F.explode(F.sequence(F.lit(0), F.lit(3))).alias("z"))
    return slices.select("vec_id", "z", F.posexplode(V.slab_at(F.col("lab"), SHAPE, 2, F.col("z"))).alias("i", "lab")).withColumn("lab", F.col("lab").cast("int"))


@query("SELECT vec_id, row_number() OVER (ORDER BY md5('7:' || vec_id)) - 1 AS place FROM embeddings")
def epoch_shuffle(spark, sf_dir):
    return C.shuffled(_table(spark, sf_dir, "embeddings").select("vec_id"), "vec_id", 7)


@query("SELECT vec_id FROM embeddings ORDER BY md5('11:' || vec_id) LIMIT 100")
def sample_subjects(spark, sf_dir):
    """The sample of 100 is the feature."""
    return C.sampled(_table(spark, sf_dir, "embeddings").select("vec_id"), "vec_id", 11, 100)


#: id, in-plane spacing of the file, shared by all frames, of each frame, of the detector, of other files; what is taken.
SPACINGS = [
    (1, 0.5, 0.6, [0.7], 0.8, [0.9], 0.5), (2, None, 0.6, [0.7], 0.8, [0.9], 0.6), (3, None, None, [0.7, 0.5, 0.9], 0.8, [0.9], 0.7), (4, None, None, [0.5, 1.0], 0.8, None, 0.75),
    (5, None, None, [], 0.8, [0.9], 0.8), (6, None, None, None, None, [1.0, 3.0, 2.0, 5.0], 2.5), (7, None, None, None, None, None, None), (8, None, None, [None, 0.25], None, None, 0.25),
]


@query(over_events("id, spacing", [(r[0], r[6]) for r in SPACINGS]).replace("SELECT *", "SELECT id, CAST(spacing AS DOUBLE) AS spacing"))
def pixel_spacing(spark, sf_dir):
    df = dealt(spark, sf_dir, [r[:6] for r in SPACINGS], "id int, own double, shared double, frames array<double>, detector double, files array<double>")
    return df.select("event_id", H.pixel_spacing(F.col("own"), F.col("shared"), F.col("frames"), F.col("detector"), F.col("files")).alias("spacing"))
