"""Volume operators over `embeddings`: each vector of 64 is a 4 x 4 x 4 volume. Each query with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from voxloom.operators import resampling as R
from voxloom.operators import volumes as V

SHAPE = (4, 4, 4)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
_VOX = """WITH vox AS (SELECT vec_id, i, i // 16 AS x, (i // 4) % 4 AS y, i % 4 AS z, v, v > 0 AS m, CAST(floor(abs(v) * 10) AS INT) % 4 AS lab
FROM (SELECT vec_id, CAST(unnest(range(0, 64)) AS INT) AS i, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings)) """


def query(sql: str | None = None) -> Callable:
    def add(f: Callable) -> Callable:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def volumes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_id, v (doubles), mask and lab, an array of 64 each."""
    df = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    df = df.select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    return df.withColumn("mask", F.transform("v", lambda x: (x > 0).cast("int"))).withColumn("lab", V.levels(F.col("v")))


def subjects(spark: SparkSession, sf_dir: str, n: int) -> DataFrame:
    """subject and v0, lab0, v1, ... of n consecutive volumes; subjects that lack one are left out."""
    df = volumes(spark, sf_dir).withColumn("subject", F.floor(F.col("vec_id") / n))
    pick = lambda c, k: F.first(F.when(F.col("vec_id") % n == k, F.col(c)), True).alias(f"{c}{k}")
    return df.groupBy("subject").agg(F.count("*").alias("n"), *[pick(c, k) for k in range(n) for c in ("v", "lab", "mask")]).where(f"n = {n}").drop("n")


def voxels(df: DataFrame, key: str, value: Column, name: str, digits: int | None = None) -> DataFrame:
    """A row for each voxel: key, i, value."""
    out = df.select(key, F.posexplode(value).alias("i", name))
    return out.withColumn(name, F.round(name, digits) + 0.0) if digits is not None else out


def subject_sql(n: int, columns: str) -> str:
    return _VOX + f", s AS (SELECT vec_id // {n} AS subject, CAST(vec_id % {n} AS INT) AS k, i, v, lab, m, count(*) OVER (PARTITION BY vec_id // {n}, i) AS c FROM vox) SELECT subject, i, {columns} FROM s WHERE c = {n} GROUP BY subject, i"


@query(_VOX + "SELECT vec_id, " + ", ".join(f"CAST(round_even(count(*) FILTER (lab = {k}) * 0.5, 0) AS BIGINT) AS segment{k}_mm3" for k in (1, 2, 3)) + " FROM vox GROUP BY vec_id")
def quantify_volumes(spark, sf_dir):
    return volumes(spark, sf_dir).select("vec_id", *[V.level_volume(F.col("lab"), k, 0.5).alias(f"segment{k}_mm3") for k in (1, 2, 3)])


@query(_VOX + "SELECT vec_id, i, round(CASE WHEN m THEN (v - avg(v) FILTER (m) OVER w) / stddev_pop(v) FILTER (m) OVER w ELSE 0 END, 6) + 0.0 AS z FROM vox WINDOW w AS (PARTITION BY vec_id)")
def normalize_masked(spark, sf_dir):
    return voxels(volumes(spark, sf_dir), "vec_id", V.zscore(F.col("v"), F.col("mask")), "z", 6)


@query(_VOX + "SELECT vec_id, i, CASE WHEN m THEN v ELSE 0 END AS v FROM vox")
def apply_mask(spark, sf_dir):
    return voxels(volumes(spark, sf_dir), "vec_id", V.apply_mask(F.col("v"), F.col("mask")), "v")


@query(subject_sql(4, "round(sum(v ORDER BY k) / 4, 6) + 0.0 AS mean"))
def average_volumes(spark, sf_dir):
    return voxels(subjects(spark, sf_dir, 4), "subject", V.average([F.col(f"v{k}") for k in range(4)]), "mean", 6)


@query(subject_sql(4, "CAST(max(CASE WHEN m THEN 1 ELSE 0 END) AS INT) AS merged"))
def merge_masks_or(spark, sf_dir):
    return voxels(subjects(spark, sf_dir, 4), "subject", V.merge_or([F.col(f"mask{k}") for k in range(4)]), "merged")


@query(subject_sql(3, "coalesce(min_by(lab, k) FILTER (lab <> 0), 0) AS label"))
def overlay_first_nonzero(spark, sf_dir):
    return voxels(subjects(spark, sf_dir, 3), "subject", V.overlay([F.col(f"lab{k}") for k in range(3)]), "label")


@query(_VOX + "SELECT vec_id, i, CAST(CASE lab WHEN 1 THEN 2 WHEN 2 THEN 1 WHEN 3 THEN 4 ELSE 0 END AS INT) AS label FROM vox")
def remap_classes(spark, sf_dir):
    return voxels(volumes(spark, sf_dir), "vec_id", V.remap(F.col("lab"), {1: 2, 2: 1, 3: 4}), "label")


@query(subject_sql(4, "round(CASE WHEN max(v) FILTER (k = 0) > max(v) FILTER (k = 1) THEN exp(max(v) FILTER (k = 2)) ELSE max(v) FILTER (k = 3) ** 2 - 1 END, 6) + 0.0 AS value"))
def volume_expr(spark, sf_dir):
    names = {n: F.col(f"v{k}") for k, n in enumerate("ABCD")}
    return voxels(subjects(spark, sf_dir, 4), "subject", V.volume_expr("where(A > B, exp(C), D ** 2 - 1)", names), "value", 6)


@query(_VOX + "SELECT vec_id, count(*) = 64 AND count(*) FILTER (isfinite(v)) = 64 AS valid FROM vox GROUP BY vec_id")
def finite_guard(spark, sf_dir):
    good = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return volumes(spark, sf_dir).select("vec_id", ((F.size("v") == 64) & good).alias("valid"))


@query(_VOX + "SELECT vec_id, CAST(y * 16 + z * 4 + x AS INT) AS i, v FROM vox")
def reorder_axes(spark, sf_dir):
    return voxels(volumes(spark, sf_dir), "vec_id", V.reorder_axes(F.col("v"), SHAPE, "sagittal")[0], "v")


@query(_VOX + "SELECT vec_id, i, v FROM vox")
def roundtrip_align(spark, sf_dir):
    turned, shape = V.reorder_axes(V.flip(F.col("v"), SHAPE, (0, 2)), SHAPE, "coronal")
    padded, wide = V.pad(turned, shape, [(1, 2), (0, 1), (1, 1)])
    back, shape = V.pad(padded, wide, [(-1, -2), (0, -1), (-1, -1)])
    back, _ = V.undo_reorder_axes(back, shape, "coronal")
    return voxels(volumes(spark, sf_dir), "vec_id", V.flip(back, SHAPE, (0, 2)), "v")


@query(_VOX + ", g AS (SELECT vec_id, CAST(unnest(range(0, 144)) AS INT) AS i FROM embeddings) SELECT g.vec_id, g.i, coalesce(v, 0) AS v FROM g LEFT JOIN vox ON vox.vec_id = g.vec_id AND x = g.i // 24 - 1 AND y = (g.i // 4) % 6 - 1 AND z = g.i % 4")
def pad_hw(spark, sf_dir):
    return voxels(volumes(spark, sf_dir), "vec_id", V.pad_to(F.col("v"), SHAPE, (6, 6, 4))[0], "v")


@query(_VOX + ", g AS (SELECT vec_id, CAST(unnest(range(0, 96)) AS INT) AS i FROM embeddings) SELECT g.vec_id, g.i, coalesce(v, 0) AS v FROM g LEFT JOIN vox ON vox.vec_id = g.vec_id AND x = g.i // 24 AND y = (g.i // 6) % 4 AND z = g.i % 6 - 1")
def pad_slices(spark, sf_dir):
    return voxels(volumes(spark, sf_dir), "vec_id", V.pad(F.col("v"), SHAPE, [(0, 0), (0, 0), (1, 1)])[0], "v")


@query(_VOX + ", g AS (SELECT vec_id, CAST(unnest(range(0, 45)) AS INT) AS i FROM embeddings) SELECT g.vec_id, g.i, coalesce(v, 0) AS v FROM g LEFT JOIN vox ON vox.vec_id = g.vec_id AND x = g.i // 15 + 1 AND y = (g.i // 5) % 3 + 1 AND z = g.i % 5")
def crop_pad(spark, sf_dir):
    return voxels(volumes(spark, sf_dir), "vec_id", V.pad_to(F.col("v"), SHAPE, (3, 3, 5))[0], "v")


@query(_VOX + ", g AS (SELECT vec_id, CAST(unnest(range(0, 343)) AS INT) AS i FROM embeddings) SELECT g.vec_id, g.i, v FROM g JOIN vox ON vox.vec_id = g.vec_id AND x = floor((g.i // 49) * 0.5 + 0.5) AND y = floor(((g.i // 7) % 7) * 0.5 + 0.5) AND z = floor((g.i % 7) * 0.5 + 0.5)")
def resample_nearest(spark, sf_dir):
    return voxels(volumes(spark, sf_dir), "vec_id", V.resample_nearest(F.col("v"), SHAPE, (7, 7, 7)), "v")


@query(_VOX + "SELECT vec_id, " + ", ".join(f"CAST(2 - (min({a}) + max({a})) // 2 AS BIGINT) AS shift_{a}" for a in "xyz") + " FROM vox WHERE m GROUP BY vec_id")
def roi_center_shift(spark, sf_dir):
    rows = volumes(spark, sf_dir).withColumn("box", R.bounding_box(F.col("mask"), R.shape_of(SHAPE))).where(F.col("box").isNotNull())
    by = R.center_padding(F.col("box"), R.shape_of(SHAPE))
    return rows.select("vec_id", *[F.get(F.get(by, F.lit(k)), F.lit(0)).cast("long").alias(f"shift_{n}") for k, n in enumerate("xyz")])


@query(_VOX + ", g AS (SELECT vec_id, CAST(unnest(range(0, 4)) AS INT) AS z FROM embeddings), h AS (SELECT *, CAST(unnest(range(0, 64)) AS INT) AS i FROM g) SELECT h.vec_id, h.z, h.i, coalesce(v, 0) AS v FROM h LEFT JOIN vox ON vox.vec_id = h.vec_id AND vox.x * 4 + vox.y = h.i // 4 AND vox.z = h.z - 2 + h.i % 4")
def windows_25d(spark, sf_dir):
    slices = volumes(spark, sf_dir).select("vec_id", "v", F.explode(F.sequence(F.lit(0), F.lit(SHAPE[2] - 1))).alias("z"))
    return slices.select("vec_id", "z", F.posexplode(V.slab_at(F.col("v"), SHAPE, 4, F.col("z"))).alias("i", "v"))


@query(_VOX + "SELECT vec_id, z, list_sort(list(DISTINCT lab)) = [0, 1, 2, 3] AS has_all, bool_or(lab = 3) AS has_three, count(*) FILTER (m AND lab > 0) AS n FROM vox GROUP BY vec_id, z HAVING bool_or(m)")
def require_classes(spark, sf_dir):
    slices = volumes(spark, sf_dir).select("vec_id", "mask", "lab", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("z"))
    of = lambda c: F.filter(c, lambda _, i: i % 4 == F.col("z"))
    slices = slices.select("vec_id", "z", of("lab").alias("lab"), of("mask").alias("mask")).where(F.array_max("mask") > 0)
    both = F.size(F.filter(F.zip_with("lab", "mask", lambda a, m: (a > 0) & (m > 0)), lambda x: x)).cast("long")
    return slices.select("vec_id", "z", F.forall(F.array(*map(F.lit, range(4))), lambda c: F.array_contains("lab", c)).alias("has_all"), F.array_contains("lab", 3).alias("has_three"), both.alias("n"))


_VOTES = ", t AS (SELECT subject, i, lab, count(*) AS n, max(count(*)) OVER (PARTITION BY subject, i) AS best, max(max(lab) FILTER (k = 1)) OVER (PARTITION BY subject, i) AS second FROM (SELECT vec_id // 3 AS subject, CAST(vec_id % 3 AS INT) AS k, i, lab, count(*) OVER (PARTITION BY vec_id // 3, i) AS c FROM vox) WHERE c = 3 GROUP BY subject, i, lab) SELECT subject, i, CAST(CASE WHEN count(*) = 1 THEN max(lab) ELSE {tie} END AS INT) AS label FROM t WHERE n = best GROUP BY subject, i"


@query(_VOX + _VOTES.format(tie="0"))
def majority_vote(spark, sf_dir):
    return voxels(subjects(spark, sf_dir, 3), "subject", V.majority([F.col(f"lab{k}") for k in range(3)]), "label")


@query(_VOX + _VOTES.format(tie="max(second)"))
def majority_vote_tiebreak(spark, sf_dir):
    return voxels(subjects(spark, sf_dir, 3), "subject", V.majority([F.col(f"lab{k}") for k in range(3)], 2), "label")


_PROB = _VOX + ", s AS (SELECT vec_id // 3 AS subject, i // 4 AS voxel, i % 4 AS class, count(*) AS c, round({agg}, 6) AS p FROM vox GROUP BY ALL) SELECT subject, voxel, CAST(min(class) AS INT) AS label FROM (SELECT *, max(p) OVER (PARTITION BY subject, voxel) AS top FROM s WHERE c = 3) WHERE p = top GROUP BY subject, voxel"


def _by_class(spark, sf_dir, join):
    label = V.per_voxel(join, 4, lambda p: V.argmax(F.transform(p, lambda x: F.round(x, 6))))
    return subjects(spark, sf_dir, 3).select("subject", F.posexplode(label).alias("voxel", "label"))


@query(_PROB.format(agg="sum(v)"))
def average_prob(spark, sf_dir):
    return _by_class(spark, sf_dir, F.zip_with(F.zip_with("v0", "v1", lambda a, b: a + b), "v2", lambda a, b: a + b))


@query(_PROB.format(agg="max(v)"))
def max_prob(spark, sf_dir):
    return _by_class(spark, sf_dir, F.zip_with(F.zip_with("v0", "v1", lambda a, b: F.greatest(a, b)), "v2", lambda a, b: F.greatest(a, b)))


@query(_VOX + ", c AS (SELECT CAST(r.k AS INT) AS class, count(lab) AS n FROM range(0, 6) r(k) LEFT JOIN vox ON lab = r.k AND m GROUP BY r.k) SELECT class, n, CASE WHEN n = 0 THEN 1.0 ELSE round(least(greatest((SELECT sum(n) FROM c) / n, 0), 1000), 6) END AS weight FROM c")
def class_weights(spark, sf_dir):
    rows = volumes(spark, sf_dir).select(F.explode(F.arrays_zip("mask", "lab")).alias("p")).select("p.*").where("mask > 0")
    counts = rows.groupBy(F.col("lab").alias("class")).agg(F.count("*").alias("n"))
    all_ = spark.range(6).select(F.col("id").cast("int").alias("class")).join(counts, "class", "left").select("class", F.coalesce("n", F.lit(0)).alias("n"))
    total = F.sum("n").over(Window.partitionBy())  # over one row a class
    weight = F.when(F.col("n") == 0, 1.0).otherwise(F.round(F.least(total / F.col("n"), F.lit(1000.0)), 6))
    return all_.select("class", "n", weight.alias("weight"))


_PAIRS = _VOX + ", p AS (SELECT a.lab AS gt, b.lab AS pred FROM vox a JOIN vox b ON a.i = b.i AND a.vec_id // 2 = b.vec_id // 2 AND a.vec_id % 2 = 0 AND b.vec_id % 2 = 1 WHERE a.m) "


def _pairs(spark, sf_dir):
    return subjects(spark, sf_dir, 2).select(F.explode(F.arrays_zip("mask0", "lab0", "lab1")).alias("p")).select("p.*").where("mask0 > 0").select(F.col("lab0").alias("gt"), F.col("lab1").alias("pred"))


@query(_PAIRS + "SELECT gt, pred, count(*) AS n FROM p GROUP BY gt, pred")
def confusion_counts(spark, sf_dir):
    return _pairs(spark, sf_dir).groupBy("gt", "pred").agg(F.count("*").alias("n"))


@query(_PAIRS + "SELECT CAST(c AS INT) AS class, round(coalesce(count(*) FILTER (gt = c AND pred = c) / nullif(count(*) FILTER (pred = c), 0), 0), 6) AS precision, round(coalesce(count(*) FILTER (gt = c AND pred = c) / nullif(count(*) FILTER (gt = c), 0), 0), 6) AS recall, round(count(*) FILTER ((gt = c) = (pred = c)) / count(*), 6) AS accuracy FROM p, range(0, 6) r(c) GROUP BY c")
def precision_recall(spark, sf_dir):
    counts = _pairs(spark, sf_dir).groupBy("gt", "pred").agg(F.count("*").alias("n"))
    of = counts.withColumn("class", F.explode(F.sequence(F.lit(0), F.lit(5))))
    gt, pred = F.col("gt") == F.col("class"), F.col("pred") == F.col("class")
    n = lambda c: F.sum(F.when(c, F.col("n")).otherwise(0))
    part = lambda c: F.round(F.coalesce(F.try_divide(n(gt & pred), n(c)), F.lit(0.0)), 6)
    return of.groupBy("class").agg(part(pred).alias("precision"), part(gt).alias("recall"), F.round(n(gt == pred) / F.sum("n"), 6).alias("accuracy"))


@query(_VOX + "SELECT vec_id, i, CAST(unnest(range(0, 4)) AS INT) AS class, CAST(unnest(range(0, 4)) = lab AS INT) AS hot FROM vox")
def one_hot(spark, sf_dir):
    rows = voxels(volumes(spark, sf_dir), "vec_id", F.col("lab"), "lab")
    return rows.select("vec_id", "i", F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(3)), lambda c: (c == F.col("lab")).cast("int"))).alias("class", "hot"))


@query(_VOX + "SELECT vec_id, CAST(z * 16 + x * 4 + y AS INT) AS i, v FROM vox")
def undo_reorder(spark, sf_dir):
    return voxels(volumes(spark, sf_dir), "vec_id", V.undo_reorder_axes(F.col("v"), SHAPE, "sagittal")[0], "v")


_GRID = ", g AS (SELECT vec_id, CAST(unnest(range(0, {n})) AS INT) AS i FROM embeddings) "


@query(_VOX + ", g AS (SELECT DISTINCT vec_id FROM embeddings), h AS (SELECT vec_id, CAST(unnest(range(0, 343)) AS INT) AS i FROM g), j AS (SELECT *, (i // 49) * 0.5 AS a, ((i // 7) % 7) * 0.5 AS b, (i % 7) * 0.5 AS c FROM h) SELECT j.vec_id, j.i, round(sum(v * (1 - abs(x - a)) * (1 - abs(y - b)) * (1 - abs(z - c))), 6) + 0.0 AS v FROM j JOIN vox ON vox.vec_id = j.vec_id AND abs(x - a) < 1 AND abs(y - b) < 1 AND abs(z - c) < 1 GROUP BY j.vec_id, j.i")
def resample_linear(spark, sf_dir):
    return voxels(volumes(spark, sf_dir), "vec_id", V.resample_linear(F.col("v"), SHAPE, (7, 7, 7)), "v", 6)


STEPS = [("flip", (0,)), ("pad", ((1, 0), (0, 1), (0, 0))), ("reorder", "coronal")]


@query(_VOX + _GRID.format(n=100) + "SELECT g.vec_id, g.i, coalesce(v, 0) AS v FROM g LEFT JOIN vox ON vox.vec_id = g.vec_id AND x = 4 - g.i // 20 AND z = (g.i // 5) % 4 AND y = g.i % 5")
def transform_pipeline(spark, sf_dir):
    return voxels(volumes(spark, sf_dir), "vec_id", V.apply_steps(F.col("v"), SHAPE, STEPS)[0], "v")


@query(_VOX + "SELECT vec_id, i, v FROM vox")
def transform_pipeline_reversed(spark, sf_dir):
    moved, shape = V.apply_steps(F.col("v"), SHAPE, STEPS)
    return voxels(volumes(spark, sf_dir), "vec_id", V.apply_steps(moved, shape, STEPS, reverse=True)[0], "v")


@query("SELECT vec_id, round(CAST(embedding[1] AS DOUBLE) - 0.5, 6) AS x, round(CAST(embedding[2] AS DOUBLE) + 2, 6) AS y, round(CAST(embedding[3] AS DOUBLE), 6) + 0.0 AS z FROM embeddings")
def padded_origin(spark, sf_dir):
    moved = V.padded_origin(F.slice("v", 1, 3), (0.5, 1.0, 3.0), ((1, 0), (-2, 1), (0, 4)))
    return volumes(spark, sf_dir).select("vec_id", *[(F.round(F.get(moved, k), 6) + 0.0).alias(n) for k, n in enumerate("xyz")])


@query(_VOX + "SELECT vec_id, bool_and(abs(v - round(v, 6)) <= 1e-8 + 1e-5 * abs(round(v, 6))) AS close FROM vox WHERE i < 4 GROUP BY vec_id")
def shape_check(spark, sf_dir):
    affine = F.slice("v", 1, 4)
    return volumes(spark, sf_dir).select("vec_id", V.all_close(affine, F.transform(affine, lambda x: F.round(x, 6))).alias("close"))


@query(_VOX + "SELECT a.vec_id, a.i, CASE WHEN b.v > 0.05 THEN a.v ELSE 0 END AS v FROM vox a JOIN vox b ON a.vec_id = b.vec_id AND b.i = a.i // 4")
def mask_channels(spark, sf_dir):
    mask = F.transform(F.slice("v", 1, 16), lambda x: (x > 0.05).cast("double"))
    return voxels(volumes(spark, sf_dir), "vec_id", V.mask_channels(F.col("v"), mask, 4), "v")


@query(_VOX + "SELECT DISTINCT vec_id, z FROM vox WHERE m AND lab > 1")
def relevant_slices(spark, sf_dir):
    good = F.zip_with("mask", "lab", lambda m, c: (m > 0) & (c > 1))
    slices = F.array_distinct(F.filter(F.transform(good, lambda g, i: F.when(g, i % SHAPE[2])), lambda z: z.isNotNull()))
    return volumes(spark, sf_dir).select("vec_id", F.explode(slices).alias("z"))


@query(_VOX + ", f AS (SELECT vec_id, z, CASE WHEN bool_or(lab = 3) THEN 3 WHEN bool_or(lab = 1) AND bool_or(lab = 2) THEN 2 ELSE 0 END AS factor FROM vox GROUP BY vec_id, z) SELECT vec_id, z, CAST(unnest(range(0, factor + 1)) AS INT) AS copy FROM f")
def augment_factor(spark, sf_dir):
    slices = volumes(spark, sf_dir).select("vec_id", "lab", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("z"))
    present = F.filter("lab", lambda _, i: i % 4 == F.col("z"))
    factor = F.lit(0)
    for classes, k in reversed([((3,), 3), ((1, 2), 2)]):  # the first entry whose classes are all there decides
        factor = F.when(F.forall(F.array(*map(F.lit, classes)), lambda c: F.array_contains(present, c)), k).otherwise(factor)
    return slices.select("vec_id", "z", F.explode(F.sequence(F.lit(0), factor)).alias("copy"))


@query(_VOX + "SELECT vec_id, i, v + least(z + 1, 3) AS v FROM vox")
def reassemble(spark, sf_dir):
    predicted = F.transform(F.sequence(F.lit(0), F.lit(3)), lambda z: F.transform(V.slab_at(F.col("v"), SHAPE, 3, z), lambda v: v + z))
    return voxels(volumes(spark, sf_dir), "vec_id", V.reassemble(predicted, SHAPE, 3), "v")


_RING = "CASE WHEN (x IN (0, 3) OR y IN (0, 3) OR z IN (0, 3)) THEN v > -0.12 ELSE v > 0.12 END"


@query(
    f"WITH RECURSIVE {_VOX.strip()[5:]}, r AS (SELECT vec_id, x, y, z, {_RING} AS inside FROM vox), f AS (SELECT vec_id, x, y, z FROM r WHERE NOT inside AND (x IN (0, 3) OR y IN (0, 3) OR z IN (0, 3)) "
    "UNION SELECT r.vec_id, r.x, r.y, r.z FROM f JOIN r ON r.vec_id = f.vec_id AND NOT r.inside AND abs(r.x - f.x) + abs(r.y - f.y) + abs(r.z - f.z) = 1) "
    "SELECT r.vec_id, CAST(r.x * 16 + r.y * 4 + r.z AS INT) AS i, CAST(f.x IS NULL AS INT) AS filled FROM r LEFT JOIN f ON f.vec_id = r.vec_id AND f.x = r.x AND f.y = r.y AND f.z = r.z"
)
def fill_holes(spark, sf_dir):
    edge = lambda i: (F.floor(i / 16).isin(0, 3)) | ((F.floor(i / 4) % 4).isin(0, 3)) | ((i % 4).isin(0, 3))
    ring = F.transform("v", lambda v, i: F.when(edge(i), v > -0.12).otherwise(v > 0.12).cast("int"))
    masks = volumes(spark, sf_dir).select("vec_id", ring.alias("mask"))
    return voxels(V.fill_holes(masks, "mask", SHAPE), "vec_id", F.col("mask"), "filled")


@query(
    "WITH e AS (SELECT vec_id, list_transform(embedding[1:6], lambda x: CAST(x AS DOUBLE)) AS o FROM embeddings), n AS (SELECT vec_id, o[2] * o[6] - o[3] * o[5] AS a, o[3] * o[4] - o[1] * o[6] AS b, o[1] * o[5] - o[2] * o[4] AS c FROM e), "
    "u AS (SELECT vec_id, abs(a) / sqrt(a * a + b * b + c * c) AS a, abs(b) / sqrt(a * a + b * b + c * c) AS b, abs(c) / sqrt(a * a + b * b + c * c) AS c FROM n) "
    "SELECT vec_id, CASE WHEN greatest(a, b, c) < 0.8 THEN NULL WHEN a >= b AND a >= c THEN 'SAG' WHEN b >= c THEN 'COR' ELSE 'AX' END AS plane FROM u"
)
def plane_of_orientation(spark, sf_dir):
    return volumes(spark, sf_dir).select("vec_id", V.plane_of_orientation(F.slice("v", 1, 6)).alias("plane"))
