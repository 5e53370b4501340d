"""Grids, inverse transforms, resizing with a record and recorded chains over the volumes of volume_queries.py. Each with its SQL."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import functions as F

from voxloom.operators import kernels as G
from voxloom.operators import resampling as R
from voxloom.operators.registration import Search, register_pairs
from voxloom.plans.volume_queries import _VOX, SHAPE, query, volumes, voxels

#: Shape of the donors and of the fixed images, the target of resizing and its voxel sizes.
DONOR, TARGET, VOXEL = (5, 4, 3), (6, 5, 4), (1.0, 0.8, 1.5)


def _affine(first: int, diagonal: Sequence[float]):
    """An affine of the diagonal and the twelve entries of the vector from `first` on."""
    at = lambda k: F.get("v", F.lit(k))
    cells = [at(first + 4 * i + j) + (diagonal[i] if i == j else 0.0) for i in range(3) for j in range(4)]
    return R.numbers([*cells, 0.0, 0.0, 0.0, 1.0])


def _affine_sql(first: int, diagonal: Sequence[float]) -> str:
    cells = [f"o[{first + 4 * i + j + 1}] + {diagonal[i] if i == j else 0.0}::DOUBLE" for i in range(3) for j in range(4)]
    return f"[{', '.join(cells)}, 0.0, 0.0, 0.0, 1.0]"


OWN, OTHER, TURN = (0, (1.5, 1.25, 2.0)), (12, (2.0, -1.0, 1.0)), (24, (1.0, 1.0, 1.0))
_MAPS = f"m0 AS (SELECT vec_id, {_affine_sql(*OWN)} AS a, {_affine_sql(*OTHER)} AS b, {_affine_sql(*TURN)} AS t FROM (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS o FROM embeddings))"


def _product(a: str, b: str) -> str:
    return "[" + ", ".join(" + ".join(f"{a}[{4 * i + k + 1}] * {b}[{4 * k + j + 1}]" for k in range(4)) for i in range(4) for j in range(4)) + "]"


def _inverse(a: str) -> str:
    at = lambda i, j: f"{a}[{4 * (i % 3) + j % 3 + 1}]"
    minor = lambda i, j: f"({at(i + 1, j + 1)} * {at(i + 2, j + 2)} - {at(i + 1, j + 2)} * {at(i + 2, j + 1)})"
    size = f"({at(0, 0)} * {minor(0, 0)} + {at(0, 1)} * {minor(0, 1)} + {at(0, 2)} * {minor(0, 2)})"
    turn = [[f"{minor(j, i)} / {size}" for j in range(3)] for i in range(3)]
    shift = [f"-({turn[i][0]} * {a}[4] + {turn[i][1]} * {a}[8] + {turn[i][2]} * {a}[12])" for i in range(3)]
    return "[" + ", ".join(x for i in range(3) for x in (*turn[i], shift[i])) + ", 0.0, 0.0, 0.0, 1.0]"


def _sampled(name: str, source: str, shape: Sequence[int], maps: str, out: Sequence[int], places: Sequence[str], valid: str = "true", drawn: bool = True, order: int = 1) -> str:
    """A CTE with the volumes of `source` at places that are expressions of the output voxel (x, y, z) and the columns of `maps`."""
    n = out[0] * out[1] * out[2]
    axes = list(zip("xyz", "abc", shape, strict=True))
    inside = " AND ".join(f"p.{c} >= -0.5 AND p.{c} < {k - 0.5}" for _, c, k in axes) if drawn else "true"
    at = {c: f"least(greatest(p.{c}, 0), {k - 1})" if drawn else f"p.{c}" for _, c, k in axes}
    if order == 0:
        near, value = " AND ".join(f"s.{x} = floor(p.{c} + 0.5)" for x, c, _ in axes), "sum(s.v)"
    else:
        near, value = f"{inside} AND " + " AND ".join(f"abs(s.{x} - {at[c]}) < 1" for x, c, _ in axes), "sum(s.v * " + " * ".join(f"(1 - abs(s.{x} - {at[c]}))" for x, c, _ in axes) + ")"
    return (
        f"{name} AS (SELECT p.vec_id, p.i, p.x, p.y, p.z, coalesce({value}, 0) AS v FROM (SELECT vec_id, i, x, y, z, {', '.join(f'{e} AS {c}' for e, c in zip(places, 'abc', strict=True))}, {valid} AS ok FROM "
        f"(SELECT *, i // {out[1] * out[2]} AS x, (i // {out[2]}) % {out[1]} AS y, i % {out[2]} AS z FROM (SELECT *, CAST(unnest(range(0, {n})) AS INT) AS i FROM {maps}))) p "
        f"LEFT JOIN {source} s ON s.vec_id = p.vec_id AND p.ok AND {near} GROUP BY ALL)"
    )


def _linear(m: str) -> list[str]:
    return [f"{m}[{4 * k + 1}] * x + {m}[{4 * k + 2}] * y + {m}[{4 * k + 3}] * z + {m}[{4 * k + 4}]" for k in range(3)]


_WITH = _VOX + ", " + _MAPS + ", "
_ROWS = " SELECT vec_id, i, round(v, 6) + 0.0 AS v FROM {}"


def _grids(spark, sf_dir):
    """Volumes with their own affine, that of another grid and a transform."""
    return volumes(spark, sf_dir).select("vec_id", "v", "mask", _affine(*OWN).alias("a"), _affine(*OTHER).alias("b"), _affine(*TURN).alias("t"))


@query(_WITH + f"m1 AS (SELECT vec_id, a, b, {_inverse('a')} AS r FROM m0), m AS (SELECT vec_id, {_product('r', 'b')} AS m FROM m1), " + _sampled("d", "vox", SHAPE, "m", DONOR, _linear("m"), order=0) + _ROWS.format("d"))
def donor_grid(spark, sf_dir):
    return voxels(R.to_donor(_grids(spark, sf_dir), "v", R.grid(SHAPE, F.col("a")), R.grid(DONOR, F.col("b"))), "vec_id", F.col("v"), "v", 6)


_BACK = f"n1 AS (SELECT vec_id, a, {_inverse('b')} AS r, {_inverse('t')} AS u FROM m0), n2 AS (SELECT vec_id, a, {_product('r', 'u')} AS w FROM n1), n AS (SELECT vec_id, {_product('w', 'a')} AS m FROM n2), "


@query(_WITH + _BACK + _sampled("d", "vox", SHAPE, "n", DONOR, _linear("m")) + _ROWS.format("d"))
def inverse_transform(spark, sf_dir):
    back = R.inverse_transform_step(F.col("t"), R.grid(DONOR, F.col("a")), R.grid(SHAPE, F.col("b")))
    return voxels(R.through(_grids(spark, sf_dir), "v", [back]), "vec_id", F.col("v"), "v", 6)


#: Grids to be resized: voxel sizes by vec_id, the origin from the vector; the paddings that follow, and what is cut off.
_SIZES = ("1.0 + e.vec_id % 3 * 0.5", "1.0", "2.0 - e.vec_id % 2 * 1.75")
_RESIZE = (
    "r0 AS (SELECT vec_id, " + ", ".join(f"2 - (min({a}) + max({a})) // 2 AS s{a}" for a in "xyz") + " FROM vox WHERE m GROUP BY vec_id), "
    "r AS (SELECT *, " + ", ".join(f"(t{a} - z{a}) // 2 - CASE WHEN t{a} < z{a} AND (t{a} - z{a}) % 2 <> 0 THEN 1 ELSE 0 END AS p{a}" for a in "xyz") + " FROM (SELECT e.vec_id, "
    + ", ".join(f"coalesce(s{a}, 0) AS s{a}, CAST(greatest(1, round_even(4 * ({size}) / {v}, 0)) AS INT) AS z{a}, {t} AS t{a}" for a, size, v, t in zip("xyz", _SIZES, VOXEL, TARGET, strict=True))
    + " FROM embeddings e LEFT JOIN r0 ON r0.vec_id = e.vec_id)), "
)
_FORTH = [f"({a} - p{a}) * (CASE WHEN z{a} > 1 THEN 3 / (z{a} - 1) ELSE 0 END) - s{a}" for a in "xyz"]
_RESIZED = _RESIZE + _sampled("d", "vox", SHAPE, "r", TARGET, _FORTH, " AND ".join(f"{a} >= p{a} AND {a} < p{a} + z{a}" for a in "xyz"), False)
_UNSIZED = _sampled("f", "d", TARGET, "r", SHAPE, [f"({a} + s{a}) * ((z{a} - 1) / 3) + p{a}" for a in "xyz"], " AND ".join(f"{a} + s{a} BETWEEN 0 AND 3" for a in "xyz"), False)


def _sized(spark, sf_dir):
    rows = volumes(spark, sf_dir)
    size = [1.0 + F.col("vec_id") % 3 * 0.5, -1.0, 2.0 - F.col("vec_id") % 2 * 1.75]
    cells = [x for i in range(3) for x in (*[size[i] if i == j else 0.0 for j in range(3)], F.get("v", F.lit(i)))]
    return rows.select("vec_id", "mask", F.col("v").alias("voxels"), R.shape_of(SHAPE).alias("shape"), R.numbers([*cells, 0.0, 0.0, 0.0, 1.0]).alias("affine"))


@query(_VOX + ", " + _RESIZED + _ROWS.format("d"))
def resize_volumes(spark, sf_dir):
    return voxels(R.resize(_sized(spark, sf_dir), TARGET, VOXEL, roi="mask"), "vec_id", F.col("voxels"), "v", 6)


@query(
    _VOX + ", " + _RESIZE.rstrip(", ") + " SELECT r.vec_id, "
    + ", ".join(f"round(CAST(embedding[{k + 1}] AS DOUBLE) - p{a} * {v}, 6) + 0.0 AS origin_{a}, CAST(s{a} AS INT) AS center_{a}, CAST(p{a} AS INT) AS before_{a}, CAST(t{a} - z{a} - p{a} AS INT) AS after_{a}, {'-' if a == 'y' else ''}{v} AS size_{a}" for k, (a, v) in enumerate(zip("xyz", VOXEL, strict=True)))
    + " FROM r JOIN embeddings USING (vec_id)"
)
def resize_records(spark, sf_dir):
    out = R.resize(_sized(spark, sf_dir), TARGET, VOXEL, roi="mask").withColumn("r", R.from_json(F.col("record")))
    pad = lambda name, k, side: F.get(F.get(F.col(f"r.{name}"), F.lit(k)), F.lit(side))
    cell = lambda i, j: F.get("affine", F.lit(4 * i + j))
    columns = [c for k, a in enumerate("xyz") for c in ((F.round(cell(k, 3), 6) + 0.0).alias(f"origin_{a}"), pad("center_padding", k, 0).alias(f"center_{a}"), pad("shape_padding", k, 0).alias(f"before_{a}"), pad("shape_padding", k, 1).alias(f"after_{a}"), cell(k, k).alias(f"size_{a}"))]
    return out.select("vec_id", *columns)


@query(_VOX + ", " + _RESIZED + ", " + _UNSIZED + _ROWS.format("f"))
def resize_and_back(spark, sf_dir):
    return voxels(R.reverse_resize(R.resize(_sized(spark, sf_dir), TARGET, VOXEL, roi="mask")), "vec_id", F.col("voxels"), "v", 6)


def _chain(spark, sf_dir):
    """Each volume with its chain in JSON: a transform from the grid `a` to the grid `b`, then the record of a resizing."""
    rows = _grids(spark, sf_dir).withColumn("box", R.bounding_box(F.col("mask"), R.shape_of(SHAPE)))
    sizes = R.numbers([1.0 + F.col("vec_id") % 3 * 0.5, 0, 0, 0, 0, 1, 0, 0, 0, 0, 2.0 - F.col("vec_id") % 2 * 1.75, 0, 0, 0, 0, 1])
    record = R.resize_record(R.shape_of(SHAPE), sizes, TARGET, VOXEL, 1, R.center_padding(F.col("box"), R.shape_of(SHAPE)))
    first = F.struct(F.lit("transform").alias("kind"), F.col("t").alias("transform"), R.grid(SHAPE, F.col("b")).alias("fixed"), R.grid(SHAPE, F.col("a")).alias("moving"), F.lit(None).cast(R.RECORD).alias("padding"))
    none = F.lit(None)
    second = F.struct(F.lit("padding").alias("kind"), none.cast("array<double>").alias("transform"), none.cast(R.GRID).alias("fixed"), none.cast(R.GRID).alias("moving"), record.alias("padding"))
    return rows.select("vec_id", "v", F.to_json(F.array(first, second)).alias("chain"))


_THERE = f"n1 AS (SELECT vec_id, b, t, {_inverse('a')} AS r FROM m0), n2 AS (SELECT vec_id, r, {_product('t', 'b')} AS w FROM n1), n AS (SELECT vec_id, {_product('r', 'w')} AS m FROM n2), "


@query(_WITH + _THERE + _sampled("f", "vox", SHAPE, "n", SHAPE, _linear("m")) + ", " + _RESIZED.replace("LEFT JOIN vox s", "LEFT JOIN f s") + _ROWS.format("d"))
def record_chain(spark, sf_dir):
    return voxels(R.apply_chain(_chain(spark, sf_dir), "v", F.col("chain")), "vec_id", F.col("v"), "v", 6)


@query(
    _WITH + _BACK + _RESIZED + ", " + _UNSIZED + ", " + _sampled("g", "f", SHAPE, "n", SHAPE, _linear("m")) + _ROWS.format("g")
)
def record_chain_reversed(spark, sf_dir):
    """The resized volumes brought back through the reversed chain."""
    rows = _chain(spark, sf_dir)
    padding = F.from_json("chain", R.CHAIN)[1]["padding"]
    resized = R.through(rows, "v", [R.resize_step(padding)])
    return voxels(R.apply_chain(resized, "v", F.col("chain"), reverse=True), "vec_id", F.col("v"), "v", 6)


#: Sides of the registered volumes, and the steps of their voxels through the volume that both show.
SIDE, FINE = 8, 0.25


@query("SELECT count(*) AS pairs, true AS found FROM embeddings")
def register_translations(spark, sf_dir):
    """Each volume is shown finely twice, the second time shifted by halves of a voxel; in 98 of 100 pairs the shift must be found within a fifth of a voxel."""
    shift = [((F.col("vec_id") + k) % 5 - 2) * 0.5 for k in range(3)]
    shown = lambda by: G.step(G.numbers([x for k in range(3) for x in (*[FINE if j == k else 0.0 for j in range(3)], (by[k] * FINE if by else F.lit(0.0)) + 0.5)]), SHAPE, (SIDE,) * 3)
    rows = volumes(spark, sf_dir).select("vec_id", F.col("v").alias("fixed"), F.col("v").alias("moving"))
    rows = R.through(R.through(rows, "fixed", [shown(None)]), "moving", [shown(shift)])
    unit = R.grid((SIDE,) * 3, [float(i == j) for i in range(4) for j in range(4)])
    rows = rows.repartition(spark.sparkContext.defaultParallelism, "vec_id")  # costly rows of few bytes
    found = register_pairs(rows, "fixed", "moving", unit, unit, Search("translation", "correlation", iterations=40, step=0.5, least=0.01))
    off = [F.abs(F.get("transform", F.lit(4 * k + 3)) + shift[k]) for k in range(3)]
    return found.agg(F.count("*").alias("pairs"), (F.count_if(F.greatest(*off) <= 0.2) >= 0.98 * F.count("*")).alias("found"))
