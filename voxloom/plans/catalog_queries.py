"""Header and catalog operators. Each query with its SQL; header cases are dealt over the events, and their SQL lists what each must give, written out by hand."""

from __future__ import annotations

from pyspark.sql import functions as F

from voxloom.operators import catalog as C
from voxloom.functions import headers as H
from voxloom.operators import series as S
from voxloom.plans.metadata_queries import _table, dealt
from voxloom.plans.volume_queries import query, volumes


def expected(columns: str, rows: list[tuple]) -> str:
    one = lambda v: "NULL" if v is None else repr(v) if not isinstance(v, str) else "'" + v.replace("'", "''") + "'"
    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(one, r)) + ')' for r in rows)}) t({columns})"


def over_events(columns: str, rows: list[tuple]) -> str:
    """Every event with what its case must give."""
    return f"SELECT event_id, {columns.split(', ', 1)[1]} FROM ({expected(columns, rows)}) JOIN events ON event_id % {len(rows)} = id - 1"


#: id, acquisition date, time, content date, time, series date, time, study date, time; and what comes of it.
DATES = [
    (1, "20200131", "101530", None, None, None, None, None, None, "2020-01-31 10:15:30.000000"), (2, "20200131", "101530.25", None, None, None, None, None, None, "2020-01-31 10:15:30.250000"),
    (3, "20200131", "0930", None, None, None, None, None, None, "2020-01-31 00:09:30.000000"), (4, "20200131", None, None, None, None, None, None, None, "2020-01-31 00:00:00.000000"),
    (5, "2020-01-31", "101530", "20191231", "235959.999999", None, None, None, None, "2019-12-31 23:59:59.999999"), (6, None, None, "", "", "20200229", "1", None, None, "2020-02-29 00:00:01.000000"),
    (7, "20190229", "101530", None, None, None, None, "20180101", "", "2018-01-01 00:00:00.000000"), (8, "20200131", "256000", None, None, None, None, None, None, None),
    (9, None, None, None, None, None, None, None, None, None), (10, " 20200131 ", " 101530 ", None, None, None, None, None, None, "2020-01-31 10:15:30.000000"),
]


@query(over_events("id, taken", [(r[0], r[9]) for r in DATES]))
def parse_dt(spark, sf_dir):
    names = ["d1", "t1", "d2", "t2", "d3", "t3", "d4", "t4"]
    df = dealt(spark, sf_dir, [r[:9] for r in DATES], "id int, " + ", ".join(f"{n} string" for n in names))
    at = H.parse_dt(*[(F.col(f"d{k}"), F.col(f"t{k}")) for k in range(1, 5)])
    return df.select("event_id", F.date_format(at, "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("taken"))


#: id, tags; pulse sequence name, contrast agent, b-value.
HINTS = [
    (1, {"DiffusionBValue": "1000"}, None, None, 1000.0), (2, {"DiffusionBValue": "x", "DiffusionBFactor": "800.5"}, None, None, 800.5), (3, {"Private_0043_1039": "1000\\8\\0\\50"}, None, None, 50.0),
    (4, {"Private_0043_1039": "a, b", "Private_2001_1003": "700"}, None, None, 700.0), (5, {"PulseSequenceName": "", "SequenceName": "tfl3d"}, "tfl3d", None, None), (6, {"PulseSequenceName": "BRAVO", "SequenceName": "tfl3d"}, "BRAVO", None, None),
    (7, {"ContrastBolusAgent": "Gadavist", "DiffusionBValue": "0"}, None, "Gadavist", 0.0), (8, {}, None, None, None), (9, {"Philips_b_value": "5 10 15"}, None, None, 15.0),
]


@query(over_events("id, pulse_sequence_name, contrast_agent, b_value", [(r[0], *r[2:]) for r in HINTS]).replace("SELECT *", "SELECT id, pulse_sequence_name, contrast_agent, CAST(b_value AS DOUBLE) AS b_value"))
def vendor_hints(spark, sf_dir):
    df = dealt(spark, sf_dir, [r[:2] for r in HINTS], "id int, tags map<string,string>")
    found = H.vendor_hints(F.col("tags"))
    return df.select("event_id", *[found[n].alias(n) for n in ("pulse_sequence_name", "contrast_agent", "b_value")])


#: id, text; whole number, number, upper list, clean text.
SCALARS = [
    (1, "256", 256, 256.0, "256", "256"), (2, "256.0", None, 256.0, "256.0", "256.0"), (3, " -7 ", -7, -7.0, "-7", "-7"), (4, "1e3", None, 1000.0, "1E3", "1e3"), (5, "nan", None, None, "NAN", "nan"),
    (6, "", None, None, "", ""), (7, None, None, None, "", ""), (8, "Primary\\DERIVED^mip", None, None, "PRIMARY,DERIVED,MIP", "primary\\derived^mip"), (9, "  A  b;;c, d ", None, None, "A,B,C,D", "a b;;c, d"), (10, "inf", None, None, "INF", "inf"),
]


@query(over_events("id, whole, number, parts, clean", [(r[0], *r[2:]) for r in SCALARS]).replace("SELECT *", "SELECT id, CAST(whole AS BIGINT) AS whole, CAST(number AS DOUBLE) AS number, parts, clean"))
def safe_casts(spark, sf_dir):
    df = dealt(spark, sf_dir, [r[:2] for r in SCALARS], "id int, t string")
    return df.select("event_id", H.safe_int(F.col("t")).alias("whole"), H.safe_float(F.col("t")).alias("number"), F.array_join(H.upper_list(F.col("t")), ",").alias("parts"), H.clean_lower(F.col("t")).alias("clean"))


#: id, columns, rows, x, y, spacing, thickness; matrix, voxel text, z.
DISPLAY = [
    (1, 256, 320, 0.5, 0.5, 1.2, 5.0, "256x320", "0.50x0.50x1.20", 1.2), (2, None, 320, 0.456, 0.5, 0.0, 5.0, "?x320", "0.46x0.50x5.00", 5.0), (3, 256, None, 1.0, 2.0, None, None, "256x?", "1.00x2.00", None),
    (4, None, None, None, 2.0, None, 3.0, "?x?", None, 3.0), (5, 1, 1, 1.0, 1.0, None, 0.0, "1x1", "1.00x1.00", None),
]


@query(over_events("id, matrix, voxel_mm, z", [(r[0], *r[7:]) for r in DISPLAY]).replace("SELECT *", "SELECT id, matrix, voxel_mm, CAST(z AS DOUBLE) AS z"))
def display_fields(spark, sf_dir):
    df = dealt(spark, sf_dir, [r[:7] for r in DISPLAY], "id int, c int, r int, x double, y double, s double, t double")
    df = df.withColumn("z", H.first_nonzero(F.col("s"), F.col("t")))
    return df.select("event_id", H.matrix(F.col("c"), F.col("r")).alias("matrix"), H.voxel_mm(F.col("x"), F.col("y"), F.col("z")).alias("voxel_mm"), "z")


#: id, number, description, uid; the folder's name.
DIRNAMES = [(1, 3, "Ax T1 post-GAD", "1.2.3", "3_Ax_T1_post-GAD_"), (2, None, None, "1.2.3", "0_Series_"), (3, 0, " ", "1.2.4", "0_Series_"), (4, 7, "größe (mm)/x", "9", "7_größe_mm_x_")]


@query("SELECT event_id, name || substring(sha1(uid), 1, 6) AS dirname FROM (" + over_events("id, uid, name", [(r[0], r[3], r[4]) for r in DIRNAMES]) + ")")
def series_dirname_cases(spark, sf_dir):
    df = dealt(spark, sf_dir, [r[:4] for r in DIRNAMES], "id int, number int, description string, uid string")
    return df.select("event_id", H.series_dirname(F.col("number"), F.col("description"), F.col("uid")).alias("dirname"))


#: id, name; whether a localizer, its subtype.
LOCALIZERS = [
    (1, "3-plane Loc", True, None), (2, "AAHead_Scout_32ch", True, None), (3, "a ahead", True, None), (4, "Loc MPR_SAG", True, "MPR_SAG"), (5, "scout mprcor", True, "MPR_COR"), (6, "localizer mpr tra", True, "MPR_TRA"),
    (7, "scout xmpr", True, None), (8, "scout mpr", True, "MPR"), (9, "AX T1", False, None), (10, "block design", True, None), (11, "3plane", True, None), (12, "", False, None),
]


@query(over_events("id, localizer, subtype", [(r[0], *r[2:]) for r in LOCALIZERS]))
def localizer(spark, sf_dir):
    df = dealt(spark, sf_dir, [r[:2] for r in LOCALIZERS], "id int, name string").withColumn("t", S.name_tokens(F.col("name")))
    return df.select("event_id", F.col("t").rlike(S.LOCALIZER).alias("localizer"), S._localizer_subtype(F.col("t")).alias("subtype"))


#: id, name, image types; the categories of diffusion, susceptibility and perfusion, and whether derived (given the first of them).
CATEGORIES = [
    (1, "ADC map", "", "ADC", None, None, True), (2, "b1000", "ORIGINAL ADC", "ADC", None, None, True), (3, "brain FA", "", "FA", None, None, True), (4, "fast", "", None, None, None, False), (5, "trace w", "", "TRACE", None, None, True),
    (6, "isotropic", "ORIGINAL", "TRACE", None, None, False), (7, "avdc", "", "AvDC", None, None, True), (8, "expatten", "", "EXP_ATTEN", None, None, True), (9, "swi minip", "", None, "MINIP", None, True), (10, "swi mip", "", None, "MIP", None, True),
    (11, "swi phase", "", None, "PHASE", None, True), (12, "magnitude", "", None, "MAG", None, True), (13, "qsm", "", None, "QSM", None, True), (14, "rCBV", "", None, None, "CBV", True), (15, "rCBF asl", "", None, None, "CBF", True),
    (16, "MTT", "", None, None, "MTT", True), (17, "ttp", "", None, None, "TTP", True), (18, "Tmax", "", None, None, "TMAX", True), (19, "ktrans", "", None, None, "KTRANS", True), (20, "k-trans", "", None, None, "KTRANS", True),
    (21, "kep", "", None, None, "KEP", True), (22, "waves", "", None, None, "VE", True), (23, "vp", "", None, None, "VP", True), (24, "leakage", "", None, None, "LEAKAGE", True), (25, "parametric", "", None, None, "PARAM_MAP", True),
    (26, "pbp", "", None, None, "PBP", True), (27, "gbp", "", None, None, "GBP", True), (28, "pwi", "MIP", None, "MIP", "PROJECTION", True), (29, "ax slab", "", None, None, None, True), (30, "projection", "ORIGINAL", None, None, None, False),
    (31, "plain", "DERIVED", None, None, None, True), (32, "plain", "PRIMARY", None, None, None, False), (33, "plain", "", None, None, None, False), (34, "pwi", "minip", None, "MINIP", "PROJECTION", True),
]


@query(over_events("id, dwi, swi, perfusion, derived", [(r[0], *r[3:]) for r in CATEGORIES]))
def derived_category(spark, sf_dir):
    df = dealt(spark, sf_dir, [r[:3] for r in CATEGORIES], "id int, name string, kinds string").withColumn("t", S.name_tokens(F.col("name")))
    t, types = F.col("t"), H.upper_list(F.col("kinds"))
    found = [S.category(t, types, rules) for rules in (S.DWI_CATEGORIES, S.SWI_CATEGORIES, S.PERFUSION_CATEGORIES)]
    return df.select("event_id", *[c.alias(n) for c, n in zip(found, ("dwi", "swi", "perfusion"), strict=True)], S.is_derived(t, types, F.coalesce(*found)).alias("derived"))


#: id, name; its plane and base label by name alone.
NAMES = [
    (1, "AX_T1", "AX"), (2, "axial", "AX"), (3, "sag-t2", "SAG"), (4, "Sagittal", "SAG"), (5, "cor", "COR"), (6, "Coronal ax", "AX"), (7, "t2 tra", "AX"), (8, "tra cor", "COR"), (9, "oblique", "OBL"), (10, "max", None), (11, "relax sagging", None), (12, None, None),
]


@query(over_events("id, plane", [(r[0], r[2]) for r in NAMES]))
def detect_plane_cases(spark, sf_dir):
    df = dealt(spark, sf_dir, [r[:2] for r in NAMES], "id int, name string")
    return df.select("event_id", S.first_rule(S.name_tokens(F.col("name")), S.PLANE_RULES).alias("plane"))


@query(
    "WITH e AS (SELECT vec_id, vec_id // 8 AS series, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS o FROM embeddings), "
    "n AS (SELECT vec_id, series, o, o[2] * o[6] - o[3] * o[5] AS a, o[3] * o[4] - o[1] * o[6] AS b, o[1] * o[5] - o[2] * o[4] AS c FROM e), "
    "u AS (SELECT series, o, a / sqrt(a * a + b * b + c * c) AS a, b / sqrt(a * a + b * b + c * c) AS b, c / sqrt(a * a + b * b + c * c) AS c FROM n), "
    "m AS (SELECT series, avg(a) AS a, avg(b) AS b, avg(c) AS c FROM u GROUP BY series), k AS (SELECT series, a / sqrt(a * a + b * b + c * c) AS a, b / sqrt(a * a + b * b + c * c) AS b, c / sqrt(a * a + b * b + c * c) AS c FROM m), "
    "p AS (SELECT u.series, u.o[7] * k.a + u.o[8] * k.b + u.o[9] * k.c AS p FROM u JOIN k USING (series)), d AS (SELECT series, p - lag(p) OVER (PARTITION BY series ORDER BY p) AS d FROM p) "
    "SELECT series, round(median(d), 6) AS z_spacing FROM d WHERE d > 0 GROUP BY series"
)
def z_spacing_projected(spark, sf_dir):
    """Eight volumes are a series; entries 1 to 6 are direction cosines, 7 to 9 the position."""
    slices = volumes(spark, sf_dir).select(F.floor(F.col("vec_id") / 8).alias("series"), F.slice("v", 1, 6).alias("iop"), F.slice("v", 7, 3).alias("ipp"))
    return S.z_spacing(slices, "series", F.col("iop"), F.col("ipp")).select("series", F.round("z_spacing", 6).alias("z_spacing"))


@query("SELECT vec_id, (row_number() OVER (ORDER BY vec_id) - 1) // 32 AS batch FROM embeddings")
def batching(spark, sf_dir):
    return C.batches(_table(spark, sf_dir, "embeddings").select("vec_id"), "vec_id", 32)


@query("SELECT a.p AS position, s_suppkey, c_custkey FROM (SELECT s_suppkey, row_number() OVER (ORDER BY s_suppkey) - 1 AS p FROM supplier) a JOIN (SELECT c_custkey, row_number() OVER (ORDER BY c_custkey) - 1 AS p FROM customer) b ON a.p = b.p")
def positional_zip(spark, sf_dir):
    return C.zipped(_table(spark, sf_dir, "supplier").select("s_suppkey"), "s_suppkey", _table(spark, sf_dir, "customer").select("c_custkey"), "c_custkey", strict=False)


@query("SELECT p_partkey FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 45)")
def missing_models(spark, sf_dir):
    existing = _table(spark, sf_dir, "lineitem").where("l_quantity > 45").select(F.col("l_partkey").alias("p_partkey"))
    return C.missing(_table(spark, sf_dir, "part").select("p_partkey"), existing, "p_partkey")


@query("SELECT o_orderkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R')")
def skip_existing(spark, sf_dir):
    done = _table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return C.without_outputs(_table(spark, sf_dir, "orders").select("o_orderkey"), done, "o_orderkey")


@query("SELECT c_custkey, string_split(replace(c_name, '#', '_') || '_' || c_mktsegment, '_')[1] AS patient, CASE WHEN c_nationkey > 10 THEN 'given' ELSE string_split(replace(c_name, '#', '_') || '_' || c_mktsegment, '_')[2] END AS timepoint, string_split(replace(c_name, '#', '_') || '_' || c_mktsegment, '_')[3] AS scan FROM customer")
def filename_fields(spark, sf_dir):
    name = F.concat_ws("_", F.replace("c_name", F.lit("#"), F.lit("_")), "c_mktsegment")
    given = F.when(F.col("c_nationkey") > 10, "given")
    return _table(spark, sf_dir, "customer").select("c_custkey", H.file_field(name, 0).alias("patient"), H.file_field(name, 1, given).alias("timepoint"), H.file_field(name, 2).alias("scan"))


@query("SELECT page_id, CASE WHEN contains(url, '/en/') THEN replace(url, '/en/', '/seg/') WHEN contains(url, 'a') THEN replace(url, 'a', '_a') ELSE url END AS target FROM pages")
def replace_suffix(spark, sf_dir):
    return _table(spark, sf_dir, "pages").select("page_id", H.replace_first_of(F.col("url"), [("/en/", "/seg/"), ("a", "_a")]).alias("target"))


@query("SELECT page_id, regexp_extract(url, '^(.*)/[^/]*$', 1) AS folder, string_split(url, '/')[-1] AS name, lower(regexp_extract(string_split(url, '/')[-1], '^.+(\\.[^.]*)$', 1)) AS ext FROM pages")
def path_parts(spark, sf_dir):
    return _table(spark, sf_dir, "pages").select("page_id", *[c.alias(n) for n, c in H.path_parts(F.col("url")).items()])


@query("SELECT page_id, url GLOB '*/en/*' OR url GLOB '*[0-3]' OR contains(url, 'net') AS hit FROM pages")
def matches_any(spark, sf_dir):
    return _table(spark, sf_dir, "pages").select("page_id", H.any_of([S.matches(F.col("url"), p) for p in ("*/en/*", "*[0-3]", "net")]).alias("hit"))


@query(
    "WITH f AS (SELECT regexp_extract(url, '^(.*)/[^/]*$', 1) AS folder, string_split(url, '/')[-1] AS name FROM pages), r AS (SELECT *, row_number() OVER (PARTITION BY folder ORDER BY name) AS k FROM f) "
    "SELECT folder, min(name) AS first, count(*) AS n, string_agg(name, ',' ORDER BY name) FILTER (k <= 3) AS some FROM r GROUP BY folder"
)
def folder_scan(spark, sf_dir):
    return C.folders(_table(spark, sf_dir, "pages"), F.col("url"))


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_returnflag, l_returnflag || CASE WHEN k = 1 THEN '' ELSE '-' || k END AS dst FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_returnflag ORDER BY l_linenumber, l_partkey, l_suppkey) AS k FROM (SELECT DISTINCT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_returnflag FROM lineitem))")
def demix_log(spark, sf_dir):
    leaves = _table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag").distinct()
    leaves = leaves.withColumn("o", F.struct("l_linenumber", "l_partkey", "l_suppkey"))
    return C.numbered(leaves, ["l_orderkey"], "l_returnflag", "o").drop("o").withColumnRenamed("unique_name", "dst")


@query(
    "WITH a AS (SELECT o_custkey, min(nullif(o_orderstatus, 'P')) AS status, min(CAST(o_orderkey AS VARCHAR)) AS entry FROM orders WHERE o_orderpriority LIKE '1%' GROUP BY 1), b AS (SELECT o_custkey, min(o_orderstatus) AS status, min(CAST(o_orderkey AS VARCHAR)) AS entry FROM orders WHERE o_orderpriority LIKE '2%' GROUP BY 1), "
    "c AS (SELECT DISTINCT o_custkey FROM orders WHERE o_orderpriority LIKE '3%') SELECT coalesce(a.o_custkey, b.o_custkey, c.o_custkey) AS o_custkey, coalesce(a.status, b.status) AS status, coalesce(a.entry, b.entry) AS entry FROM a FULL JOIN b ON a.o_custkey = b.o_custkey FULL JOIN c ON coalesce(a.o_custkey, b.o_custkey) = c.o_custkey"
)
def combine_previous(spark, sf_dir):
    orders = _table(spark, sf_dir, "orders")
    of = lambda p: orders.where(F.col("o_orderpriority").startswith(p))
    one = of("1").select("o_custkey", F.when(F.col("o_orderstatus") != "P", F.col("o_orderstatus")).otherwise("").alias("status"), F.col("o_orderkey").alias("entry"))
    two = of("2").select("o_custkey", F.col("o_orderstatus").alias("status"), F.col("o_orderkey").alias("entry"))
    return C.combined([one, two, of("3").select("o_custkey")], "o_custkey", ["status", "entry"])


@query("SELECT page_id, coalesce('https://models/' || s_name, '') AS url, sha256(html) AS sha256 FROM pages LEFT JOIN supplier ON s_suppkey = page_id")
def manifest_urls(spark, sf_dir):
    urls = _table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("page_id"), F.concat(F.lit("https://models/"), "s_name").alias("u"))
    return _table(spark, sf_dir, "pages").join(urls, "page_id", "left").select("page_id", F.coalesce("u", F.lit("")).alias("url"), F.sha2("html", 256).alias("sha256"))


@query("SELECT user_id, round(avg(value), 6) AS loss FROM events GROUP BY user_id")
def mean_loss(spark, sf_dir):
    return _table(spark, sf_dir, "events").groupBy("user_id").agg(F.round(F.avg("value"), 6).alias("loss"))


@query("SELECT event_id, CASE WHEN event_id % 7 = 0 THEN value ELSE CAST(json_extract_string(props, '$.k') AS DOUBLE) END AS weight FROM events")
def fallback_weights(spark, sf_dir):
    """A given weight unless it is NaN or null, then the computed one."""
    given = F.when(F.col("event_id") % 7 == 0, F.col("value")).when(F.col("event_id") % 7 == 1, F.lit(float("nan")))
    computed = F.get_json_object("props", "$.k").try_cast("double")
    return _table(spark, sf_dir, "events").select("event_id", F.coalesce(F.nanvl(given, F.lit(None).cast("double")), computed).alias("weight"))


@query("SELECT user_id, event_id, CASE WHEN event_id % 3 = 0 THEN NULL ELSE event_type END AS kind, list_sort(list_distinct([event_type] || CASE WHEN value > 100 THEN ['HIGH'] ELSE [] END))[1] AS least_token FROM events")
def token_union(spark, sf_dir):
    union = F.array_union(F.array("event_type"), F.when(F.col("value") > 100, F.array(F.lit("HIGH"))).otherwise(F.array().cast("array<string>")))
    return _table(spark, sf_dir, "events").select("user_id", "event_id", F.when(F.col("event_id") % 3 != 0, F.col("event_type")).alias("kind"), F.array_min(union).alias("least_token"))
