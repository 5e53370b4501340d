"""Series, catalog and demix operators over the driver's tables. Each query with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from voxloom.functions import headers as H
from voxloom.operators import catalog as C
from voxloom.operators import series as S
from voxloom.plans.volume_queries import query

#: A series for each base type by name, echo or repetition time.
SERIES = [
    (1, "3-plane Localizer", 5.0, 100.0), (2, "AX DWI_b1000", 80.0, 5000.0), (3, "Ax SWAN 3D", 25.0, 50.0), (4, "COR DSC-perf", 30.0, 1500.0),
    (5, "Sag T2 FLAIR", 120.0, 9000.0), (6, "AXIAL T2_TSE", 90.0, 4000.0), (7, "AX T1 post GAD", 10.0, 600.0), (8, "Sag MPRAGE", 3.0, 2300.0),
    (9, "tra series", 95.0, 3000.0), (10, "oblique", 12.0, 700.0), (11, "unnamed", 40.0, 1500.0), (12, None, None, None),
]
_VALUES = "VALUES " + ", ".join("(" + ", ".join("NULL" if v is None else repr(v) for v in row) + ")" for row in SERIES)
_TOKENS = r"regexp_replace(lower(trim(regexp_replace(coalesce(name, ''), '\s+', ' ', 'g'))), '[_-]+', ' ', 'g')"
_SERIES = f"WITH s AS (SELECT event_id, {_TOKENS} AS tokens, te, tr FROM ({_VALUES}) t(no, name, te, tr) JOIN events ON event_id % {len(SERIES)} = no - 1) "


def _rule_sql(rules):
    return "CASE " + " ".join(f"WHEN regexp_matches(tokens, '{p}') THEN '{label}'" for p, label in rules) + " END"


def _table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dealt(spark, sf_dir, cases, schema):
    """Every event with one of the cases, whose `id` counts from 1: event k gets case k % n + 1."""
    known = F.broadcast(spark.createDataFrame(cases, schema))
    return _table(spark, sf_dir, "events").select("event_id").join(known, F.col("event_id") % len(cases) == F.col("id") - 1).drop("id")


def _series(spark, sf_dir):
    df = dealt(spark, sf_dir, SERIES, "id int, name string, te double, tr double")
    return df.select("event_id", S.name_tokens(F.col("name")).alias("tokens"), "te", "tr")


@query(_SERIES + f"SELECT event_id, {_rule_sql(S.PLANE_RULES)} AS plane FROM s")
def detect_plane(spark, sf_dir):
    return _series(spark, sf_dir).select("event_id", S.first_rule(F.col("tokens"), S.PLANE_RULES).alias("plane"))


@query(_SERIES + f", b AS (SELECT *, {_rule_sql(S.BASE_RULES)} AS named, CASE WHEN te >= 80 AND tr >= 2000 THEN 'T2w' WHEN te > 0 AND te <= 20 AND tr > 0 AND tr <= 1000 THEN 'T1' END AS timed FROM s) SELECT event_id, coalesce(named, timed) AS base_type, CASE coalesce(named, timed, 'Unknown') WHEN 'T1' THEN CASE WHEN named IS NOT NULL AND regexp_matches(tokens, '{S.POST}') THEN 'T1c' ELSE 'T1n' END WHEN 'T2f' THEN 'T2-FLAIR' ELSE coalesce(named, timed, 'Unknown') END AS final_label FROM b")
def classify_series(spark, sf_dir):
    return S.classify(_series(spark, sf_dir)).select("event_id", "base_type", "final_label")


#: Fixed values, one or more for each rule and branch: id, exam, name, minute, te, tr, b, image types, contrast agent, acquisition contrast, sequence name.
CASCADE = [
    (1, "a", "3-plane Localizer", 0, 5.0, 100.0, None, None, None, None, None), (2, "a", "Loc MPR_SAG", 1, None, None, None, "DERIVED", None, None, None), (3, "a", "AAhead_Scout MPR", 2, None, None, None, None, None, None, None),
    (4, "a", "3 plane fiesta", 2, None, None, None, "ORIGINAL", None, None, None), (5, "a", "AX DWI_b1000", 3, 80.0, 5000.0, 1000.0, None, None, None, None), (6, "a", "unnamed", 3, 80.0, 5000.0, 800.0, None, None, None, "ep_se"),
    (7, "a", "unnamed", 3, 80.0, 5000.0, 0.0, "DERIVED ADC", None, None, None), (8, "a", "eADC map", 3, None, None, None, None, None, None, None), (9, "a", "brain FA color", 3, None, None, None, None, None, None, None),
    (10, "a", "isotropic image", 3, None, None, None, None, None, None, None), (11, "a", "Exp-Atten", 3, None, None, None, "PRIMARY", None, None, None), (12, "a", "AvDC", 3, None, None, None, None, None, None, None),
    (13, "a", "Ax SWAN 3D", 4, 25.0, 50.0, None, "MINIP", None, None, None), (14, "a", "SWI mIP", 4, None, None, None, None, None, None, None), (15, "a", "suscept", 4, None, None, None, "phase", None, None, None),
    (16, "a", "SWI Filt_Pha", 4, None, None, None, None, None, None, None), (17, "a", "venogram QSM", 4, None, None, None, None, None, None, None), (18, "a", "swan magnitude", 4, None, None, None, None, None, None, None),
    (19, "a", "COR DSC-perf", 10, 30.0, 1500.0, None, None, None, None, None), (20, "a", "pcasl CBF", 11, None, None, None, None, None, None, None), (21, "a", "DCE k-trans", 11, None, None, None, None, None, None, None),
    (22, "a", "pwi", 11, None, None, None, "ORIGINAL MIP", None, None, None), (23, "a", "perfusion curve", 11, None, None, None, None, None, None, None), (24, "a", "Sag T2 FLAIR", 5, 120.0, 9000.0, None, None, None, None, None),
    (25, "a", "AXIAL T2_TSE slab", 5, 90.0, 4000.0, None, None, None, None, None), (26, "a", "AX T1", 5, 10.0, 600.0, None, None, None, None, None), (27, "a", "AX T1", 10, 10.0, 600.0, None, None, None, None, None),
    (28, "a", "AX T1", 12, 10.0, 600.0, None, None, None, None, None), (29, "a", "AX T1 mip", 12, 10.0, 600.0, None, "PRIMARY SECONDARY", None, None, None), (30, "a", "tra series", 12, 95.0, 3000.0, None, None, None, None, None),
    (31, "a", "oblique", 12, 12.0, 700.0, None, None, None, None, None), (32, "a", "oblique", 4, 12.0, 700.0, None, None, None, None, None), (33, "a", "oblique", None, 12.0, 700.0, None, None, None, None, None),
    (34, "b", "AX T1 post GAD", 20, 10.0, 600.0, None, None, None, None, None), (35, "b", "Sag MPRAGE", 5, 3.0, 2300.0, None, None, "Gadavist", None, None), (36, "b", "Sag T1", 5, 3.0, 2300.0, None, None, "", "contrast", None),
    (37, "b", "Sag T1", 5, 3.0, 2300.0, None, None, "", "T1", "*TFL3d1"), (38, "b", "Ax BRAVO", 21, None, None, None, None, None, None, None), (39, "b", "unnamed", 5, 40.0, 1500.0, None, "derived SECONDARY", None, None, None),
    (40, "b", "projection", 5, None, None, None, None, None, None, None), (41, "b", "unnamed", 5, 40.0, 1500.0, None, "ORIGINAL", None, None, None), (42, "c", "AX T1", 30, 10.0, 600.0, None, None, None, None, None),
    (43, None, "AX T1 c+", 1, None, None, None, None, None, None, None), (44, None, "AX T1", 2, None, None, None, None, None, None, None), (45, "c", None, None, None, None, None, None, None, None, None),
]
_CASCADE_VALUES = "VALUES " + ", ".join("(" + ", ".join("NULL" if v is None else repr(v) for v in row) + ")" for row in CASCADE)
#: Each run of events through all cases has exams of its own. The patterns stand here a second time, written for themselves.
_CASCADE_SQL = rf"""WITH s AS (SELECT event_id AS id, exam || '-' || event_id // {len(CASCADE)} AS exam, {_TOKENS} AS t, TIMESTAMP '2020-01-01' + to_minutes(CAST(m AS BIGINT)) AS acq, CAST(te AS DOUBLE) AS te, CAST(tr AS DOUBLE) AS tr, CAST(b AS DOUBLE) AS b,
  CASE WHEN kinds IS NULL THEN CAST([] AS VARCHAR[]) ELSE list_sort(string_split(upper(kinds), ' ')) END AS k, coalesce(agent, '') AS agent, coalesce(upper(ac), '') AS ac, lower(coalesce(sq, '')) AS sq
  FROM ({_CASCADE_VALUES}) v(no, exam, name, m, te, tr, b, kinds, agent, ac, sq) JOIN events ON event_id % {len(CASCADE)} = no - 1),
x AS (SELECT exam, coalesce(min(acq) FILTER (regexp_matches(t, 'perfusion|pwi|dsc|dce|asl')), min(acq) FILTER (regexp_matches(t, 'post|c\+|gad|with contrast|w/ contrast|t1c'))) AS t0 FROM s GROUP BY exam),
a AS (SELECT s.*, coalesce(acq > t0, false) AS late, agent <> '' OR contains(ac, 'CONTRAST') AS vendor, regexp_matches(t, 'post|c\+|gad|with contrast|w/ contrast|t1c') AS named,
  regexp_matches(t || ' ' || sq, 'spgr|bravo|mprage|mp rage|vibe|spoiled|t1 ?cube|tfl') AS fast,
  CASE WHEN contains(t, 'adc') OR list_contains(k, 'ADC') THEN 'ADC' WHEN regexp_matches(t, '\bfa\b') OR list_contains(k, 'FA') THEN 'FA' WHEN regexp_matches(t, 'trace|isotropic') OR list_contains(k, 'ISO') THEN 'TRACE'
    WHEN contains(t, 'avdc') THEN 'AvDC' WHEN regexp_matches(t, 'exp ?atten') THEN 'EXP_ATTEN' END AS dwi,
  CASE WHEN regexp_matches(t, 'min ?ip') THEN 'MINIP' WHEN contains(t, 'mip') THEN 'MIP' WHEN contains(t, 'pha') THEN 'PHASE' WHEN contains(t, 'mag') THEN 'MAG' WHEN regexp_matches(t, 'swi|swan') THEN NULL WHEN contains(t, 'qsm') THEN 'QSM'
    WHEN list_contains(k, 'MINIP') THEN 'MINIP' WHEN list_contains(k, 'MIP') THEN 'MIP' WHEN list_contains(k, 'PHASE') THEN 'PHASE' WHEN list_contains(k, 'MAGNITUDE') THEN 'MAG' END AS swi,
  CASE WHEN contains(t, 'cbv') THEN 'CBV' WHEN contains(t, 'cbf') THEN 'CBF' WHEN contains(t, 'mtt') THEN 'MTT' WHEN contains(t, 'ttp') THEN 'TTP' WHEN contains(t, 'tmax') THEN 'TMAX' WHEN regexp_matches(t, 'k ?trans') THEN 'KTRANS'
    WHEN contains(t, 'kep') THEN 'KEP' WHEN contains(t, 've') THEN 'VE' WHEN contains(t, 'vp') THEN 'VP' WHEN contains(t, 'leakage') THEN 'LEAKAGE' WHEN contains(t, 'parametric') THEN 'PARAM_MAP' WHEN contains(t, 'pbp') THEN 'PBP'
    WHEN contains(t, 'gbp') THEN 'GBP' WHEN list_has_any(k, ['MIP', 'MINIP']) THEN 'PROJECTION' END AS perf,
  CASE WHEN regexp_matches(t, '\bmpr ?sag\b') THEN 'MPR_SAG' WHEN regexp_matches(t, '\bmpr ?cor\b') THEN 'MPR_COR' WHEN regexp_matches(t, '\bmpr ?tra\b') THEN 'MPR_TRA' WHEN regexp_matches(t, '(^|[^a-z])mpr\b') THEN 'MPR' END AS loc
  FROM s LEFT JOIN x ON x.exam = s.exam),
r AS (SELECT *, CASE WHEN regexp_matches(t, 'scout|a ?ahead|3 ?plane|loc') THEN 1 WHEN dwi IS NOT NULL OR regexp_matches(t, 'dwi|diff|ep2d|ep b|trace') OR b > 0 THEN 2 WHEN regexp_matches(t, 'swi|swan|suscept|venogr') THEN 3
  WHEN regexp_matches(t, 'perfusion|pwi|dsc|dce|asl') THEN 4 WHEN contains(t, 'flair') THEN 5 WHEN contains(t, 't2') THEN 6 WHEN regexp_matches(t, 't1|mprage|bravo|spgr|vibe') THEN 7 WHEN te >= 80 AND tr >= 2000 THEN 8
  WHEN te > 0 AND te <= 20 AND tr > 0 AND tr <= 1000 THEN 9 ELSE 10 END AS n FROM a),
c AS (SELECT *, CASE n WHEN 1 THEN loc WHEN 2 THEN dwi WHEN 3 THEN swi WHEN 4 THEN perf WHEN 7 THEN CASE WHEN contains(t, 'mip') THEN 'MIP' WHEN contains(t, 'minip') THEN 'MINIP' END END AS cat,
  (n = 7 AND (named OR vendor OR late)) OR (n = 9 AND late) AS post FROM r),
d AS (SELECT *, CASE WHEN len(k) > 0 THEN list_has_any(k, ['DERIVED', 'SECONDARY', 'REFORMATTED', 'RESAMPLED', 'MPR', 'MIP', 'MINIP', 'T2_STAR', 'TRACEW', 'ADC', 'FA', 'EXP_ATTEN', 'AVDC', 'AVERAGE', 'MINIMUM', 'MAXIMUM', 'SUBTRACTION'])
  ELSE cat IS NOT NULL OR regexp_matches(t, '\bmip\b|\bminip\b|project|slab') END AS derived FROM c)
SELECT id AS event_id, CASE n WHEN 1 THEN 'Localizer' WHEN 2 THEN 'DWI' WHEN 3 THEN 'SWI' WHEN 4 THEN 'Perfusion' WHEN 5 THEN 'T2f' WHEN 6 THEN 'T2w' WHEN 7 THEN 'T1' WHEN 8 THEN 'T2w' WHEN 9 THEN 'T1' END AS base_type,
  CASE n WHEN 1 THEN 'Localizer' WHEN 2 THEN 'DWI' WHEN 3 THEN 'SWI' WHEN 4 THEN 'Perfusion' WHEN 5 THEN 'T2-FLAIR' WHEN 6 THEN 'T2w' WHEN 8 THEN 'T2w' WHEN 10 THEN CASE WHEN derived THEN 'Unknown-derived' ELSE 'Unknown' END
    ELSE CASE WHEN post THEN 'T1c' ELSE 'T1n' END END || coalesce('(' || cat || ')', '') AS final_label,
  post AS is_postcontrast, n = 5 AS is_flair, derived AS is_derived,
  CAST(CASE WHEN n IN (1, 2, 3) THEN CASE WHEN cat IS NULL THEN 0.9 ELSE 0.95 END WHEN n = 4 THEN CASE WHEN cat IS NULL THEN 0.85 ELSE 0.9 END WHEN n = 5 THEN 0.9 WHEN n = 6 THEN 0.8
    WHEN n = 7 THEN CASE WHEN fast THEN 0.85 WHEN post THEN 0.8 ELSE 0.7 END WHEN n = 8 THEN 0.7 WHEN n = 9 THEN 0.65 ELSE 0.3 END AS DOUBLE) AS confidence,
  concat_ws('; ', CASE WHEN len(k) > 0 THEN 'ImageType=' || array_to_string(k, ',') END, 'b_value=' || CAST(b AS VARCHAR), CASE WHEN n = 3 AND contains(t, 'swan') THEN 'SWI subtype=SWAN' END,
    CASE WHEN n = 1 THEN 'Localizer family; subtype=' || coalesce(cat, 'None')
      WHEN n IN (2, 3, 4) THEN CASE n WHEN 2 THEN 'DWI' WHEN 3 THEN 'SWI' ELSE 'Perfusion' END || ' family; derived=' || CASE WHEN derived THEN 'True' ELSE 'False' END || '; dcat=' || coalesce(cat, 'None')
      WHEN n = 5 THEN 'FLAIR in name' WHEN n = 6 THEN 'T2 token' WHEN n = 7 AND named THEN 'explicit post-contrast tokens' WHEN n = 7 AND vendor THEN 'vendor contrast present (agent=''' || agent || ''' or AcquisitionContrast)'
      WHEN n = 7 AND late THEN 'acquired after inferred contrast time' WHEN n = 8 THEN 'TE/TR suggest T2 (TE=' || te || ', TR=' || tr || ')' WHEN n = 9 THEN 'TE/TR suggest T1 (TE=' || te || ', TR=' || tr || ')'
      WHEN n = 10 THEN 'No strong name/physics cues' END,
    CASE WHEN n = 7 AND fast THEN 'FSPGR-like sequence' END, CASE WHEN n = 9 AND late THEN 'timing upgrade to post-contrast' END) AS reason FROM d"""


@query(_CASCADE_SQL)
def classify_cascade(spark, sf_dir):
    df = dealt(spark, sf_dir, CASCADE, "id int, exam string, name string, m int, te double, tr double, b_value double, kinds string, contrast_agent string, acquisition_contrast string, sequence_name string")
    at = F.to_timestamp(F.lit("2020-01-01")) + F.make_interval(mins=F.col("m"))
    df = df.withColumn("exam", F.concat("exam", F.lit("-"), F.floor(F.col("event_id") / len(CASCADE)).cast("string")))
    df = df.withColumn("tokens", S.name_tokens(F.col("name"))).withColumn("acq_dt", at).withColumn("image_types", F.split("kinds", " "))
    return S.classify(df).select("event_id", "base_type", "final_label", "is_postcontrast", "is_flair", "is_derived", "confidence", "reason")


@query(r"SELECT doc_id, lower(trim(regexp_replace(regexp_replace(regexp_replace(text, '\^', ' ', 'g'), '[^A-Za-z0-9\s'']', ' ', 'g'), '\s+', ' ', 'g'))) AS name FROM documents")
def normalize_name(spark, sf_dir):
    return _table(spark, sf_dir, "documents").select("doc_id", S.person_name(F.col("text")).alias("name"))


@query("SELECT p_partkey, regexp_replace(lower(trim(p_name)), '[_-]+', ' ', 'g') AS tokens FROM part")
def name_tokens(spark, sf_dir):
    return _table(spark, sf_dir, "part").select("p_partkey", S.name_tokens(F.col("p_name")).alias("tokens"))


@query("SELECT event_id, concat(CAST(user_id AS VARCHAR), '_', regexp_replace(event_type || '-x y', '[^A-Za-z0-9_\\-]+', '_', 'g'), '_', substring(sha1(CAST(event_id AS VARCHAR)), 1, 6)) AS dirname FROM events")
def series_dirname(spark, sf_dir):
    name = H.series_dirname(F.col("user_id"), F.concat("event_type", F.lit("-x y")), F.col("event_id").cast("string"))
    return _table(spark, sf_dir, "events").select("event_id", name.alias("dirname"))


@query("WITH t AS (SELECT user_id, coalesce(min(ts) FILTER (event_type = 'purchase'), min(ts) FILTER (event_type = 'signup')) AS t0 FROM events GROUP BY user_id) SELECT event_id, t0, coalesce(ts > t0, false) AS is_after FROM events JOIN t USING (user_id)")
def contrast_time(spark, sf_dir):
    out = S.contrast_time(_table(spark, sf_dir, "events"), "user_id", "ts", F.col("event_type") == "purchase", F.col("event_type") == "signup")
    return out.select("event_id", "t0", "is_after")


@query("WITH p AS (SELECT d.event_id, p.value, row_number() OVER (PARTITION BY d.event_id ORDER BY abs(epoch_us(d.ts) - epoch_us(p.ts)), p.event_id) AS r FROM (SELECT * FROM events WHERE event_type = 'error') d LEFT JOIN events p ON p.user_id = d.user_id AND p.event_type <> 'error') SELECT event_id, value AS spacing FROM p WHERE r = 1")
def nearest_spacing(spark, sf_dir):
    out = S.nearest(_table(spark, sf_dir, "events"), ["user_id"], "ts", "event_id", F.col("event_type") == "error", "value", "spacing")
    return out.select("event_id", "spacing")


@query("SELECT user_id, round(median(value), 6) AS spacing FROM events GROUP BY user_id")
def median_spacing(spark, sf_dir):
    return _table(spark, sf_dir, "events").groupBy("user_id").agg(F.round(F.median("value"), 6).alias("spacing"))


@query("SELECT user_id, round(median(d), 6) AS z_spacing FROM (SELECT user_id, value - lag(value) OVER (PARTITION BY user_id ORDER BY value) AS d FROM events) WHERE d > 0 GROUP BY user_id")
def z_spacing(spark, sf_dir):
    from pyspark.sql import Window

    step = F.col("value") - F.lag("value").over(Window.partitionBy("user_id").orderBy("value"))
    return _table(spark, sf_dir, "events").select("user_id", step.alias("d")).where("d > 0").groupBy("user_id").agg(F.round(F.median("d"), 6).alias("z_spacing"))


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS b_value FROM events")
def bvalue_json(spark, sf_dir):
    return _table(spark, sf_dir, "events").select("event_id", H.b_value(F.create_map(F.lit("DiffusionBValue"), F.get_json_object("props", "$.k"))).alias("b_value"))


@query("WITH f AS (SELECT regexp_extract(url, '^(.*)/[^/]*$', 1) AS folder, url FROM pages) SELECT folder, min(url) FILTER (contains(url, '1')) AS one, min(url) FILTER (url GLOB '*7') AS seven FROM f GROUP BY folder HAVING count(*) FILTER (contains(url, '1')) = 1 AND count(*) FILTER (url GLOB '*7') = 1")
def pattern_exactly_one(spark, sf_dir):
    files = _table(spark, sf_dir, "pages").select(F.regexp_extract("url", "^(.*)/[^/]*$", 1).alias("folder"), "url")
    return S.exactly_one(files, "folder", "url", {"one": "1", "seven": "*7"})


@query("SELECT page_id, url GLOB '*/*[0-4]' AS globbed, contains(url, 'page') AS contained FROM pages")
def glob_match(spark, sf_dir):
    return _table(spark, sf_dir, "pages").select("page_id", S.matches(F.col("url"), "*/*[0-4]").alias("globbed"), S.matches(F.col("url"), "page").alias("contained"))


@query("SELECT o_custkey, string_agg(DISTINCT o_orderpriority, '; ' ORDER BY o_orderpriority) AS priorities FROM orders GROUP BY o_custkey")
def patient_metadata(spark, sf_dir):
    return _table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.array_join(F.array_sort(F.collect_set("o_orderpriority")), "; ").alias("priorities"))


@query("SELECT c_custkey, coalesce(u.k, l.k) AS first_order FROM customer LEFT JOIN (SELECT o_custkey, min(o_orderkey) AS k FROM orders WHERE o_orderpriority LIKE '1%' GROUP BY 1) u ON u.o_custkey = c_custkey LEFT JOIN (SELECT o_custkey, min(o_orderkey) AS k FROM orders WHERE o_orderpriority LIKE '5%' GROUP BY 1) l ON l.o_custkey = c_custkey")
def prefill_previous(spark, sf_dir):
    of = lambda p: F.min(F.when(F.col("o_orderpriority").startswith(p), F.col("o_orderkey")))
    known = _table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.coalesce(of("1"), of("5")).alias("first_order"))
    return _table(spark, sf_dir, "customer").select("c_custkey").join(known, "c_custkey", "left")


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority LIKE '1%' OR o_orderpriority LIKE '2%')")
def omit_previous(spark, sf_dir):
    seen = _table(spark, sf_dir, "orders").where("o_orderpriority like '1%' or o_orderpriority like '2%'").select(F.col("o_custkey").alias("c_custkey"))
    return C.missing(_table(spark, sf_dir, "customer").select("c_custkey"), seen, "c_custkey")


@query("SELECT page_id, sha256(html) AS sha256, CAST(strlen(html) AS BIGINT) AS bytes FROM pages")
def manifest_hash(spark, sf_dir):
    return _table(spark, sf_dir, "pages").select("page_id", F.sha2("html", 256).alias("sha256"), F.octet_length("html").cast("long").alias("bytes"))


@query("SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_type, ts NULLS LAST, event_id) AS place FROM events")
def series_sort(spark, sf_dir):
    from pyspark.sql import Window

    order = Window.partitionBy("user_id").orderBy("event_type", F.asc_nulls_last("ts"), "event_id")
    return _table(spark, sf_dir, "events").select("user_id", "event_id", F.row_number().over(order).cast("long").alias("place"))


_DEMIX = "WITH c AS (SELECT l_orderkey, l_linenumber, l_returnflag, count(*) AS n FROM lineitem GROUP BY ALL), d AS (SELECT *, CAST(sum(n) OVER k AS BIGINT) AS total, count(*) OVER k AS key_leaves, count(*) OVER f AS leaf_keys FROM c WINDOW k AS (PARTITION BY l_orderkey, l_returnflag), f AS (PARTITION BY l_orderkey, l_linenumber)) "


def _counts(spark, sf_dir):
    return S.demix_counts(_table(spark, sf_dir, "lineitem"), "l_orderkey", "l_linenumber", "l_returnflag")


@query(_DEMIX + "SELECT l_orderkey, l_linenumber, l_returnflag, n, total FROM d")
def demix_keys(spark, sf_dir):
    return _counts(spark, sf_dir).select("l_orderkey", "l_linenumber", "l_returnflag", "n", "total")


@query(_DEMIX + "SELECT l_orderkey, max(leaf_keys) = 1 AND max(key_leaves) = 1 AS pure FROM d GROUP BY l_orderkey")
def demix_purity(spark, sf_dir):
    return _counts(spark, sf_dir).groupBy("l_orderkey").agg(((F.max("leaf_keys") == 1) & (F.max("key_leaves") == 1)).alias("pure"))


@query(_DEMIX + "SELECT l_orderkey, l_linenumber, l_returnflag FROM d WHERE leaf_keys = 1 AND n = total")
def demix_pure_assign(spark, sf_dir):
    return _counts(spark, sf_dir).where("leaf_keys = 1 and n = total").select("l_orderkey", "l_linenumber", "l_returnflag")


#: The greedy choice as a recursion over the ordered pairs of each order; {} names the pairs.
_GREEDY = (
    "o AS (SELECT l_orderkey, l_linenumber, l_returnflag, n, row_number() OVER (PARTITION BY l_orderkey ORDER BY n DESC, l_linenumber, l_returnflag) AS k FROM {0}), "
    "g AS (SELECT DISTINCT l_orderkey, CAST(0 AS BIGINT) AS k, CAST([] AS INT[]) AS leaves, CAST([] AS VARCHAR[]) AS keys, CAST(NULL AS INT) AS l_linenumber, CAST(NULL AS VARCHAR) AS l_returnflag, CAST(0 AS BIGINT) AS n FROM {0} UNION ALL "
    "SELECT l_orderkey, k, CASE WHEN free THEN list_append(leaves, l_linenumber) ELSE leaves END, CASE WHEN free THEN list_append(keys, l_returnflag) ELSE keys END, l_linenumber, l_returnflag, CASE WHEN free THEN n ELSE 0 END FROM "
    "(SELECT o.*, g.leaves, g.keys, NOT list_contains(g.leaves, o.l_linenumber) AND NOT list_contains(g.keys, o.l_returnflag) AS free FROM g JOIN o ON o.l_orderkey = g.l_orderkey AND o.k = g.k + 1))"
)
_RECURSIVE = _DEMIX.replace("WITH c AS", "WITH RECURSIVE c AS").rstrip() + ", "


@query(_RECURSIVE + _GREEDY.format("d") + " SELECT l_orderkey, l_linenumber, l_returnflag, n FROM g WHERE n > 0")
def demix_greedy(spark, sf_dir):
    return S.demix_greedy(_counts(spark, sf_dir), "l_orderkey", "l_linenumber", "l_returnflag")


_MOVES = (
    _RECURSIVE + "pure AS (SELECT l_orderkey, l_linenumber, l_returnflag FROM d WHERE leaf_keys = 1 AND n = total), "
    "rest AS (SELECT * FROM d WHERE (l_orderkey, l_linenumber) NOT IN (SELECT (l_orderkey, l_linenumber) FROM pure) AND (l_orderkey, l_returnflag) NOT IN (SELECT (l_orderkey, l_returnflag) FROM pure)), "
    + _GREEDY.format("rest") + ", h AS (SELECT * FROM pure UNION ALL SELECT l_orderkey, l_linenumber, l_returnflag FROM g WHERE n > 0), "
    "m AS (SELECT d.l_orderkey, d.l_linenumber, d.l_returnflag, d.n, h.l_linenumber AS target FROM d LEFT JOIN h ON h.l_orderkey = d.l_orderkey AND h.l_returnflag = d.l_returnflag) "
)


@query(_MOVES + "SELECT * FROM m")
def demix_moves(spark, sf_dir):
    return S.demix_moves(_counts(spark, sf_dir), "l_orderkey", "l_linenumber", "l_returnflag")


@query(
    _MOVES.rstrip() + ", f AS (SELECT l_orderkey, l_returnflag, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_returnflag) AS j FROM (SELECT DISTINCT l_orderkey, l_returnflag FROM m WHERE target IS NULL)), "
    "w AS (SELECT f.*, j + CASE WHEN EXISTS (SELECT 1 FROM d WHERE d.l_orderkey = f.l_orderkey AND d.l_linenumber = 1) THEN 1 ELSE 0 END AS k FROM f) "
    "SELECT m.*, coalesce(CAST(target AS VARCHAR), CASE WHEN w.k = 1 THEN '1' ELSE '1-' || w.k END) AS folder FROM m LEFT JOIN w ON w.l_orderkey = m.l_orderkey AND w.l_returnflag = m.l_returnflag"
)
def demix_targets(spark, sf_dir):
    """All new folders are to be called 1, a name that a leaf may have."""
    moves = S.demix_moves(_counts(spark, sf_dir), "l_orderkey", "l_linenumber", "l_returnflag")
    return S.demix_targets(moves, "l_orderkey", "l_linenumber", "l_returnflag", F.lit("1"))


@query(
    "SELECT l_orderkey, CASE WHEN l_suppkey % 11 = 0 THEN 'UNKNOWN' WHEN l_partkey % 3 = 0 THEN 'UID|' || l_returnflag ELSE 'FALLBACK|' || CASE WHEN l_partkey % 5 = 0 THEN '-1' ELSE CAST(l_linenumber AS VARCHAR) END || '|' || lower(l_linestatus) || '|' END AS series_key, count(*) AS n FROM lineitem GROUP BY ALL"
)
def demix_key_rule(spark, sf_dir):
    uid = F.when(F.col("l_partkey") % 3 == 0, F.col("l_returnflag")).when(F.col("l_partkey") % 3 == 1, "")
    number = F.when(F.col("l_partkey") % 5 != 0, F.col("l_linenumber"))
    key = S.demix_key(F.col("l_suppkey") % 11 != 0, uid, number, F.concat(F.lit(" "), "l_linestatus", F.lit(" ")), F.lit(None).cast("string"))
    return _table(spark, sf_dir, "lineitem").groupBy("l_orderkey", key.alias("series_key")).agg(F.count("*").alias("n"))
