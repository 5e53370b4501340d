"""The patient table over `events`: each event is a file below a root, with a name, an id and a readable header or none. Each query with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from voxloom.operators import patients as P
from voxloom.plans.metadata_queries import _table
from voxloom.plans.volume_queries import query

_FILES = """WITH e AS (SELECT *, CASE WHEN event_id % 7 = 1 THEN 'CT' WHEN event_id % 7 = 2 THEN 'mr' WHEN event_id % 7 = 3 AND user_id % 5 = 0 THEN 'PET' ELSE 'MR' END AS kind,
  CASE event_id % 3 WHEN 0 THEN '.dcm' WHEN 1 THEN '.DCM' ELSE '' END AS ending FROM events),
f AS (SELECT 'P' || user_id AS dir, '/data/P' || user_id || '/T' || event_id % 2 || '/' || kind AS parent, kind, 'S' || CAST(floor(value) AS BIGINT) % 4 AS leaf, event_id || ending AS name, event_id % 4 <> 0 AS readable,
  CASE WHEN event_id % 11 > 0 THEN event_type || '^O''' || user_id % 3 || '.  X' END AS person, ' ID  ' || event_type AS pid FROM e) """

_SCAN = _FILES + """, s AS (SELECT *, row_number() OVER (PARTITION BY parent, leaf ORDER BY name) AS k, lower(name) LIKE '%.dcm' AS named FROM f WHERE kind IN ('MR', 'PET')),
one AS (SELECT * FROM s WHERE readable AND (named OR k <= 20) QUALIFY row_number() OVER (PARTITION BY parent, leaf ORDER BY named DESC, name) = 1),
p AS (SELECT dir, string_agg(DISTINCT nullif(lower(trim(regexp_replace(replace(replace(person, '^', ' '), '.', ' '), '\\s+', ' ', 'g'))), ''), '; ' ORDER BY nullif(lower(trim(regexp_replace(replace(replace(person, '^', ' '), '.', ' '), '\\s+', ' ', 'g'))), '')) AS names,
  string_agg(DISTINCT 'id ' || split_part(pid, '  ', 2), '; ' ORDER BY 'id ' || split_part(pid, '  ', 2)) AS ids FROM one GROUP BY dir),
a AS (SELECT 'P' || c_custkey AS dir, c_name AS n, '' AS d FROM customer WHERE c_custkey % 3 = 0), b AS (SELECT 'P' || c_custkey AS dir, 'N' || c_nationkey AS n, c_mktsegment AS d FROM customer WHERE c_custkey % 2 = 0) """


def _files(spark, sf_dir):
    kind = F.when(F.expr("event_id % 7 = 1"), "CT").when(F.expr("event_id % 7 = 2"), "mr").when(F.expr("event_id % 7 = 3 and user_id % 5 = 0"), "PET").otherwise("MR")
    ending = F.when(F.expr("event_id % 3 = 0"), ".dcm").when(F.expr("event_id % 3 = 1"), ".DCM").otherwise("")
    text = lambda e: F.expr(e).cast("string")
    path = F.concat(F.lit("/data/P"), text("user_id"), F.lit("/T"), text("event_id % 2"), F.lit("/"), kind, F.lit("/S"), text("floor(value) % 4"), F.lit("/"), text("event_id"), ending)
    person = F.when(F.expr("event_id % 11 > 0"), F.concat("event_type", F.lit("^O'"), text("user_id % 3"), F.lit(".  X")))
    tags = F.create_map(F.lit("PatientName"), person, F.lit("PatientID"), F.concat(F.lit(" ID  "), "event_type"))
    return _table(spark, sf_dir, "events").select(path.alias("path"), F.when(F.expr("event_id % 4 <> 0"), tags).alias("tags"))


def _previous(spark, sf_dir):
    customers = _table(spark, sf_dir, "customer")
    name = F.concat(F.lit("P"), F.col("c_custkey").cast("string")).alias("Directory")
    one = customers.where("c_custkey % 3 = 0").select(name, F.col("c_name").alias("patientID"), F.lit("").alias("day0Date"))
    two = customers.where("c_custkey % 2 = 0").select(name, F.concat(F.lit("N"), F.col("c_nationkey").cast("string")).alias("patientID"), F.col("c_mktsegment").alias("day0Date"))
    return [one, two, customers.select("c_custkey")]


@query(_SCAN + """SELECT u.dir AS "Directory", coalesce(nullif(a.n, ''), b.n, '') AS "patientID", coalesce(names, '') AS "patientName", coalesce(ids, '') AS "dicomPatientID", coalesce(b.d, '') AS "day0Date"
FROM (SELECT DISTINCT dir FROM f) u LEFT JOIN p ON p.dir = u.dir LEFT JOIN a ON a.dir = u.dir LEFT JOIN b ON b.dir = u.dir""")
def patient_scan(spark, sf_dir):
    """The patient table with the values of two previous tables; a third has no Directory."""
    return P.scan(_files(spark, sf_dir), "/data", ["MR", "PET/"], _previous(spark, sf_dir))


@query(_SCAN.replace("IN ('MR', 'PET')", "= 'PET'") + """SELECT dir AS "Directory", '' AS "patientID", coalesce(names, '') AS "patientName", ids AS "dicomPatientID", '' AS "day0Date" FROM p WHERE dir NOT IN (SELECT dir FROM a) AND dir NOT IN (SELECT dir FROM b)""")
def patient_scan_new(spark, sf_dir):
    """Patients with a readable PET series that no previous table has."""
    return P.scan(_files(spark, sf_dir), "/data/", ["PET"], _previous(spark, sf_dir), omit_previous=True, exclude_empty=True)


@query(_FILES + "SELECT parent, string_agg(DISTINCT parent || '/' || leaf, ',' ORDER BY parent || '/' || leaf) AS leaves FROM f WHERE lower(name) LIKE '%.dcm' GROUP BY parent")
def dicom_leaves(spark, sf_dir):
    return P.leaves(_files(spark, sf_dir)).select("parent", F.array_join("leaves", ",").alias("leaves"))
