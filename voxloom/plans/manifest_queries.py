"""Manifests over pages as model files, and bounded samples of groups. Each query with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from voxloom.operators import catalog as C
from voxloom.operators import manifest as M
from voxloom.plans.metadata_queries import _table
from voxloom.plans.volume_queries import query

_NAME = "'m' || page_id || CASE page_id % 4 WHEN 0 THEN '.cfg' WHEN 1 THEN '.txt' ELSE '.h5' END"
_FILES = f"f AS (SELECT page_id, {_NAME} AS name, CAST(octet_length(encode(html)) AS BIGINT) AS bytes, sha256(html) AS sha256, '2020-01-01T00:00:00Z' AS version, html FROM pages), m AS (SELECT * FROM f WHERE page_id % 4 <> 1)"


def _files(spark, sf_dir):
    ending = F.when(F.col("page_id") % 4 == 0, ".cfg").when(F.col("page_id") % 4 == 1, ".txt").otherwise(".h5")
    pages = _table(spark, sf_dir, "pages")
    return pages.select("page_id", F.concat(F.lit("m"), "page_id", ending).alias("name"), F.octet_length("html").cast("long").alias("bytes"), F.sha2("html", 256).alias("sha256"), F.lit("2020-01-01T00:00:00Z").alias("version"), "html")


def _manifest(spark, sf_dir):
    urls = _table(spark, sf_dir, "supplier").select(F.concat(F.lit("m"), "s_suppkey", F.lit(".h5")).alias("name"), F.concat(F.lit("https://models/"), "s_name").alias("url"))
    return M.build(_files(spark, sf_dir), urls)


@query(f"WITH {_FILES} SELECT name, coalesce('https://models/' || s_name, '') AS url, sha256, bytes, version FROM m LEFT JOIN supplier ON 'm' || s_suppkey || '.h5' = name")
def manifest_round_trip(spark, sf_dir):
    """The manifest through its JSON document."""
    return M.from_document(M.to_document(_manifest(spark, sf_dir)))


@query(f"WITH {_FILES} SELECT name, CASE WHEN page_id % 11 = 0 THEN 'missing' WHEN page_id % 7 = 0 THEN 'size' WHEN page_id % 5 = 0 THEN 'digest' ELSE 'ok' END AS status FROM m")
def manifest_verify(spark, sf_dir):
    """Files that are gone, cut short or changed are found by the manifest."""
    there = _files(spark, sf_dir).where("page_id % 11 <> 0")
    wrong = F.when(F.col("page_id") % 5 == 0, F.sha2(F.reverse("html"), 256)).otherwise(F.col("sha256"))
    there = there.select("name", (F.col("bytes") - (F.col("page_id") % 7 == 0).cast("int")).alias("bytes"), wrong.alias("sha256"))
    return M.verify(_manifest(spark, sf_dir), there)


@query("SELECT event_type, event_id FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY md5('3:' || event_id), event_id) AS k FROM events) WHERE k <= 40")
def bounded_sample(spark, sf_dir):
    """The bound of 40 rows a group is the feature."""
    return C.bounded(_table(spark, sf_dir, "events").select("event_type", "event_id"), "event_type", "event_id", 3, 40)
