"""Manifests of model files: built of a folder and a table of addresses, kept as one JSON document, read back, selected from and checked.

The document maps a file name to its url, sha256, bytes and version. It holds a row for each model, not for each row of data.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from voxloom.functions import headers as H
from voxloom.operators import series as S

ENTRY = "struct<url:string,sha256:string,bytes:bigint,version:string>"
FIELDS = ("url", "sha256", "bytes", "version")
# The files that a manifest takes, and those that it leaves out.
INCLUDE = ("*.h5", "*.cfg")
EXCLUDE = (".git*", "*.gitignore", "*.gitkeep", "models.json", "osf_urls.json", "*.txt")


def chosen(name: Column, include: Sequence[str] = INCLUDE, exclude: Sequence[str] = EXCLUDE) -> Column:
    """Whether a file name matches one of the patterns and none of the others; every name if there are none to include."""
    hit = lambda patterns: H.any_of([name.rlike(S.glob_regex(p)) for p in patterns])
    return (hit(include) if include else F.lit(True)) & ~hit(exclude)


def scan(spark: SparkSession, folder: str) -> DataFrame:
    """name, bytes, sha256 and version (time of change in UTC) of the files that lie in the folder itself; empty ones are left out, as Spark does not read them."""
    files = spark.read.format("binaryFile").load(folder)
    stamp = F.date_format(F.to_utc_timestamp("modificationTime", F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    return files.select(F.substring_index("path", "/", -1).alias("name"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"), stamp.alias("version"))


def build(files: DataFrame, urls: DataFrame | None = None, include: Sequence[str] = INCLUDE, exclude: Sequence[str] = EXCLUDE) -> DataFrame:
    """name, url (empty where `urls` of name and url has none), sha256, bytes and version of the files chosen."""
    taken = files.where(chosen(F.col("name"), include, exclude))
    if urls is None:
        return taken.select("name", F.lit("").alias("url"), *FIELDS[1:])
    return taken.join(urls.select("name", "url"), "name", "left").select("name", F.coalesce("url", F.lit("")).alias("url"), *FIELDS[1:])


def to_document(manifest: DataFrame) -> DataFrame:
    """`document`: the manifest as one JSON text, by name. A name that stands twice is an error."""
    entries = F.sort_array(F.collect_list(F.struct("name", F.struct(*FIELDS).alias("e"))))
    names = F.transform(F.col("entries"), lambda x: x["name"])
    twice = F.when(F.size(F.array_distinct(names)) < F.size(names), F.raise_error(F.lit("a name stands twice in the manifest")))
    made = F.to_json(F.map_from_entries(F.transform("entries", lambda x: F.struct(x["name"], x["e"]))))
    return manifest.agg(entries.alias("entries")).select(F.coalesce(twice, made).alias("document"))


def from_document(documents: DataFrame, column: str = "document") -> DataFrame:
    """name, url, sha256, bytes and version of JSON documents; a document that is no such map is an error."""
    parsed = F.from_json(column, f"map<string,{ENTRY}>")
    checked = F.when(parsed.isNotNull() & F.trim(F.col(column)).startswith("{"), parsed).otherwise(F.raise_error(F.lit("not a manifest")))
    return documents.select(F.explode(checked).alias("name", "e")).select("name", F.coalesce("e.url", F.lit("")).alias("url"), *[f"e.{f}" for f in FIELDS[1:]])


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    return from_document(spark.read.text(path, wholetext=True).withColumnRenamed("value", "document"))


def read_urls(spark: SparkSession, path: str) -> DataFrame:
    """name and url of a JSON map; a path that is not there is an error."""
    return spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", "map<string,string>")).alias("name", "url"))


def write_manifest(manifest: DataFrame, path: str, overwrite: bool = True) -> None:
    """The document in one file, seen whole or not at all. FileExistsError if it is there and must not be overwritten, ValueError without files."""
    system, at = fs.FileSystem.from_uri(path)
    if not overwrite and system.get_file_info(at).type != fs.FileType.NotFound:
        raise FileExistsError(path)
    document = to_document(manifest).first()["document"]
    if document == "{}":
        raise ValueError("no file for the manifest")
    system.create_dir(at.rsplit("/", 1)[0], recursive=True)
    staged = f"{at}.{uuid.uuid4().hex}"
    with system.open_output_stream(staged, compression=None) as f:
        f.write(document.encode() + b"\n")
    system.move(staged, at)


def select(manifest: DataFrame, names: Sequence[str]) -> DataFrame:
    """The entries of the names, each once; a name that the manifest lacks is an error when the result is read."""
    wanted = manifest.sparkSession.createDataFrame([(n,) for n in dict.fromkeys(names)], "name string")
    found = wanted.join(manifest.withColumn("_there", F.lit(True)), "name", "left")
    known = F.when(F.col("_there"), F.col("name")).otherwise(F.raise_error(F.concat(F.lit("unknown model: "), "name")))
    return found.withColumn("name", known).drop("_there")


def verify(manifest: DataFrame, files: DataFrame) -> DataFrame:
    """name and status of every entry: ok, missing, size or digest, by the files (name, bytes, sha256) that are there."""
    there = files.select("name", F.col("bytes").alias("_bytes"), F.col("sha256").alias("_sha256"))
    status = F.when(F.col("_sha256").isNull(), "missing").when(F.col("_bytes") != F.col("bytes"), "size").when(F.col("_sha256") != F.lower("sha256"), "digest").otherwise("ok")
    return manifest.join(there, "name", "left").select("name", status.alias("status"))
