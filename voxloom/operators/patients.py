"""The patient table: series folders under named folders, the first readable file of each, names and ids by patient, previous tables."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voxloom.functions import headers as H
from voxloom.operators import catalog as C
from voxloom.operators import series as S

#: The columns of a patient table.
COLUMNS = ["Directory", "patientID", "patientName", "dicomPatientID", "day0Date"]
#: How many files of a folder are tried, by name, where none that is named as DICOM can be read.
PROBED = 20


def is_dicom_name(name: Column) -> Column:
    return F.lower(name).endswith(".dcm")


def leaves(files: DataFrame, path: str = "path") -> DataFrame:
    """parent and leaves: the folders (full paths, sorted) below it that hold a file named .dcm themselves, in either case."""
    folder = F.regexp_extract(path, "^(.*)/[^/]*$", 1)
    found = files.where(is_dicom_name(F.col(path)) & F.col(path).contains("/")).select(folder.alias("leaf")).distinct()
    parent = F.regexp_extract("leaf", "^(.*)/[^/]*$", 1)
    return found.groupBy(parent.alias("parent")).agg(F.array_sort(F.collect_list("leaf")).alias("leaves"))


def below(files: DataFrame, root: str, path: str = "path") -> DataFrame:
    """The files below the folder `root`, with `parts`: the names on the way from there to the file.

    Local paths may be written file:/ or file:///, for Spark's readers give both.
    """
    top = re.sub("^file:/+", "file:/", root.rstrip("/")) + "/"
    at = F.regexp_replace(path, "^file:/+", "file:/")
    return files.where(at.startswith(top)).withColumn("parts", F.split(F.substr(at, F.lit(len(top) + 1)), "/"))


def series_files(files: DataFrame, root: str, subdirs: Sequence[str] = ("MR",), path: str = "path") -> DataFrame:
    """The files that lie in a folder right below one named in `subdirs`, at any depth: with Directory (the patient, the first
    name below the root, which may itself be so named), series (the folder's path) and name.
    """
    names = [s.strip("/") for s in subdirs if s]
    found = below(files, root, path).where((F.size("parts") >= 3) & F.try_element_at("parts", F.lit(-3)).isin(names))
    columns = [F.get("parts", 0).alias("Directory"), F.regexp_extract(path, "^(.*)/[^/]*$", 1).alias("series"), F.element_at("parts", -1).alias("name")]
    return found.select(*files.columns, *columns)


def first_readable(files: DataFrame, by: list[str], name: str = "name", value: str = "tags", probed: int = PROBED) -> DataFrame:
    """`by` and `value` of each group's first file by name whose value is not null: of those named .dcm, else of the first
    `probed` files of any name. Groups without one are left out.
    """
    least = lambda df: df.where(F.col(value).isNotNull()).groupBy(*by).agg(F.min_by(F.struct(value), F.col(name)).alias("_v"))
    place = F.row_number().over(Window.partitionBy(*by).orderBy(name))
    named = least(files.where(is_dicom_name(F.col(name)))).withColumn("_o", F.lit(0))
    other = least(files.withColumn("_k", place).where(F.col("_k") <= probed)).withColumn("_o", F.lit(1))
    return named.unionByName(other).groupBy(*by).agg(F.min_by("_v", "_o").alias("_v")).select(*by, F.col(f"_v.{value}").alias(value))


def scan(files: DataFrame, root: str, subdirs: Sequence[str] = ("MR",), previous: Sequence[DataFrame] = (), omit_previous: bool = False, exclude_empty: bool = False) -> DataFrame:
    """The patient table of a table of path and tags (null where a file cannot be read), as of dicom.read_headers.

    A row for each folder right below the root, in order of patientName, then Directory: the distinct names and ids in the
    first readable file of each series, sorted and joined by "; ", empty where there are none. patientID and day0Date come from
    the first of the `previous` tables that has one for the Directory, else they are empty; `omit_previous` leaves out the
    patients that any of those tables has, `exclude_empty` those without a readable series. Tables without a Directory count for nothing.
    Files right in the root belong to no patient.
    """
    patients = below(files.select("path"), root).where(F.size("parts") >= 2).select(F.get("parts", 0).alias("Directory")).distinct()
    get = lambda t: F.try_element_at("tags", F.lit(t))
    joined = lambda c: F.array_join(F.array_sort(F.collect_set(H.blank_to_null(c))), "; ")
    first = first_readable(series_files(files.select("path", "tags"), root, subdirs), ["Directory", "series"])
    names = first.groupBy("Directory").agg(joined(S.person_name(get("PatientName"))).alias("patientName"), joined(H.clean_lower(get("PatientID"))).alias("dicomPatientID"))
    out = patients.join(names, "Directory", "inner" if exclude_empty else "left")
    empty = lambda c: F.coalesce(c, F.lit("")).alias(c)
    known = [df for df in previous if "Directory" in df.columns]
    if known and omit_previous:
        out = C.missing(out, C.combined(known, "Directory", ["patientID"]), "Directory")
    elif known:
        out = out.join(C.combined(known, "Directory", ["patientID", "day0Date"]), "Directory", "left")
    lacking = [c for c in COLUMNS if c not in out.columns]
    out = out.withColumns({c: F.lit("") for c in lacking})
    return out.select("Directory", *[empty(c) for c in COLUMNS[1:]]).orderBy("patientName", "Directory")
