"""Catalog operators: ranks over all rows, lists zipped by position, previous tables, folders, move plans, table files."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


#: Rows that one range of ranked() is meant to hold.
RANGE_ROWS = 1 << 20


def ranked(df: DataFrame, key: str | list[str], name: str = "rank", ranges: int | None = None) -> DataFrame:
    """df with each row's place from 0 by a unique key of one or more columns, without a window over all rows.

    Rows are dealt by ranges of the key, as many as the table asks for, and numbered within each; only the counts of the ranges
    are summed in one place. The dealt rows stay on the executors' disks, for counts and numbers must come of the same ranges.
    """
    keys = [key] if isinstance(key, str) else key
    ranges = ranges or max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-df.count() // RANGE_ROWS))
    dealt = df.repartitionByRange(ranges, *keys).sortWithinPartitions(*keys).withColumn("_at", F.monotonically_increasing_id())
    dealt = dealt.withColumn("_piece", F.shiftright("_at", 33)).persist(StorageLevel.DISK_ONLY)
    counts = dealt.groupBy("_piece").agg(F.count("*").alias("_n"))
    starts = counts.select("_piece", F.coalesce(F.sum("_n").over(Window.orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_start"))
    return dealt.join(starts, "_piece").withColumn(name, F.col("_start") + F.col("_at").bitwiseAND((1 << 33) - 1)).drop("_at", "_piece", "_start")


def batches(df: DataFrame, key: str, size: int) -> DataFrame:
    """df with `batch`: contiguous batches of `size` rows by the key, the last may be smaller."""
    return ranked(df, key, "_r").withColumn("batch", F.floor(F.col("_r") / size)).drop("_r")


def _drawn(key: str, seed: int) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string")))


def shuffled(df: DataFrame, key: str, seed: int) -> DataFrame:
    """df with `place`: its place from 0 in an order drawn by the seed, the same in every run; the key must be unique."""
    return ranked(df.withColumn("_m", _drawn(key, seed)), ["_m", key], "place").drop("_m")


def sampled(df: DataFrame, key: str, seed: int, n: int) -> DataFrame:
    """n rows without replacement, drawn by the seed, the same in every run; the key must be unique."""
    return df.orderBy(_drawn(key, seed), key).limit(n)


#: Parts that each group is dealt into before its least draws are compared.
RESERVOIR_PARTS = 64


def bounded(df: DataFrame, group: str | list[str], key: str, seed: int, most: int) -> DataFrame:
    """At most `most` rows of each group, drawn by the seed: those of the least md5 of seed and key, the same in every run.

    The least draws of each part of a group come first, then the least of these; Spark keeps `most` rows a group in every task
    before it shuffles, so a group of any size sends few rows. The key must be unique within its group.
    """
    groups = [group] if isinstance(group, str) else group
    drawn = df.withColumn("_draw", _drawn(key, seed)).withColumn("_part", F.conv(F.substring("_draw", -4, 4), 16, 10).cast("int") % RESERVOIR_PARTS)
    place = lambda *by: F.row_number().over(Window.partitionBy(*by).orderBy("_draw", key))
    least = drawn.withColumn("_k", place(*groups, "_part")).where(F.col("_k") <= most)
    return least.withColumn("_k", place(*groups)).where(F.col("_k") <= most).drop("_draw", "_part", "_k")


def zipped(left: DataFrame, left_key: str, right: DataFrame, right_key: str, strict: bool = True) -> DataFrame:
    """Row k of one list beside row k of the other; `strict` refuses lists of unequal length, else the longer is cut."""
    if strict and left.count() != right.count():
        raise ValueError("lists of unequal length")
    return ranked(left, left_key, "position").join(ranked(right, right_key, "position"), "position")


def missing(required: DataFrame, existing: DataFrame, key: str) -> DataFrame:
    return required.join(existing.select(key), key, "left_anti")


def without_outputs(inputs: DataFrame, outputs: DataFrame, key: str, overwrite: bool = False) -> DataFrame:
    """Inputs that have no output yet; all of them to overwrite."""
    return inputs if overwrite else missing(inputs, outputs, key)


def combined(previous: list[DataFrame], key: str, columns: list[str]) -> DataFrame:
    """A row for each key of any previous table: each column's first value that is neither null nor empty, in the order of the tables.

    Within a table that has a key twice the least value counts.
    """
    stacked = None
    for k, df in enumerate(previous):
        have = [F.col(c).cast("string").alias(c) if c in df.columns else F.lit(None).cast("string").alias(c) for c in columns]
        part = df.select(key, *have, F.lit(k).alias("_k"))
        stacked = part if stacked is None else stacked.unionByName(part)
    first = lambda c: F.min(F.when(F.col(c) != "", F.struct("_k", F.col(c).alias("v"))))["v"].alias(c)
    return stacked.groupBy(key).agg(*[first(c) for c in columns])


def folders(files: DataFrame, path: Column, most: int = 3) -> DataFrame:
    """folder, first (its least file name), n and some (its `most` least names), files in folders of their own only."""
    parts = files.select(F.regexp_extract(path, "^(.*)/[^/]*$", 1).alias("folder"), F.substring_index(path, "/", -1).alias("name"))
    place = F.row_number().over(Window.partitionBy("folder").orderBy("name"))
    capped = parts.withColumn("r", place).where(F.col("r") <= most).groupBy("folder").agg(F.array_join(F.array_sort(F.collect_list("name")), ",").alias("some"))
    counts = parts.groupBy("folder").agg(F.min("name").alias("first"), F.count("*").alias("n"))
    return counts.join(capped, "folder")


def numbered(df: DataFrame, folder: list[str], name: str, order: str) -> DataFrame:
    """df with `unique_name`: of equal names in a folder the second gets -2, the third -3 and so on."""
    k = F.row_number().over(Window.partitionBy(*folder, name).orderBy(order))
    return df.withColumn("unique_name", F.when(k == 1, F.col(name)).otherwise(F.concat(F.col(name), F.lit("-"), k.cast("string"))))


#: Separators of the table files by extension.
SEPARATORS = {".csv": ",", ".tsv": "\t", ".txt": "\t"}


def separator(path: str) -> str:
    ext = path[path.rfind(".") :].lower()
    if ext not in SEPARATORS:
        raise ValueError(f"unsupported table file: {path}")
    return SEPARATORS[ext]


def read_table(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """A table file with a header by its extension; without a schema all columns are text."""
    reader = spark.read.option("header", True).option("sep", separator(path))
    return (reader.schema(schema) if schema else reader).csv(path)


def write_table(df: DataFrame, path: str, append: bool = False) -> None:
    """A folder of table files with headers, named and separated by its extension."""
    df.write.mode("append" if append else "errorifexists").option("header", True).option("sep", separator(path)).csv(path)


def read_paths(spark: SparkSession, path: str) -> DataFrame:
    """The lines of a path list, stripped; blank ones stay."""
    return spark.read.text(path).select(F.trim("value").alias("path"))


def read_ini(spark: SparkSession, path: str) -> DataFrame:
    """path, section, key (lower case) and value of the lines `key = value` of INI files; comments and blank lines are left out.

    A file is one row of text, its sections run over its own lines.
    """
    files = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), "value")
    lines = files.select("path", F.posexplode(F.split("value", r"\r?\n")).alias("n", "line"))
    section = F.last(F.nullif(F.regexp_extract("line", r"^\s*\[([^\]]+)\]\s*$", 1), F.lit("")), True).over(Window.partitionBy("path").orderBy("n"))
    pair = r"^\s*([^#;=\[\s][^=]*?)\s*[=:]\s*(.*?)\s*$"
    found = lines.withColumn("section", section).where(F.col("line").rlike(pair))
    return found.select("path", "section", F.lower(F.regexp_extract("line", pair, 1)).alias("key"), F.regexp_extract("line", pair, 2).alias("value"))
