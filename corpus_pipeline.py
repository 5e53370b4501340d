"""The corpus pipeline: toxic documents go, one of each near-duplicate group stays, repeats and secrets are cut out, the rest is packed.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes it as Parquet and rereads it for the next.
Stages but the last return the columns of documents. Rows with a null or empty text pass through all of them;
a null doc_id is like any other, and counts as the least.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxloom.llm import packing, secret_scan, signature_tree, suffix_dedup, toxicity
from voxloom.llm.common import documents, materialize
from voxloom.llm.queries import WORD_TOKENIZER

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: No SQL: learned scores, byte-level repeats and packing are beyond it; tests hold run() against plain Python on a small table.
ORACLE_SQL = None


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a score below 0.5; the learner reads the labels of sf_dir."""
    docs = docs.select(*COLUMNS)
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.score(docs, model).where("score < 0.5").drop("score")


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the one row of least doc_id, null first, then of least text hash; rows without words all stay."""
    return signature_tree.keep_one(docs.select(*COLUMNS))


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every byte in a string of 200 bytes that also starts elsewhere is cut out; all documents stay."""
    return suffix_dedup.remove_repeats(docs)


def cut_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every secret found is replaced by a mark; all documents stay."""
    return secret_scan.redact_texts(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token pieces of all documents with their sequence and offset."""
    return packing.pack_documents(docs, WORD_TOKENIZER)


STAGES = [
    ("toxicity", reject_toxic),
    ("near_duplicates", keep_one_of_each_group),
    ("suffix_dedup", cut_repeats),
    ("secret_scan", cut_secrets),
    ("packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return docs
