"""The queries of this subpackage: each applies its operator to the whole of its table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from voxloom.llm import byte_bpe, conversation_repair, fingerprints, merkle_manifest, packing, piece_transducer, repair_codec, secret_scan, signature_tree, suffix_dedup, toxicity, transport_stream, warc_fixity
from voxloom.llm.common import documents

WORD_TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
RANK_FILE = public_tokenizers.path("byte_bpe_50k.tiktoken")
PIECE_TOKENIZER = public_tokenizers.path("piece_bpe_32k.model")


def op1_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprint_with_edit(documents(spark, sf_dir))


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.report(documents(spark, sf_dir))


def op3_transport_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transport_stream.media_report(documents(spark, sf_dir))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(documents(spark, sf_dir), WORD_TOKENIZER)


def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_transducer.report(documents(spark, sf_dir), PIECE_TOKENIZER)


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan(documents(spark, sf_dir))


def op7_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return signature_tree.link(documents(spark, sf_dir))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op9_repair_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair_codec.read_ids(repair_codec.write_ids(documents(spark, sf_dir), WORD_TOKENIZER))


def op10_warc_fixity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc_fixity.report(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op11_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.report(documents(spark, sf_dir), RANK_FILE)


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle_manifest.report(documents(spark, sf_dir))


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_repair.report(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op") and callable(f)}


def oracle_sql() -> dict[str, str]:
    return {"op12_merkle_manifest": merkle_manifest.SQL, "op13_conversation_repair": conversation_repair.SQL}
