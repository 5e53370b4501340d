"""The routes for groups beyond HOT occurrences and BLOCK classes, reached by lowering both; ranges of ids that many rows share."""

import hashlib
import random

import numpy as np
from pyspark.sql import functions as F
from test_operators import by_id, components, removed, table

from voxloom.llm import common, fingerprints, repair_codec, signature_tree, suffix_dedup
from voxloom.llm.queries import WORD_TOKENIZER


def repeated_texts():
    rng = random.Random(21)
    word = lambda: "".join(rng.choice("abcdefgé") for _ in range(rng.randint(2, 7)))
    vocabulary = [word() for _ in range(500)]
    prose = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    passage, base = prose(90), [rng.choice(vocabulary) for _ in range(60)]
    near = [" ".join([*base[:k], "changed", *base[k + 1 :]]) for k in range(0, 60, 3)]
    return [prose(20) + passage + prose(15) for _ in range(24)] + near + [prose(40) for _ in range(20)] + [prose(5), None, ""]


def test_passages_of_more_occurrences_than_one_shard_takes(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "HOT", 3)
    texts = repeated_texts()
    got = by_id(suffix_dedup.report(table(spark, texts)))
    for i, (raw, mark) in enumerate(removed(texts)):
        assert got[3 * i + 1]["n_removed"] == int(np.sum(mark)), i


def test_buckets_of_more_classes_than_one_block_takes(spark, monkeypatch):
    monkeypatch.setattr(signature_tree, "BLOCK", 4)
    texts = repeated_texts()
    _, least = components(texts)
    got = by_id(signature_tree.link(table(spark, texts)))
    assert [got[3 * i + 1]["component_id"] for i in range(len(texts))] == [3 * k + 1 for k in least]


def test_ranges_split_a_hot_id_and_keep_places(spark):
    """Half of the rows have no id and a third the same one: they are dealt over tasks, and places still follow one another."""
    rows = [(None if i % 2 else 7 if i % 3 else i, f"text {i % 400} of words that go on for a while") for i in range(1200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    dealt = common.by_ranges(docs, "doc_id", "text", 6).groupBy("piece").agg(F.count("*").alias("n"), F.min("doc_id").alias("least")).orderBy("piece").collect()
    assert len(dealt) >= 5 and max(r["n"] for r in dealt) < 500
    got = sorted((r["start"], r["n_tokens"], r["doc_id"]) for r in repair_codec.read_ids(repair_codec.write_ids(docs, WORD_TOKENIZER)).collect())
    assert [x[2] for x in got] == sorted((d for d, _ in rows), key=lambda d: (d is not None, d))
    assert got[0][0] == 0 and all(a[0] + a[1] == b[0] for a, b in zip(got, got[1:], strict=False))


def test_every_row_meets_the_next_over_all_ranges(spark):
    """One row a range, fewer rows than ranges, and one row alone: the next of the last is the first."""
    for n in (1, 2, 3, 9):
        texts = [f"{chr(97 + i)} first words of text {i} " * 6 for i in range(n)]
        got = {r["doc_id"]: r for r in fingerprints.fingerprint_with_edit(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
        for i, text in enumerate(texts):
            cut = len(text) // 4
            assert got[i]["edited_sha256"] == hashlib.sha256((text[: len(text) - cut] + texts[(i + 1) % n][:cut]).encode()).hexdigest()
        assert len(got) == n
