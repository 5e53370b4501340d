"""Toxicity by FTRL-proximal logistic regression over hashed word n-grams and skip-grams."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from voxloom.llm.common import U64, _LOWER, mix, slices, small_batches, text_buffers, words

#: Words: runs of letters, digits and non-ASCII bytes.
_APART = np.ones(256, bool)
_APART[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False


@dataclass(frozen=True)
class Ftrl:
    """Parameters of the learner. sample: most labelled rows it is fitted on, the first by a hash of doc_id.

    toxic: how many times a toxic row's gradient counts, for such rows are few.
    """

    bits: int = 20
    alpha: float = 1.0
    beta: float = 1.0
    l1: float = 20.0
    l2: float = 1.0
    epochs: int = 4
    sample: int = 6000
    toxic: float = 3.0


@dataclass(frozen=True)
class Model:
    """Sparse weights: sorted feature ids with their weights, and the bias; a few thousand numbers."""

    ids: np.ndarray
    weights: np.ndarray
    bias: float
    bits: int

    def dense(self) -> np.ndarray:
        out = np.zeros(1 << self.bits)
        out[self.ids] = self.weights
        return out


def features(data: np.ndarray, offsets: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Feature ids of every row (words, pairs, pairs with one word left out) and each row's n + 1 places.

    Ids repeat as the features do.
    """
    w, at = words(data, offsets, _APART, _LOWER)
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(at))
    parts, rows = [w], [row]
    for gap in (1, 2):
        same = row[gap:] == row[:-gap]
        parts.append(mix(w[:-gap] * U64(0x9E3779B97F4A7C15 + 2 * gap) + w[gap:])[same])
        rows.append(row[gap:][same])
    ids, rows = (np.concatenate(parts) >> U64(64 - bits)).astype(np.int64), np.concatenate(rows)
    order = np.argsort(rows, kind="stable")
    return ids[order], np.concatenate([[0], np.cumsum(np.bincount(rows, minlength=len(offsets) - 1))])


def _sigmoid(x: np.ndarray | float) -> np.ndarray | float:
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


def train(rows: list[np.ndarray], labels: np.ndarray, p: Ftrl) -> Model:
    """Rows: distinct feature ids. Each coordinate has its own rate; l1 leaves most weights at zero.

    Without rows there are no weights and the bias is -1, so that every text scores 0.27 and none counts as toxic.
    """
    if not len(rows):
        return Model(np.zeros(0, np.int64), np.zeros(0), -1.0, p.bits)
    z, n = np.zeros((1 << p.bits) + 1), np.zeros((1 << p.bits) + 1)
    bias = np.array([1 << p.bits])
    order = np.random.default_rng(0)
    for _ in range(p.epochs):
        for i in order.permutation(len(rows)):
            x = np.concatenate([rows[i], bias])
            zi, ni = z[x], n[x]
            w = np.where(np.abs(zi) <= p.l1, 0, -(zi - np.sign(zi) * p.l1) / ((p.beta + np.sqrt(ni)) / p.alpha + p.l2))
            g = (_sigmoid(w.sum()) - labels[i]) * (p.toxic if labels[i] else 1.0)
            z[x] = zi + g - (np.sqrt(ni + g * g) - np.sqrt(ni)) / p.alpha * w
            n[x] = ni + g * g
    w = np.where(np.abs(z) <= p.l1, 0, -(z - np.sign(z) * p.l1) / ((p.beta + np.sqrt(n)) / p.alpha + p.l2))
    ids = np.flatnonzero(w[:-1])
    return Model(ids, w[ids], float(w[-1]), p.bits)


def fit(docs: DataFrame, labels: DataFrame, p: Ftrl = Ftrl()) -> Model:
    """Fit on at most p.sample labelled rows (bounded, so they may come to the driver) outside the held-out fold.

    Rows with a null label or no text row are left out; a doc_id labelled twice counts as toxic if any label says so.
    Without labelled rows every text scores 0.27.
    """
    spark = docs.sparkSession
    small_batches(spark)
    crc = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    chosen = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & (crc % 5 != 0)).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(p.sample)
    rows = F.broadcast(chosen).join(docs.select("doc_id", "text"), "doc_id").select("doc_id", F.col("toxic").cast("int").alias("toxic"), "text")

    def distinct(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_buffers(batch["text"])
            out = []
            for lo, hi in slices(offsets):
                ids, at = features(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], p.bits)
                out += [np.unique(ids[a:b]).astype(np.int32).tobytes() for a, b in zip(at[:-1], at[1:], strict=True)]
            yield pa.record_batch([batch["doc_id"], batch["toxic"], pa.array(out, pa.binary())], names=["doc_id", "toxic", "ids"])

    got = sorted(rows.mapInArrow(distinct, "doc_id long, toxic int, ids binary").collect(), key=lambda r: (r["doc_id"], bytes(r["ids"])))
    return train([np.frombuffer(r["ids"], np.int32).astype(np.int64) for r in got], np.array([r["toxic"] for r in got], float), p)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """Every row of docs with score (0 to 1) as its last column, in place of any column of that name.

    A text without words, empty or null scores 0, for there is nothing toxic in it. The sparse weights travel with the task.
    """
    small_batches(docs.sparkSession)
    docs = docs.drop("score")
    schema = StructType([*docs.schema.fields, StructField("score", DoubleType())])

    def scored(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = model.dense()
        for batch in batches:
            data, offsets = text_buffers(batch["text"])
            out = [np.zeros(0)]
            for lo, hi in slices(offsets):
                total, some = _sums(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], model.bits, weights)
                out.append(np.where(some, _sigmoid(total + model.bias), 0.0))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.concatenate(out))], names=[*batch.schema.names, "score"])

    return docs.mapInArrow(scored, schema)


def _sums(data: np.ndarray, offsets: np.ndarray, bits: int, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sum of weights over each row's distinct features, and whether it has any; features without weight drop out before they are compared."""
    ids, at = features(data, offsets, bits)
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(at))
    some = weights[ids] != 0
    key = np.unique(row[some] << bits | ids[some])
    return np.bincount(key >> bits, weights[key & (1 << bits) - 1], len(offsets) - 1), np.diff(at) > 0


def classify(docs: DataFrame, labels: DataFrame, p: Ftrl = Ftrl()) -> DataFrame:
    """doc_id, held_out, score and predicted (1 from 0.5 on) of every row; scores read the text alone."""
    scored = score(docs.select("doc_id", "text"), fit(docs, labels, p))
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5, F.lit(0)) == 0
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
