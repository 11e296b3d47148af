"""Quality by logistic regression on hashed n-grams, trained with follow-the-regularised-leader (operator 5)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import batch, fold, held_out, narrowed, table, utf8
from .features import BITS, bounded, smallest, style_vector

#: Labelled documents learnt from, at most, of each label; passes over them; the share that sets the scale.
SAMPLE_ROWS, EPOCHS = 3_000, 4
CUT = 0.7
_SCHEMA = "doc_id long, score double, predicted int"
_ARROW = pa.schema([("doc_id", pa.int64()), ("score", pa.float64()), ("predicted", pa.int32())])


def train(rows: list[tuple[np.ndarray, np.ndarray]], labels: list[int], alpha: float = 0.3, beta: float = 1.0, l1: float = 0.05, l2: float = 0.5, epochs: int = EPOCHS, seed: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """Buckets and weights after per-coordinate FTRL-proximal updates; the last bucket, 2**BITS, is the constant."""
    z, n = np.zeros((1 << BITS) + 1), np.zeros((1 << BITS) + 1)

    def weights(i):
        return np.where(np.abs(z[i]) <= l1, 0.0, -(z[i] - np.sign(z[i]) * l1) / ((beta + np.sqrt(n[i])) / alpha + l2))

    order = np.random.default_rng(seed)
    for _ in range(epochs):
        for k in order.permutation(len(rows)):
            i, x = rows[k]
            w = weights(i)
            g = (1 / (1 + np.exp(-np.clip(w @ x, -35, 35))) - labels[k]) * x
            z[i] += g - (np.sqrt(n[i] + g * g) - np.sqrt(n[i])) / alpha * w
            n[i] += g * g
    kept = np.flatnonzero(w := weights(np.arange(len(z))))
    return kept, w[kept].astype(np.float32)


def _with_constant(v: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    return np.append(v[0], 1 << BITS), np.append(v[1], 1.0)


def learn(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> tuple[np.ndarray, np.ndarray]:
    """The model from at most `rows` documents of each label (doc_id, quality), as far as their features stay within
    features.MOST_FEATURES; a row without id or label teaches nothing; of contradictory labels both are used; without
    labels the model is empty."""
    own = labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("quality").cast("int").alias("_label"))
    picked = None
    for v in (0, 1):
        ids = smallest(own.where(F.col("_label") == v), rows).withColumn("_label", F.lit(v))
        picked = ids if picked is None else picked.union(ids)

    def run(batches):
        kind = pa.schema([("doc_id", pa.int64()), ("label", pa.int32()), ("at", pa.list_(pa.int32())), ("x", pa.list_(pa.float32()))])
        for b in batches:
            for doc_id, text, label in zip(b.column(0).to_pylist(), utf8(b.column(1)), b.column(2).to_pylist(), strict=True):
                at, x = _with_constant(style_vector(text))
                yield batch(kind, [doc_id], [label], [at], [x])

    found = bounded(narrowed(docs, "doc_id", "text").join(F.broadcast(picked), "doc_id").mapInArrow(run, "doc_id long, label int, at array<int>, x array<float>"), "label")
    if not found.num_rows:
        return np.empty(0, np.int64), np.empty(0, np.float32)
    vectors = [(np.asarray(a.values), np.asarray(x.values, np.float64)) for a, x in zip(found.column("at"), found.column("x"), strict=True)]
    return train(vectors, found.column("label").to_pylist())


def score(docs: DataFrame, model: tuple[np.ndarray, np.ndarray], cut: float = CUT) -> DataFrame:
    """Columns doc_id, score, predicted for each row of `docs` (doc_id, text): the logistic of a sparse dot product.

    Null and empty texts are scored by the constant and their own bucket; an empty model scores 0.5; a null doc_id
    stays null; repeated rows score alike; other columns are ignored; an empty table gives an empty one.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        w = np.zeros((1 << BITS) + 1, np.float32)
        w[sent.value[0]] = sent.value[1]
        for b in batches:
            total = np.array([w[i] @ x for i, x in (_with_constant(style_vector(t)) for t in utf8(b.column(1)))], np.float64)
            p = 1 / (1 + np.exp(-np.clip(total, -35, 35)))
            yield batch(_ARROW, b.column(0), p, (p >= cut).astype(np.int32))

    return narrowed(docs, "doc_id", "text").mapInArrow(run, _SCHEMA)


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """score() of all `documents` by a model of the labelled rows that are not held out; a row without an id is not
    held out, and teaches nothing."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = learn(docs, labels.where(fold(F.col("doc_id"), 4) != 2))
    return score(docs, model).select("doc_id", held_out(F.col("doc_id"), 4, 2).alias("held_out"), "score", "predicted")
