"""Toxicity by non-negative positive-unlabelled learning (operator 6)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import batch, fold, held_out, narrowed, table, utf8
from .features import BITS, bounded, smallest, word_set

#: Confirmed toxic and unlabelled documents learnt from, at most.
POSITIVE_ROWS, UNLABELLED_ROWS = 2_500, 8_000
STEPS, CUT = 300, 0.3
#: A feature must stand in so many positive documents, and in one of so many of them, at least.
LEAST, ONE_OF = 3, 150
_SCHEMA = "doc_id long, score double, predicted int"
_ARROW = pa.schema([("doc_id", pa.int64()), ("score", pa.float64()), ("predicted", pa.int32())])


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


class _Rows:
    """Sets of buckets as one sparse 0/1 matrix."""

    def __init__(self, sets: list[np.ndarray], column: np.ndarray):
        kept = [column[s] for s in sets]
        kept = [k[k >= 0] for k in kept]
        self.n = len(sets)
        self.at = np.concatenate([*kept, np.empty(0, np.int64)]).astype(np.int64)
        self.row = np.repeat(np.arange(self.n), [len(k) for k in kept])

    def dot(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, w[self.at], minlength=self.n)

    def back(self, g: np.ndarray, size: int) -> np.ndarray:
        return np.bincount(self.at, g[self.row], minlength=size)


def risk(p: _Rows, u: _Rows, w: np.ndarray, c: float, prior: float) -> tuple[float, float]:
    """The two parts of the risk, under the logistic loss l: prior * E_P[l(f)], and the corrected negative part
    E_U[l(-f)] - prior * E_P[l(-f)]."""
    fp, fu = p.dot(w) + c, u.dot(w) + c
    return prior * np.logaddexp(0, -fp).mean(), np.logaddexp(0, fu).mean() - prior * np.logaddexp(0, fp).mean()


def gradient(p: _Rows, u: _Rows, w: np.ndarray, c: float, prior: float) -> tuple[np.ndarray, float]:
    """Where to step down: the gradient of both parts, or against the corrected part alone where that is negative."""
    sp, su = _sigmoid(p.dot(w) + c), _sigmoid(u.dot(w) + c)
    gu, gn = su / u.n, -prior * sp / p.n  # of E_U[l(-f)] and of -prior * E_P[l(-f)]
    if risk(p, u, w, c, prior)[1] < 0:
        on_p, on_u = -gn, -gu
    else:
        on_p, on_u = gn - prior * (1 - sp) / p.n, gu
    return p.back(on_p, len(w)) + u.back(on_u, len(w)), on_p.sum() + on_u.sum()


def train(positive: list[np.ndarray], unlabelled: list[np.ndarray], prior: float, steps: int = STEPS, rate: float = 0.1, l1: float = 4e-4, least: int = LEAST) -> tuple[np.ndarray, np.ndarray, float]:
    """Buckets, weights and constant of a linear classifier that minimises the non-negative risk
    prior * E_P[l(f)] + max(0, E_U[l(-f)] - prior * E_P[l(-f)]) under the logistic loss l, by Adam and soft thresholds."""
    empty = np.empty(0, np.int64), np.empty(0, np.float32), 0.0
    if not positive or not unlabelled:
        return empty
    seen = np.bincount(np.concatenate(positive), minlength=1 << BITS)
    inside = np.flatnonzero(seen >= min(max(least, len(positive) // ONE_OF), len(positive)))
    column = np.full(1 << BITS, -1, np.int64)
    column[inside] = np.arange(len(inside))
    p, u, size = _Rows(positive, column), _Rows(unlabelled, column), len(inside)
    w, c = np.zeros(size), float(np.log(prior / (1 - prior)))
    m, v, mc, vc = np.zeros(size), np.zeros(size), 0.0, 0.0
    for t in range(1, steps + 1):
        g, gc = gradient(p, u, w, c, prior)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        mc, vc = 0.9 * mc + 0.1 * gc, 0.999 * vc + 0.001 * gc * gc
        step = rate / (1 - 0.9**t)
        scale = np.sqrt(v / (1 - 0.999**t)) + 1e-8
        w -= step * m / scale
        w = np.sign(w) * np.maximum(0, np.abs(w) - step * l1 / (scale + 1e-3))
        c -= step * mc / (np.sqrt(vc / (1 - 0.999**t)) + 1e-8)
    kept = np.flatnonzero(w)
    return inside[kept], w[kept].astype(np.float32), c


def learn(docs: DataFrame, positive_ids: DataFrame, prior: float, positive_rows: int = POSITIVE_ROWS, unlabelled_rows: int = UNLABELLED_ROWS) -> tuple[np.ndarray, np.ndarray, float]:
    """The model from at most `positive_rows` documents of `positive_ids` and `unlabelled_rows` of all `docs`, those
    with the smallest hash of their id, as far as their features stay within features.MOST_FEATURES.  Without a positive
    document the model is empty."""
    full = narrowed(docs, "doc_id", "text")
    parts = [smallest(x, n).withColumn("_kind", F.lit(k)) for k, x, n in ((1, positive_ids.select(F.col("doc_id").cast("bigint").alias("doc_id")), positive_rows), (0, full, unlabelled_rows))]

    def run(batches):
        kind = pa.schema([("doc_id", pa.int64()), ("kind", pa.int32()), ("at", pa.list_(pa.int32()))])
        for b in batches:
            for doc_id, text, k in zip(b.column(0).to_pylist(), utf8(b.column(1)), b.column(2).to_pylist(), strict=True):
                yield batch(kind, [doc_id], [k], [word_set(text)])

    found = bounded(full.join(F.broadcast(parts[0].union(parts[1])), "doc_id").mapInArrow(run, "doc_id long, kind int, at array<int>"), "kind")
    sets, kinds = [np.asarray(x.values, np.int64) for x in found.column("at")], found.column("kind").to_pylist()
    return train([s for s, k in zip(sets, kinds, strict=True) if k], [s for s, k in zip(sets, kinds, strict=True) if not k], prior)


def class_prior(labels: DataFrame) -> float:
    """The share of toxic rows among those with a label, kept within 0.001 and 0.999."""
    known = labels.where("toxic is not null").agg(F.avg(F.col("toxic").cast("double"))).first()[0]
    return min(0.999, max(0.001, known or 0.0))


def from_labels(docs: DataFrame, labels: DataFrame) -> tuple[np.ndarray, np.ndarray, float]:
    """A model of the rows of `labels` (doc_id, toxic) and `docs` whose crc32(doc_id) mod 4 is not 2."""
    own = labels.where(fold(F.col("doc_id"), 4) != 2)
    return learn(docs.where(fold(F.col("doc_id"), 4) != 2), own.where("toxic = 1"), class_prior(own))


def _scorer(model):
    """UTF-8 text -> chance of toxicity.  A model that learnt nothing calls nothing toxic: 0."""
    if not len(model[0]):
        return lambda text: 0.0
    w = np.zeros(1 << BITS, np.float32)
    w[model[0]] = model[1]
    return lambda text: float(_sigmoid(w[word_set(text)].sum(dtype=np.float64) + model[2]))


def score(docs: DataFrame, model, cut: float = CUT) -> DataFrame:
    """Columns doc_id, score, predicted (1 from the cut up) for each row of `docs` (doc_id, text).

    Null and empty texts have the score of no words; an empty model scores 0 for all; a null doc_id stays null; repeated
    rows score alike; other columns are ignored; an empty table gives an empty one.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        of = _scorer(sent.value)
        for b in batches:
            p = np.array([of(t) for t in utf8(b.column(1))], np.float64)
            yield batch(_ARROW, b.column(0), p, (p >= cut).astype(np.int32))

    return narrowed(docs, "doc_id", "text").mapInArrow(run, _SCHEMA)


def without_toxic(docs: DataFrame, model, cut: float = CUT) -> DataFrame:
    """The rows of `docs`, with all their columns, whose score is below the cut.

    Null and empty texts are judged by the score of no words; repeated rows alike; an empty model keeps every row;
    columns of any name pass through; an empty table gives an empty one.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index("text")

    def run(batches):
        of = _scorer(sent.value)
        for b in batches:
            yield b.filter(pa.array([of(t) < cut for t in utf8(b.column(at))], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """score() of all `documents` by a model of the labelled rows that are not held out; a row without an id is not
    held out, and teaches nothing."""
    docs = table(spark, sf_dir, "documents")
    found = score(docs, from_labels(docs, table(spark, sf_dir, "labels")))
    return found.select("doc_id", held_out(F.col("doc_id"), 4, 2).alias("held_out"), "score", "predicted")
