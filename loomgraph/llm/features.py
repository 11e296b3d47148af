"""Hashed features of texts, for the classifiers."""

from __future__ import annotations

import re
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, drop

BITS = 20
#: Features of training rows that the driver takes, at most.
MOST_FEATURES = 30_000_000

# The shape of a byte is X, x or 9 for letters and digits; marks and white space stand for themselves.
_SHAPE = bytes(0x58 if 0x41 <= b <= 0x5A else 0x78 if 0x61 <= b <= 0x7A or b >= 0x80 else 0x39 if 0x30 <= b <= 0x39 else b for b in range(256))
_RUNS = re.compile(rb"(.)\1+", re.S)
_MARKS = bytes(0x20 if b < 0x30 or 0x3A <= b <= 0x40 or 0x5B <= b <= 0x60 or 0x7B <= b <= 0x7F else b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))
_MIX = np.uint64(0x9E3779B97F4A7C15)


def _hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(crc32, words), np.uint64, len(words))


def _mixed(h: np.ndarray, salt: int) -> np.ndarray:
    h = (h + np.uint64(salt)) * _MIX
    return ((h ^ (h >> np.uint64(29))) * _MIX >> np.uint64(64 - BITS)).astype(np.int64)


def n_grams(h: np.ndarray, n: int, salt: int) -> np.ndarray:
    """Buckets of the word n-grams of hashed words."""
    if len(h) < n:
        return np.empty(0, np.int64)
    out = h[: len(h) - n + 1].copy()
    for k in range(1, n):
        out = (out * _MIX) ^ h[k : len(h) - n + 1 + k]
    return _mixed(out, salt)


def plain_words(text: bytes | None) -> list[bytes]:
    """Lower-cased words without ASCII marks."""
    return text.translate(_MARKS).split() if text else []


def style_vector(text: bytes | None) -> tuple[np.ndarray, np.ndarray]:
    """(buckets, values) of word 1- and 2-grams, and 1- to 3-grams of word shapes, where a word that repeats the one
    before has a shape of its own.  Values are roots of relative frequencies, so each kind has length 1; a text
    without words has the one bucket of that case."""
    words = text.split() if text else []
    if not words:
        return _mixed(np.zeros(1, np.uint64), 99), np.ones(1)
    h = _hashes(words)
    shapes = _hashes(_RUNS.sub(rb"\1", text.translate(_SHAPE)).split())
    again = np.concatenate([[False], h[1:] == h[:-1]])
    if len(shapes) == len(h):
        shapes = np.where(again, np.uint64(7), shapes)
    out, values = [], []
    for seq, n, salt in ((h, 1, 1), (h, 2, 2), (shapes, 1, 3), (shapes, 2, 4), (shapes, 3, 5)):
        ids, counts = np.unique(n_grams(seq, n, salt), return_counts=True)
        out.append(ids)
        values.append(np.sqrt(counts / max(1, counts.sum())))
    return np.concatenate(out), np.concatenate(values)


#: Lengths, in bytes, of the word beginnings that are features beside whole words.
BEGINNINGS = (5, 6, 7)


def word_set(text: bytes | None) -> np.ndarray:
    """Buckets of the distinct words of a text and of their beginnings."""
    words = set(plain_words(text))
    if not words:
        return np.empty(0, np.int64)
    parts = [_mixed(_hashes(list(words)), 1)]
    parts += [_mixed(_hashes(list({w[:n] for w in words if len(w) >= n})), 10 + n) for n in BEGINNINGS]
    return np.unique(np.concatenate(parts))


def smallest(ids: DataFrame, rows: int) -> DataFrame:
    """Of distinct ids at most `rows`: those with the smallest hash, the same whatever the table's order."""
    return ids.select("doc_id").where("doc_id is not null").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)


def bounded(rows: DataFrame, kind: str, most: int = MOST_FEATURES) -> pa.Table:
    """Training rows (doc_id, `kind`, at, ...) on the driver, ordered by id, kind and features.  Of more than `most`
    features those rows come that are first by a hash of their id, so very long texts don't fill the driver."""
    spark = rows.sparkSession
    table, path = cut(rows, "features")
    sizes = table.select("doc_id", kind, F.xxhash64("at").alias("print"), F.size("at").alias("n"))  # as many rows as the sample
    upto = F.sum("n").over(Window.orderBy(F.xxhash64("doc_id"), "doc_id", kind, "print").rowsBetween(Window.unboundedPreceding, 0))
    if sizes.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0] > most:
        kept = sizes.withColumn("upto", upto).where(F.col("upto") <= most).select("doc_id", kind, "print").distinct()
        table = table.withColumn("print", F.xxhash64("at")).join(F.broadcast(kept), ["doc_id", kind, "print"], "left_semi").drop("print")
    found = table.withColumn("print", F.xxhash64("at")).toArrow().sort_by([("doc_id", "ascending"), (kind, "ascending"), ("print", "ascending")])
    drop(spark, path)
    return found
