"""Shared plumbing of the text operators: tables, types, folds."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.tables import cut, drop

__all__ = ["ascii_lower", "batch", "cut", "drop", "floored", "fold", "held_out", "narrowed", "opened", "table", "utf8", "wrapped"]

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z only; every other character stays."""
    return F.translate(c, _UPPER, _UPPER.lower())


def fold(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n; null for a null id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % n


def held_out(doc_id: Column, n: int, part: int) -> Column:
    """Whether a row is of the part that no label is learnt from; a row without an id teaches nothing either, but is of
    no part: false."""
    return F.coalesce(fold(doc_id, n) == part, F.lit(False))


def utf8(column: pa.ChunkedArray | pa.Array) -> list[bytes | None]:
    """The UTF-8 bytes of a string column, without decoding them."""
    return column.cast(pa.binary() if column.type != pa.large_string() else pa.large_binary()).to_pylist()


def floored(lists: pa.Array, scale: int, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """floor(scale * component), in double precision, of a column of vectors: all components in line, where each row
    begins and ends among them, and which rows count: neither null nor empty, no component null, not finite, or of `most`
    and more."""
    values = np.asarray(lists.values.to_numpy(zero_copy_only=False), np.float64)  # a null component is NaN
    with np.errstate(invalid="ignore", over="ignore"):
        whole = np.floor(values * scale)
        good = np.abs(whole) < most
    edges, bad = lists.offsets.to_numpy(), np.concatenate([[0], np.cumsum(~good)])
    counts = np.array(lists.is_valid().to_pylist(), bool) & (edges[1:] > edges[:-1]) & (bad[edges[1:]] == bad[edges[:-1]])
    return np.where(good, whole, 0).astype(np.int64), edges, counts


def batch(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, schema.types, strict=True)], schema=schema)


_TEXTS = {"text", "url", "lang", "item_id"}


def narrowed(df: DataFrame, *columns: str) -> DataFrame:
    """Only these columns, with the types the operators expect; extra columns of any name fall away here.

    Ids are integers: an id column of another type is refused here, before anything runs.
    """
    kinds = dict(df.dtypes)
    for c in columns:
        if c not in _TEXTS and kinds[c] not in ("tinyint", "smallint", "int", "bigint", "void"):
            raise TypeError(f"{c} must be an integer column, not {kinds[c]}")
    return df.select(*[F.col(f"`{c}`").cast("string" if c in _TEXTS else "bigint").alias(c) for c in columns])


def wrapped(df: DataFrame, **own: Column) -> DataFrame:
    """The rows of df as one column `row`, beside columns of the operator's own: no name of theirs can meet one of df's."""
    return df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), *[c.alias(k) for k, c in own.items()])


def opened(columns: list[str], **changed: Column) -> list[Column]:
    """The columns of a wrapped table again, some of them changed."""
    return [changed.get(c, F.col("row")[c]).alias(c) for c in columns]
