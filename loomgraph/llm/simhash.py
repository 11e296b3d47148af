"""SimHash near-duplicates by meet-in-the-middle ball hashing (operator 9)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import batch, cut, drop, narrowed, opened, table, utf8, wrapped
from .components import components

SHINGLE, RADIUS, SEED = 3, 2, 42
_SCHEMA = "doc_id long, hash long, fp long"
_ARROW = pa.schema([("doc_id", pa.int64()), ("hash", pa.int64()), ("fp", pa.int64())])

#: Row b: the bits of byte b, one in each byte of a 64-bit lane word.
_LANES = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").view("<u8").ravel()


def _bit_counts(hashes: np.ndarray) -> np.ndarray:
    """How many hashes have each of the 64 bits set."""
    total = np.zeros(64, np.int64)
    octets = hashes.astype("<u8").view(np.uint8).reshape(-1, 8)
    for i in range(0, len(octets), 255):  # a lane counts to 255
        total += _LANES[octets[i : i + 255]].sum(axis=0, dtype=np.uint64).view(np.uint8)
    return total


def fingerprint(text: bytes | None, size: int = SHINGLE) -> int:
    """The fingerprint of UTF-8 text, unsigned; 0 without words.  bytes.lower() lowers A-Z alone, and bytes.split()
    splits at the six ASCII white-space characters alone."""
    words = text.lower().split() if text else []
    if not words:
        return 0
    if len(words) <= size:
        hashes = [xxhash.xxh64_intdigest(b" ".join(words), SEED)]
    else:
        joined = b" ".join(words)
        ends = (np.cumsum([len(w) + 1 for w in words]) - 1).tolist()
        starts = [0, *(e + 1 for e in ends[:-size])]
        digest = xxhash.xxh64_intdigest
        hashes = [digest(joined[a:b], SEED) for a, b in zip(starts, ends[size - 1 :], strict=True)]
    bits = _bit_counts(np.array(hashes, np.uint64)) * 2 > len(hashes)
    return int(np.packbits(bits, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, size: int = SHINGLE) -> DataFrame:
    """Columns doc_id, hash (of the text), fp (the fingerprint's 64 bits as a signed long) for each row of `docs`
    (doc_id, text)."""

    def run(batches):
        for b in batches:
            fps = np.array([fingerprint(x, size) for x in utf8(b.column(1))], np.uint64).view(np.int64)
            yield batch(_ARROW, b.column(0), b.column(2), fps)

    return narrowed(docs, "doc_id", "text").withColumn("hash", F.xxhash64("text")).mapInArrow(run, _SCHEMA)


def links(distinct: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Columns fp, other: enough pairs at `radius` or fewer differing bits to connect all that are.

    Each distinct fingerprint emits its variants within half the radius; two fingerprints within the radius share one.
    The fingerprints at one variant are at most the ball's size (65 here), so a variant is no hot key; each links to
    the next smaller one there, which connects them all without emitting their pairs.
    """
    if radius != 2:
        raise ValueError("the half ball is written out for radius 2")
    ball = [F.col("fp"), *(F.col("fp").bitwiseXOR(F.lit(v if v < 1 << 63 else v - (1 << 64))) for v in (1 << i for i in range(64)))]
    variants = distinct.select("fp", F.explode(F.array(*ball)).alias("variant"))
    before = F.lag("fp").over(Window.partitionBy("variant").orderBy("fp"))
    pairs = variants.select("fp", before.alias("other")).where("other is not null").distinct()
    return pairs.where(F.bit_count(F.col("fp").bitwiseXOR(F.col("other"))) <= radius)


def _rooted(docs: DataFrame, size: int) -> tuple[DataFrame, DataFrame]:
    """The fingerprints of the rows, and of each distinct one its component (root) and least doc_id (first)."""
    spark = docs.sparkSession
    each, _ = cut(fingerprints(docs, size), "fingerprints")
    distinct, p1 = cut(each.groupBy("fp").agg(F.min("doc_id").alias("first")), "distinct")
    found, p2 = cut(components(links(distinct.select("fp")), "fp", "other"), "components")
    rooted, _ = cut(distinct.join(found, distinct.fp == found.node, "left").select("fp", F.coalesce("root", "fp").alias("root"), "first"), "rooted")
    drop(spark, p1, p2)
    return each, rooted


def near_duplicates(docs: DataFrame, size: int = SHINGLE) -> DataFrame:
    """Columns doc_id, fp, component_id for each row of `docs`.

    component_id: the smallest doc_id reachable over links, its own included.  Null, empty and blank texts have
    fingerprint 0 and link like any other; a null doc_id stays null and names no component (component_id is null where
    no row of the component has an id); repeated rows are each returned; other columns are ignored; an empty table
    gives an empty one.  Copies meet once, as one fingerprint, before anything is paired.
    """
    each, rooted = _rooted(docs, size)
    least = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    named = rooted.join(least, "root").select("fp", "component_id")
    return each.join(named, "fp").select("doc_id", "fp", "component_id")


def one_of_each(docs: DataFrame, size: int = SHINGLE) -> DataFrame:
    """One row of `docs` for each component, with all its columns: the one with the smallest doc_id, a null one last,
    then with the least hash of its text, then with the least hash of all its columns that can be hashed.

    Null, empty and blank texts are near-duplicates of each other, so one of them stays; of repeated rows one stays; a
    second text under an id that another component keeps is judged by its own component; columns of any name pass
    through; an empty table gives an empty one.
    """
    each, rooted = _rooted(docs, size)
    place = F.struct(F.col("doc_id").isNull().alias("null"), "doc_id", "hash")
    by_print = each.groupBy("fp").agg(F.min(place).alias("best"))
    best = by_print.join(rooted.select("fp", "root"), "fp").groupBy("root").agg(F.min("best").alias("best")).select("best.doc_id", "best.hash")
    same = each["doc_id"].eqNullSafe(best["doc_id"]) & (each["hash"] == best["hash"])
    copies = each.join(best, same, "left_semi").groupBy("doc_id", "hash").agg(F.count(F.lit(1)).alias("n"))
    kept, _ = cut(copies, "kept")
    unhashed = ("map<", "variant")
    hashed = [F.col(f"`{f.name}`") for f in docs.schema.fields if not any(k in f.dataType.simpleString() for k in unhashed)]
    keyed = wrapped(docs, key=F.col("doc_id").cast("bigint"), print=F.xxhash64(F.col("text").cast("string")), order=F.xxhash64(*hashed))

    def own(names: DataFrame) -> DataFrame:
        return keyed.join(names, keyed["key"].eqNullSafe(names["doc_id"]) & (keyed["print"] == names["hash"]))

    alone = own(kept.where("n = 1")).select("row")
    several = kept.where("n > 1")
    if not several.isEmpty():
        alone = alone.unionByName(own(several).groupBy("key", "print").agg(F.min_by("row", "order").alias("row")).select("row"))
    return alone.select(*opened(docs.columns))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """near_duplicates() of all `documents`, the fingerprint as 16 hex digits; what it says of null, empty, repeated and
    extra input holds."""
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
