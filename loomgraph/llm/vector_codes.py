"""Codes of vectors by parts: nearest entries are screened in single precision (operator 12)."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import batch, cut, drop, floored, table

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
#: Integer components are smaller than this, so squared distances of a part are exact in 64 bits.
MOST = 2**26
#: Rows whose distances to all entries are held at a time.
TILE = 2048
#: Sums of labels are broadcast up to so many; more are joined, each label dealt over SALT places.
MOST_BROADCAST, SALT = 100_000, 32

_ROWS = "vec_id long, label long, data binary"
_ROWS_ARROW = pa.schema([("vec_id", pa.int64()), ("label", pa.int64()), ("data", pa.binary())])
_SUMS = "slot long, n long, sums binary"
_SUMS_ARROW = pa.schema([("slot", pa.int64()), ("n", pa.int64()), ("sums", pa.binary())])
_CODED = "vec_id long, label long, code string, error long"
_CODED_ARROW = pa.schema([("vec_id", pa.int64()), ("label", pa.int64()), ("code", pa.string()), ("error", pa.int64())])


class Codebook:
    """The entries of one part, for nearest()."""

    def __init__(self, entries: np.ndarray):
        # Of equal entries the first wins every tie, so only that one is compared.
        self.index = np.sort(np.unique(entries, axis=0, return_index=True)[1])
        self.exact = entries[self.index]
        whole = self.exact.astype(np.float64)
        squares = (whole * whole).sum(axis=1)
        self.single, self.half = self.exact.astype(np.float32), (squares / 2).astype(np.float32)
        self.longest, self.most = float(np.sqrt(squares.max())), float(squares.max() / 2)
        steps = (entries.shape[1] + 4) * 2.0**-24
        self.share = 1.01 * steps / (1 - steps)

    def nearest(self, part: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index and squared distance of the nearest entry to each row of integers, ties to the lower index.

        x.c - c.c/2 is greatest for the nearest entry c.  In single precision a product of n terms is off by at most
        g(n) = n u / (1 - n u) times |x||c|, with u = 2^-24 and in whatever order it is summed; two more steps round the
        components, two the half square and the difference.  So each value lies within `off` of the true one.  Every
        entry whose interval overlaps that of the best is measured again in 64-bit integers.
        """
        index, far = np.empty(len(part), np.int64), np.empty(len(part), np.int64)
        for at in range(0, len(part), TILE):
            x = part[at : at + TILE]
            wide = x.astype(np.float64)
            off = self.share * (np.sqrt((wide * wide).sum(axis=1)) * self.longest + self.most)
            value = x.astype(np.float32) @ self.single.T - self.half
            least = np.nextafter((value.max(axis=1).astype(np.float64) - 2 * off).astype(np.float32), np.float32(-np.inf))
            row, entry = np.nonzero(value >= least[:, None])
            apart = np.empty(len(row), np.int64)
            for k in range(0, len(row), 1 << 16):  # many entries may overlap: a bounded number of them at a time
                d = x[row[k : k + (1 << 16)]] - self.exact[entry[k : k + (1 << 16)]]
                apart[k : k + (1 << 16)] = (d * d).sum(axis=1)
            order = np.lexsort((entry, apart, row))
            first = order[np.searchsorted(row[order], np.arange(len(x)))]
            index[at : at + TILE], far[at : at + TILE] = self.index[entry[first]], apart[first]
        return index, far


def _rows(vectors: DataFrame, scale: int, parts: int) -> DataFrame:
    def run(batches):
        for b in batches:
            values, edges, good = floored(b.column(1), scale, MOST)
            at = np.flatnonzero(good & ((edges[1:] - edges[:-1]) % parts == 0))
            data = values.astype("<i4")
            yield batch(_ROWS_ARROW, b.column(0).take(pa.array(at)), b.column(2).take(pa.array(at)), [data[edges[i] : edges[i + 1]].tobytes() for i in at])

    return vectors.select(F.col("vec_id").cast("bigint"), F.col("embedding").cast("array<double>"), F.col("label").cast("bigint")).mapInArrow(run, _ROWS)


def _matrix(column: pa.Array, parts: int) -> np.ndarray:
    """(rows, parts, width) of a column of encoded vectors of one length."""
    return np.frombuffer(b"".join(column.to_pylist()), "<i4").astype(np.int64).reshape(len(column), parts, -1)


def _sums(rows: DataFrame, books: list[np.ndarray], entries: int) -> dict[int, tuple[int, np.ndarray]]:
    """Of each used entry the number of parts that it is nearest to, and their sum; slot = part * entries + index.  A task
    sends at most a row for each entry, and as many come to the driver."""
    sent = rows.sparkSession.sparkContext.broadcast(books)

    def run(batches):
        own, known = [Codebook(x) for x in sent.value], {}
        for b in batches:
            if b.num_rows == 0:
                continue
            x = _matrix(b.column(0), len(own))
            for p, book in enumerate(own):
                index, _ = book.nearest(x[:, p])
                order = np.argsort(index, kind="stable")
                used, first, n = np.unique(index[order], return_index=True, return_counts=True)
                for slot, count, s in zip((used + p * entries).tolist(), n.tolist(), np.add.reduceat(x[order, p], first), strict=True):
                    was = known.get(slot)
                    known[slot] = (count, s) if was is None else (was[0] + count, was[1] + s)
        if known:
            yield batch(_SUMS_ARROW, [*known], [v[0] for v in known.values()], [v[1].tobytes() for v in known.values()])

    def add(batches):
        known: dict[int, tuple[int, np.ndarray]] = {}
        for b in batches:
            for slot, n, s in zip(*(c.to_pylist() for c in b.columns), strict=True):
                was = known.get(slot)
                known[slot] = (n, np.frombuffer(s, np.int64)) if was is None else (was[0] + n, was[1] + np.frombuffer(s, np.int64))
        if known:
            yield batch(_SUMS_ARROW, [*known], [v[0] for v in known.values()], [v[1].tobytes() for v in known.values()])

    found = rows.select("data").mapInArrow(run, _SUMS).repartition("slot").mapInArrow(add, _SUMS).collect()
    sent.unpersist()
    return {r["slot"]: (r["n"], np.frombuffer(r["sums"], np.int64)) for r in found}


def compress(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> tuple[DataFrame, list[np.ndarray]]:
    """vec_id, label, code, error for each row of `vectors` (vec_id, embedding, label) that counts, and the codebooks.

    Components become floor(scale * x), vectors are cut into `parts` equal parts, and each part position has a codebook:
    the parts of the first `entries` vectors by id, moved in each round to the floor of the mean of what is nearest to
    them.  code: the nearest entries' indexes, two hex digits for each part; error: the squared distances, summed.

    Rows are left out if their vector is null or empty, holds a null or non-finite component or one of 2^26 and more
    after scaling, can't be cut into equal parts, or is not as long as that of the smallest id left.  Rows of one id are
    vectors of their own, ordered by their components; those without an id are coded too, and come last.  Fewer rows than
    entries make shorter codebooks; an empty table gives an empty one.  Other columns are ignored.
    """
    if not 0 < entries <= 256:
        raise ValueError("an index has two hex digits: 1 to 256 entries")
    spark = vectors.sparkSession
    rows, _ = cut(_rows(vectors, scale, parts), "vectors")
    order = [F.col("vec_id").asc_nulls_last(), F.col("data")]
    head = rows.orderBy(*order).limit(1).collect()
    if not head:
        return spark.createDataFrame([], _CODED), []
    rows = rows.where(F.length("data") == len(head[0]["data"]))
    head = rows.orderBy(*order).limit(entries).select("data").collect()
    first = np.frombuffer(b"".join(r["data"] for r in head), "<i4").astype(np.int64).reshape(len(head), parts, -1)
    books = [first[:, p].copy() for p in range(parts)]
    for _ in range(rounds):
        for slot, (n, s) in _sums(rows, books, entries).items():
            books[slot // entries][slot % entries] = s // n
    sent = spark.sparkContext.broadcast(books)

    def code(batches):
        own = [Codebook(x) for x in sent.value]
        for b in batches:
            if b.num_rows == 0:
                continue
            x = _matrix(b.column(2), parts)
            found = [book.nearest(x[:, p]) for p, book in enumerate(own)]
            digits = np.stack([i for i, _ in found], axis=1).astype(np.uint8).tobytes().hex()
            yield batch(_CODED_ARROW, b.column(0), b.column(1), [digits[k : k + 2 * parts] for k in range(0, len(digits), 2 * parts)], sum(d for _, d in found))

    return rows.mapInArrow(code, _CODED), books


def decoded(code: str, books: list[np.ndarray], scale: int = SCALE) -> np.ndarray:
    """The vector that a code stands for: the middle of each component's cell."""
    return np.concatenate([book[int(code[2 * p : 2 * p + 2], 16)] for p, book in enumerate(books)]) / scale + 0.5 / scale


def digest(books: list[np.ndarray]) -> str:
    """SHA-256 of all entries' components in decimal, by part, entry and position, comma-joined."""
    return hashlib.sha256(",".join(str(x) for book in books for x in book.ravel().tolist()).encode()).hexdigest()


def with_label_errors(coded: DataFrame, most: int = MOST_BROADCAST, salt: int = SALT) -> DataFrame:
    """`coded` and label_error, the errors of its label summed, rows without a label together; null where the sum is no
    64-bit number.  Errors are summed before they are shuffled; a label's rows never meet in one task."""
    sums, path = cut(coded.groupBy("label").agg(F.try_sum("error").alias("label_error")), "labels")
    if sums.count() <= most:
        return coded.alias("a").join(F.broadcast(sums.alias("b")), F.col("a.label").eqNullSafe(F.col("b.label")), "left").select("a.*", "b.label_error")
    dealt = coded.withColumn("_salt", F.pmod(F.xxhash64("vec_id", "code"), F.lit(salt)).cast("int"))
    spread = sums.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salt - 1))))
    a, b = dealt.alias("a"), spread.alias("b")
    return a.join(b, F.col("a.label").eqNullSafe(F.col("b.label")) & (F.col("a._salt") == F.col("b._salt")), "left").select("a.*", "b.label_error").drop("_salt")


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """compress() of all `embeddings`, with the errors of labels and the digest of the codebooks; null, odd and repeated
    rows as there."""
    coded, books = compress(table(spark, sf_dir, "embeddings"))
    held, _ = cut(coded, "codes")
    return with_label_errors(held).select("vec_id", "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))


def _oracle() -> str:
    dot = "list_dot_product({0}::DOUBLE[], {1}::DOUBLE[])"
    apart = f"({dot.format('p.v', 'p.v')} - 2 * {dot.format('p.v', 'c.v')} + {dot.format('c.v', 'c.v')})::BIGINT"
    steps = []
    for i in range(ROUNDS + 1):
        steps.append(f"a{i} AS MATERIALIZED (SELECT vec_id, label, part, any_value(p.v) AS v, min(struct_pack(d := {apart}, e := c.entry)) AS best FROM p JOIN c{i} c USING (part) GROUP BY vec_id, label, part)")
        if i < ROUNDS:
            steps.append(f"s{i} AS (SELECT part, entry, pos, sum(x) AS s, count(*) AS n FROM (SELECT part, best.e AS entry, unnest(v) AS x, unnest(range(len(v))) AS pos FROM a{i}) GROUP BY ALL)")
            steps.append(f"u{i} AS (SELECT part, entry, list(((s - ((s % n) + n) % n) // n)::BIGINT ORDER BY pos) AS v FROM s{i} GROUP BY part, entry)")
            steps.append(f"c{i + 1} AS MATERIALIZED (SELECT c.part, c.entry, coalesce(u.v, c.v) AS v FROM c{i} c LEFT JOIN u{i} u ON c.part = u.part AND c.entry = u.entry)")
    return f"""
WITH k AS (SELECT vec_id, label, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)::BIGINT) AS e FROM embeddings WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS MATERIALIZED (SELECT vec_id, label, part, e[part * (len(e) // {PARTS}) + 1 : (part + 1) * (len(e) // {PARTS})] AS v, row_number() OVER (PARTITION BY part ORDER BY vec_id) - 1 AS n FROM k, range({PARTS}) r(part)),
c0 AS (SELECT part, n AS entry, v FROM p WHERE n < {ENTRIES}), {", ".join(steps)},
h AS (SELECT sha256(string_agg(x::VARCHAR, ',' ORDER BY part, entry, pos)) AS codebooks_sha256 FROM (SELECT part, entry, unnest(v) AS x, unnest(range(len(v))) AS pos FROM c{ROUNDS})),
f AS (SELECT vec_id, label, string_agg(printf('%02x', best.e), '' ORDER BY part) AS code, sum(best.d)::BIGINT AS error FROM a{ROUNDS} GROUP BY vec_id, label)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 FROM f, h
"""


ORACLE = _oracle()
