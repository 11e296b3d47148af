"""Near-duplicate vectors by an epsilon grid order join (operator 3)."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import batch, cut, drop, table
from .components import components

COSINE = 0.98
#: Leading principal dimensions: in the sort key, and in the boxes of intervals; vectors' coordinates they are made of.
KEY_DIMS, BOX_DIMS, MOST_COORDINATES = 4, 16, 256
#: Vectors in an interval that travels, and its bytes; vectors in one that is compared outright; intervals whose boxes are
#: first seen as one.  A label's vectors travel once for each interval they meet, so few large intervals travel least.
BLOCK, BLOCK_BYTES, LEAF, SUPER = 4096, 4_000_000, 256, 16

_ROWS = "vec_id long, label long, key binary, data binary"
_ROWS_ARROW = pa.schema([("vec_id", pa.int64()), ("label", pa.int64()), ("key", pa.binary()), ("data", pa.binary())])
_BLOCKS = "block long, super long, label long, dim long, n long, lo array<double>, hi array<double>, leaf_lo binary, leaf_hi binary, reps binary, sizes binary, data binary"
_BLOCKS_ARROW = pa.schema([
    ("block", pa.int64()), ("super", pa.int64()), ("label", pa.int64()), ("dim", pa.int64()), ("n", pa.int64()), ("lo", pa.list_(pa.float64())), ("hi", pa.list_(pa.float64())),
    ("leaf_lo", pa.binary()), ("leaf_hi", pa.binary()), ("reps", pa.binary()), ("sizes", pa.binary()), ("data", pa.binary()),
])
_FOUND = "rep long, links long, other long"
_FOUND_ARROW = pa.schema([("rep", pa.int64()), ("links", pa.int64()), ("other", pa.int64())])


def _width(vectors: DataFrame) -> str:
    """The numpy type that vectors travel in: that of the column, so single precision stays half as long."""
    return "<f4" if vectors.schema["embedding"].dataType.simpleString() == "array<float>" else "<f8"


def _rows(vectors: DataFrame) -> DataFrame:
    """vec_id, label, key (of equal vectors under equal labels), data; key is null for what links with nothing."""
    width = _width(vectors)

    def run(batches):
        for b in batches:
            keys, datas = [], []
            ids, labels, lists = b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)
            values = np.asarray(lists.values.to_numpy(zero_copy_only=False), np.float64) + 0.0  # a null component is NaN
            size, kept, edges = np.abs(values), values.astype(width), lists.offsets.to_pylist()
            for vec_id, label, valid, i, j in zip(ids, labels, lists.is_valid().to_pylist(), edges, edges[1:], strict=False):
                key = data = None
                if vec_id is not None and label is not None and valid and j > i:
                    top = size[i:j].max()
                    if math.isfinite(top) and top > 0:
                        data = kept[i:j].tobytes()
                        key = xxhash.xxh3_128_digest(f"{label} {j - i} ".encode() + data)
                keys.append(key)
                datas.append(data)
            yield batch(_ROWS_ARROW, ids, labels, keys, datas)

    narrow = vectors.select(F.col("vec_id").cast("bigint"), F.col("label").cast("bigint"), F.col("embedding").cast("array<double>"))
    return narrow.mapInArrow(run, _ROWS)


def _basis(classes: DataFrame, dim: int, width: str) -> np.ndarray:
    """Leading principal directions (columns) of all vectors of the commonest length; only min(dim, 256) coordinates
    take part, so what comes to the driver is bounded."""
    d = min(dim, MOST_COORDINATES)

    def run(batches):
        total = np.zeros((d + 1, d + 1))
        for b in batches:
            rows = [np.frombuffer(x, width).astype(np.float64) for x in b.column(0).to_pylist()]
            rows = [r / (np.abs(r).max() or 1) for r in rows if len(r) == dim]
            if rows:
                u = np.array(rows)
                u = (u / np.sqrt((u * u).sum(axis=1, keepdims=True)))[:, :d]
                u = np.hstack([u, np.ones((len(u), 1))])
                total += u.T @ u
        yield batch(pa.schema([("at", pa.int64()), ("s", pa.float64())]), np.arange(total.size), total.ravel())

    sums = classes.select("data").mapInArrow(run, "at long, s double").groupBy("at").agg(F.sum("s").alias("s")).toArrow()
    gram = np.zeros((d + 1) ** 2)
    gram[sums.column(0).to_numpy()] = sums.column(1).to_numpy()
    gram = gram.reshape(d + 1, d + 1)
    n = max(gram[d, d], 1)
    cov = gram[:d, :d] / n - np.outer(gram[:d, d], gram[:d, d]) / n**2
    _, vectors = np.linalg.eigh(cov)
    return np.vstack([vectors[:, ::-1][:, :BOX_DIMS], np.zeros((dim - d, min(BOX_DIMS, d)))])


def _units(data: bytes, n: int, width: str) -> np.ndarray:
    u = np.frombuffer(data, width).astype(np.float64).reshape(n, -1)
    u = u / np.abs(u).max(axis=1, keepdims=True)  # neither overflow nor underflow in the squares
    return u / np.sqrt((u * u).sum(axis=1, keepdims=True))


def _project(u: np.ndarray, basis: np.ndarray) -> np.ndarray:
    """Coordinates along orthonormal directions: no two vectors come further apart.  Vectors of another length than
    the basis take their own first coordinates."""
    p = u @ basis if u.shape[1] == len(basis) else u[:, :BOX_DIMS]
    return np.pad(p, ((0, 0), (0, BOX_DIMS - p.shape[1])))


def spanning(mask: np.ndarray) -> list[tuple[int, int]]:
    """Row-column pairs that connect what the whole mask connects."""
    rows_left, cols_left, out = mask.any(axis=1), mask.any(axis=0), []
    while rows_left.any():
        front = [int(np.argmax(rows_left))]
        rows_left[front[0]] = False
        while front:
            i = front.pop()
            for j in np.flatnonzero(mask[i] & cols_left):
                cols_left[j] = False
                out.append((i, int(j)))
                for k in np.flatnonzero(mask[:, j] & rows_left):
                    rows_left[k] = False
                    out.append((int(k), int(j)))
                    front.append(int(k))
    return out


class _Join:
    """The recursive join of two intervals of the epsilon grid order."""

    def __init__(self, ua, pa_, ub, pb, sizes_a, sizes_b, same: bool, cosine: float, reach2: float, leaf: int):
        self.ua, self.pa, self.ub, self.pb, self.same, self.leaf = ua, pa_, ub, pb, same, leaf
        self.fa, self.fb = ua.astype(np.float32), ub.astype(np.float32)
        # Single precision is off by less than this; what may reach the cosine is compared in double precision.
        self.nearly = np.float32(cosine - 3e-7 * (ua.shape[1] + 16))
        self.sizes_a, self.sizes_b, self.cosine, self.reach2 = sizes_a, sizes_b, cosine, reach2
        self.links_a, self.links_b = np.zeros(len(ua), np.int64), np.zeros(len(ub), np.int64)
        n = len(ua) + (0 if same else len(ub))
        self.parent, self.shift = list(range(n)), 0 if same else len(ua)

    def root(self, i: int) -> int:
        while self.parent[i] != i:
            self.parent[i] = i = self.parent[self.parent[i]]
        return i

    def join(self, a0: int, a1: int, b0: int, b1: int) -> None:
        if self.same and b1 <= a0:  # the mirror of an interval pair that is joined anyway
            return
        pa_, pb = self.pa[a0:a1], self.pb[b0:b1]
        gap = np.maximum(0, np.maximum(pa_.min(axis=0) - pb.max(axis=0), pb.min(axis=0) - pa_.max(axis=0)))
        if gap @ gap > self.reach2:
            return
        if max(a1 - a0, b1 - b0) <= self.leaf:
            return self.compare(a0, a1, b0, b1)
        if a1 - a0 > self.leaf:
            m = (a0 + a1) // 2
            if self.same and (a0, a1) == (b0, b1):
                self.join(a0, m, a0, m)
                self.join(a0, m, m, a1)
                return self.join(m, a1, m, a1)
            self.join(a0, m, b0, b1)
            return self.join(m, a1, b0, b1)
        m = (b0 + b1) // 2
        self.join(a0, a1, b0, m)
        self.join(a0, a1, m, b1)

    def compare(self, a0: int, a1: int, b0: int, b1: int) -> None:
        if not (self.fa[a0:a1] @ self.fb[b0:b1].T >= self.nearly).any():
            return
        mask = self.ua[a0:a1] @ self.ub[b0:b1].T >= self.cosine
        own = self.same and a0 == b0
        if own:
            np.fill_diagonal(mask, False)
        if not mask.any():
            return
        self.links_a[a0:a1] += mask @ self.sizes_b[b0:b1]
        if not own:
            (self.links_a if self.same else self.links_b)[b0:b1] += self.sizes_a[a0:a1] @ mask
        for i, j in spanning(mask):
            x, y = self.root(a0 + i), self.root(self.shift + b0 + j)
            if x != y:
                self.parent[max(x, y)] = min(x, y)


def _meet(boxes: DataFrame, reach: float) -> DataFrame:
    """block, other: pairs of intervals of one label and length that hold leaves whose boxes come near enough.

    Boxes of up to SUPER intervals in a row are compared first, in the stripes of the first dimension that they reach;
    then those of their intervals, dealt by the pair, so an interval of a hot label is no hot key; then their leaves'.
    """
    stripe = lambda x: F.floor(x / F.lit(reach))
    edges = [f(F.col(c)[i]).alias(f"{c}{i}") for c, f in (("lo", F.min), ("hi", F.max)) for i in range(BOX_DIMS)]
    whole = boxes.groupBy("super", "label", "dim").agg(*edges)
    left = whole.withColumn("stripe", F.explode(F.sequence(stripe(F.col("lo0") - F.lit(reach)), stripe(F.col("hi0") + F.lit(reach)))))
    right = whole.select(F.col("super").alias("other_super"), "label", "dim", *[F.col(f"{c}{i}").alias(f"other_{c}{i}") for c in ("lo", "hi") for i in range(BOX_DIMS)], F.explode(F.sequence(stripe(F.col("lo0")), stripe(F.col("hi0")))).alias("stripe"))
    gap = sum((F.greatest(F.lit(0.0), F.col(f"lo{i}") - F.col(f"other_hi{i}"), F.col(f"other_lo{i}") - F.col(f"hi{i}")) ** 2 for i in range(BOX_DIMS)), F.lit(0.0))
    supers = left.join(right, ["label", "dim", "stripe"]).where((F.col("super") <= F.col("other_super")) & (gap <= reach * reach)).select("super", "other_super").distinct()
    own = boxes.select("super", "block", "leaf_lo", "leaf_hi")
    both = supers.join(own, "super").join(own.select(F.col("super").alias("other_super"), F.col("block").alias("other"), F.col("leaf_lo").alias("other_lo"), F.col("leaf_hi").alias("other_hi")), "other_super")
    kind = pa.schema([("block", pa.int64()), ("other", pa.int64())])

    def near(batches):
        for b in batches:
            met = []
            for x in zip(*(c.to_pylist() for c in b.columns[2:]), strict=True):
                lo, hi, lo2, hi2 = (np.frombuffer(v, np.float64).reshape(-1, BOX_DIMS) for v in x)
                gap = np.maximum(0, np.maximum(lo[:, None] - hi2[None], lo2[None] - hi[:, None]))
                met.append(bool(((gap * gap).sum(axis=2) <= reach * reach).any()))
            at = np.flatnonzero(met)
            yield batch(kind, b.column(0).take(pa.array(at)), b.column(1).take(pa.array(at)))

    pairs = both.where("block <= other").select("block", "other", "leaf_lo", "leaf_hi", "other_lo", "other_hi")
    return pairs.mapInArrow(near, "block long, other long")


def near_duplicates(vectors: DataFrame, cosine: float = COSINE, block_size: int = BLOCK, leaf: int = LEAF) -> DataFrame:
    """Columns vec_id, n_links, component_id, kept for each row of `vectors` (vec_id, embedding, label).

    Two rows link if their labels are equal and not null, their vectors have one length and a cosine >= `cosine` in
    double precision.  Rows whose vector is null, empty, zero or holds a null or non-finite component, and rows without
    a label or id, link with nothing: they have no links, their own id as component, and are kept if they have an id.
    Repeated rows are vectors of their own and link with each other.  Equal vectors are joined once, as one class with
    a size, so a group of copies costs as much as one vector.  Other columns are ignored; an empty table gives an empty
    one.

    Classes are sorted in epsilon grid order (cells as wide as the largest distance of linked unit vectors, on leading
    principal dimensions), cut into intervals of at most `block_size` (fewer if they are over BLOCK_BYTES), and intervals that hold leaves whose boxes come
    near enough travel to each other and are joined recursively.
    """
    spark, width = vectors.sparkSession, _width(vectors)
    size = np.dtype(width).itemsize
    reach = math.sqrt(max(0.0, 2 - 2 * cosine)) * (1 + 1e-9) + 1e-9
    rows, _ = cut(_rows(vectors), "vectors")
    valid = rows.where("key is not null")
    classes, p1 = cut(valid.groupBy("key").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("size"), F.first("label").alias("label"), F.first("data").alias("data")), "classes")
    common = classes.groupBy(F.floor(F.length("data") / size).alias("dim")).count().orderBy(F.desc("count"), "dim").first()
    if common is None:
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.col("vec_id").isNotNull().alias("kept"))
    basis = spark.sparkContext.broadcast(_basis(classes, common.dim, width))

    cells = [f"c{i}" for i in range(KEY_DIMS)]
    kind = "rep long, size long, label long, dim long, data binary, " + ", ".join(f"{c} long" for c in cells)
    kind_arrow = pa.schema([("rep", pa.int64()), ("size", pa.int64()), ("label", pa.int64()), ("dim", pa.int64()), ("data", pa.binary()), *((c, pa.int64()) for c in cells)])

    def place(batches):
        for b in batches:
            data = b.column(3).to_pylist()
            p = np.zeros((len(data), KEY_DIMS))
            for i in range(0, len(data), leaf):
                by_length: dict[int, list[int]] = {}
                for k, x in enumerate(data[i : i + leaf], i):
                    by_length.setdefault(len(x), []).append(k)
                for own in by_length.values():
                    p[own] = _project(_units(b"".join(data[k] for k in own), len(own), width), basis.value)[:, :KEY_DIMS]
            yield batch(kind_arrow, b.column(0), b.column(1), b.column(2), [len(x) // size for x in data], b.column(3), *np.floor(p / reach).astype(np.int64).T)

    def block(batches):
        held, n, first, of = [], 0, 0, None

        def made():
            nonlocal n, first, of
            u = _units(b"".join(x[4] for x in held), len(held), width)
            p = _project(u, basis.value)
            if of != held[0][2:4]:
                of, first = held[0][2:4], n
            at = TaskContext.get().partitionId() << 32
            own = at + n, at + first + (n - first) // SUPER * SUPER
            n += 1
            cuts = range(0, len(held), leaf)
            lo, hi = (np.array([f(p[i : i + leaf], axis=0) for i in cuts]) for f in (np.min, np.max))
            return *own, *of, len(held), lo.min(axis=0), hi.max(axis=0), lo.tobytes(), hi.tobytes(), np.array([x[0] for x in held]).tobytes(), np.array([x[1] for x in held]).tobytes(), b"".join(x[4] for x in held)

        for b in batches:
            out = []
            for row in zip(*(b.column(i).to_pylist() for i in range(5)), strict=True):
                if held and (row[2:4] != held[0][2:4] or len(held) >= min(block_size, max(1, BLOCK_BYTES // len(row[4])))):
                    out.append(made())
                    held = []
                held.append(row)
            if out:
                yield batch(_BLOCKS_ARROW, *zip(*out, strict=True))
        if held:
            yield batch(_BLOCKS_ARROW, *zip(*[made()], strict=True))

    placed = classes.select("rep", "size", "label", "data").mapInArrow(place, kind)
    ordered = placed.repartitionByRange("label", "dim", *cells, "rep").sortWithinPartitions("label", "dim", *cells, "rep")
    blocks, p2 = cut(ordered.mapInArrow(block, _BLOCKS), "blocks")
    pairs, p3 = cut(_meet(blocks.select("block", "super", "label", "dim", "lo", "hi", "leaf_lo", "leaf_hi"), reach), "pairs")
    payload = blocks.select("block", "n", "reps", "sizes", "data")
    two = pairs.join(payload, "block").join(payload.select(*[F.col(c).alias(f"{c}2") for c in payload.columns]), F.col("other") == F.col("block2"))

    def compare(batches):
        for b in batches:
            for r in b.to_pylist():
                same = r["block"] == r["other"]
                ua, ub = _units(r["data"], r["n"], width), _units(r["data2"], r["n2"], width)
                ra, rb = np.frombuffer(r["reps"], np.int64), np.frombuffer(r["reps2"], np.int64)
                j = _Join(ua, _project(ua, basis.value), ub, _project(ub, basis.value), np.frombuffer(r["sizes"], np.int64), np.frombuffer(r["sizes2"], np.int64), same, cosine, reach * reach, leaf)
                j.join(0, len(ua), 0, len(ub))
                ids, links = (ra, j.links_a) if same else (np.concatenate([ra, rb]), np.concatenate([j.links_a, j.links_b]))
                if len(at := np.flatnonzero(links)):
                    # Each linked vector hangs on the smallest id it reaches here, so what lies in one pair is a star already.
                    roots, least = [j.root(int(k)) for k in at], np.full(len(ids), np.iinfo(np.int64).max)
                    np.minimum.at(least, roots, ids[at])
                    yield batch(_FOUND_ARROW, ids[at], links[at], least[roots])

    found, p4 = cut(two.select("block", "other", "n", "reps", "sizes", "data", "n2", "reps2", "sizes2", "data2").mapInArrow(compare, _FOUND), "links")
    links = found.groupBy("rep").agg(F.sum("links").alias("links"))
    roots = components(found.select("rep", "other"), "rep", "other")
    of, _ = cut(classes.select("key", "rep", "size").join(links, "rep", "left").join(roots, F.col("rep") == F.col("node"), "left").select(
        "key", (F.col("size") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("root", "rep").alias("component_id")), "classes")
    drop(spark, p1, p2, p3, p4)
    out = rows.select("vec_id", "key").join(of, "key", "left")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id")).withColumn(
        "kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


def op3_vector_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """near_duplicates() of all `embeddings` at a cosine of 0.98; null, zero, odd and repeated rows as there."""
    return near_duplicates(table(spark, sf_dir, "embeddings"))


ORACLE = """
WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings WHERE label IS NOT NULL AND len(embedding) > 0
  AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
l AS (SELECT a.vec_id AS x, b.vec_id AS y FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= 0.98),
r AS (SELECT x, y FROM l UNION SELECT r.x, l.y FROM r JOIN l ON r.y = l.x),
c AS (SELECT x, min(y) AS least FROM r GROUP BY x),
n AS (SELECT x, count(*) AS n FROM l GROUP BY x)
SELECT vec_id, coalesce(n, 0) AS n_links, least(vec_id, coalesce(least, vec_id)) AS component_id, vec_id <= coalesce(least, vec_id) AS kept
FROM embeddings LEFT JOIN c ON vec_id = c.x LEFT JOIN n ON vec_id = n.x
"""
