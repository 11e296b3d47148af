"""Hard negatives by inner product, through a pivot table (operator 11)."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import batch, cut, drop, floored, table

POSITIVES, NEGATIVES, SCALE = 5, 3, 256
#: Integer components, and squared lengths, are smaller than these, so every score is a 64-bit integer.
MOST, MOST_SQUARED = 2**31, 2**57
#: Pivots, and the rows of a bounded sample that they are chosen from; they decide what is measured, never what is found.
PIVOTS, SAMPLE = 8, 2048
#: Rows in a group that travels, and in a leaf that is bounded as one; anchors in a block; groups that meet a copy of it.
GROUP, LEAF, BLOCK, STRIPE = 4096, 512, 2048, 64
#: Anchors that meet a leaf at a time.
TILE = 256
#: Anchors of a tile that try a leaf's rows by pivots first; if more than a PRUNED-th of them survive, all are multiplied.
TRIED, PRUNED = 8, 8
_NONE = np.iinfo(np.int64).min

_ROWS = "vec_id long, label long, square long, data binary"
_ROWS_ARROW = pa.schema([("vec_id", pa.int64()), ("label", pa.int64()), ("square", pa.int64()), ("data", pa.binary())])
_PLACED = "vec_id long, label long, dim long, data binary, far binary, near double"
_PLACED_ARROW = pa.schema([("vec_id", pa.int64()), ("label", pa.int64()), ("dim", pa.int64()), ("data", pa.binary()), ("far", pa.binary()), ("near", pa.float64())])
_GROUPS = "group long, label long, dim long, ids binary, data binary, far binary"
_GROUPS_ARROW = pa.schema([("group", pa.int64()), ("label", pa.int64()), ("dim", pa.int64()), *((c, pa.binary()) for c in ("ids", "data", "far"))])
_FOUND = "anchor_id long, place int, vec_id long, score long"
_FOUND_ARROW = pa.schema([("anchor_id", pa.int64()), ("place", pa.int32()), ("vec_id", pa.int64()), ("score", pa.int64())])


def _rows(vectors: DataFrame, scale: int) -> DataFrame:
    def run(batches):
        for b in batches:
            values, edges, good = floored(b.column(1), scale, MOST)
            data, out = values.astype("<i4"), []
            for i in np.flatnonzero(good):
                x = values[edges[i] : edges[i + 1]].astype(np.float64)
                if x @ x < MOST_SQUARED:
                    out.append((i, int((values[edges[i] : edges[i + 1]] ** 2).sum()), data[edges[i] : edges[i + 1]].tobytes()))
            at = pa.array([x[0] for x in out], pa.int64())
            yield batch(_ROWS_ARROW, b.column(0).take(at), b.column(2).take(at), [x[1] for x in out], [x[2] for x in out])

    known = vectors.select(F.col("vec_id").cast("bigint"), F.col("embedding").cast("array<double>"), F.col("label").cast("bigint")).where("vec_id is not null and label is not null")
    one = known.mapInArrow(run, _ROWS).groupBy("vec_id").agg(F.min(F.struct("label", "square", "data")).alias("r"))
    return one.select("vec_id", "r.label", "r.square", "r.data")


class Pivots:
    """Pivots on a sphere that holds all rows.

    A row x becomes (x, sqrt(M - x.x)), where M is the greatest squared length, an anchor q becomes (q, 0).  Then the
    squared distance is q.q + M - 2 q.x, so a score is bracketed by distances, and those by the triangle inequality over
    the distances of both to each pivot.  Vectors of another length than the sample's have one pivot, (0, sqrt(M)).
    """

    def __init__(self, sample: np.ndarray, greatest: int, count: int):
        self.greatest, self.count = greatest, count
        chosen = np.empty((0, sample.shape[1])), np.empty(0)
        if len(sample):  # each pivot is the sample's farthest row from those before
            far, at = np.full(len(sample), np.inf), 0
            for _ in range(count):
                chosen = np.vstack([chosen[0], sample[at]]), np.append(chosen[1], self._raised((sample[at : at + 1] ** 2).sum(axis=1)))
                far = np.minimum(far, self._apart(sample, self._raised((sample**2).sum(axis=1)), chosen[0][-1:], chosen[1][-1:])[:, 0])
                at = int(np.argmax(far))
        self.points, self.heights = chosen

    def _raised(self, squares: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum(0.0, self.greatest - squares))

    @staticmethod
    def _apart(x: np.ndarray, heights: np.ndarray, points: np.ndarray, tops: np.ndarray) -> np.ndarray:
        out = np.empty((len(x), len(points)))
        for j, (p, top) in enumerate(zip(points, tops, strict=True)):
            d = x - p
            out[:, j] = np.sqrt((d * d).sum(axis=1) + (heights - top) ** 2)
        return out

    def distances(self, x: np.ndarray, squares: np.ndarray, anchors: bool) -> np.ndarray:
        """Of each row, or anchor, to each pivot."""
        heights = np.zeros(len(x)) if anchors else self._raised(squares.astype(np.float64))
        if x.shape[1] == self.points.shape[1] and len(self.points):
            return self._apart(x.astype(np.float64), heights, self.points, self.heights)
        return self._apart(x.astype(np.float64), heights, np.zeros((1, x.shape[1])), np.array([math.sqrt(self.greatest)])).repeat(self.count, axis=1)


def merged(scores: np.ndarray, ids: np.ndarray, slot: np.ndarray, new: np.ndarray, new_ids: np.ndarray) -> None:
    """Bring candidates (slot, score, id) into the best of each slot, higher scores first, then smaller ids; in place."""
    touched, k = np.unique(slot), scores.shape[1]
    s, i, v = np.concatenate([touched.repeat(k), slot]), np.concatenate([ids[touched].ravel(), new_ids]), np.concatenate([scores[touched].ravel(), new])
    order = np.lexsort((i, ~v, s))  # ~v falls as v rises, without overflow
    s, i, v = s[order], i[order], v[order]
    place = np.arange(len(s)) - np.searchsorted(s, s)
    kept = place < k
    scores[s[kept], place[kept]], ids[s[kept], place[kept]] = v[kept], i[kept]


class _Search:
    """The best rows of each slot of one block's anchors, over the groups that it meets one after the other.

    A slot wants the k best scores of [low, high]; an anchor has `each` of them.
    """

    def __init__(self, block: list[dict], pivots: Pivots, k: int, each: int):
        self.ids = np.array([r["vec_id"] for r in block], np.int64)
        self.labels = np.array([r["label"] for r in block], np.int64)
        self.x = np.frombuffer(b"".join(r["data"] for r in block), "<i4").astype(np.int64).reshape(len(block), -1)
        squares = np.array([r["square"] for r in block], np.int64)
        self.far = pivots.distances(self.x, squares, anchors=True)
        self.sum = squares.astype(np.float64) + pivots.greatest
        # Distances are right to 1e-14 of the lengths they are made of, so their squares to far less than this.
        self.slack = 1e-9 * self.sum + 1e-6
        # No partial sum of a score is larger than this, so these types hold it exactly.
        bound = math.sqrt(squares.max()) * math.sqrt(pivots.greatest)
        self.exact = np.float32 if bound < 2**23 else np.float64 if bound < 2**52 else np.int64
        self.factors = self.x.astype(self.exact)
        self.each = each
        self.low = np.array([x for r in block for x in r["low"]], np.int64).reshape(-1, each)
        self.high = np.array([x for r in block for x in r["high"]], np.int64).reshape(-1, each)
        self.scores, self.found = np.full((len(block) * each, k), _NONE), np.zeros((len(block) * each, k), np.int64)

    def least(self) -> np.ndarray:
        """What a score must reach to matter to a slot now."""
        return np.maximum(self.low, self.scores[:, -1].reshape(-1, self.each))

    def meet(self, group: dict, same: bool) -> None:
        own = np.flatnonzero((self.labels == group["label"]) == same)
        if not len(own):
            return
        ids = np.frombuffer(group["ids"], np.int64)
        x, far = np.frombuffer(group["data"], "<i4").reshape(len(ids), -1), np.frombuffer(group["far"], np.float64).reshape(len(ids), -1)
        factors = x.astype(self.exact)
        for at in range(0, len(ids), LEAF):
            leaf = slice(at, at + LEAF)
            near = self._near(own, far[leaf])
            for k in range(0, len(near), TILE):
                self._leaf(near[k : k + TILE], ids[leaf], x[leaf], factors[leaf], far[leaf])

    def _bounds(self, own: np.ndarray) -> tuple[np.ndarray, ...]:
        """What any slot of an anchor needs at least and takes at most, and as distances: at most, at least."""
        least, high = self.least()[own], self.high[own]
        open_ = least <= high
        need, most = np.where(open_, least, np.iinfo(np.int64).max).min(axis=1), np.where(open_, high, _NONE).max(axis=1)
        total, slack = self.sum[own], 2 * self.slack[own]
        with np.errstate(invalid="ignore"):
            reach = np.sqrt(total + slack - 2 * need.astype(np.float64))  # NaN, so nothing, where no score is that high
            beyond = np.sqrt(np.maximum(0.0, total - slack - 2 * most.astype(np.float64)))
        return need, most, reach, beyond

    def _near(self, own: np.ndarray, far: np.ndarray) -> np.ndarray:
        """The anchors for which the leaf as a whole may hold something."""
        _, _, reach, beyond = self._bounds(own)
        q, low, high = self.far[own], far.min(axis=0), far.max(axis=0)
        return own[(np.maximum(q - high, low - q).max(axis=1) <= reach) & ((q + high).min(axis=1) >= beyond)]

    def _survivors(self, own: np.ndarray, far: np.ndarray, reach: np.ndarray, beyond: np.ndarray) -> np.ndarray:
        """Which rows of a leaf the pivots leave to each anchor: |q - f| <= reach and q + f >= beyond."""
        survive = np.ones((len(own), len(far)), bool)
        for j in range(far.shape[1]):
            q = self.far[own, j]
            survive &= (far[None, :, j] >= np.maximum(q - reach, beyond - q)[:, None]) & (far[None, :, j] <= (q + reach)[:, None])
        return survive

    def _leaf(self, own: np.ndarray, ids: np.ndarray, x: np.ndarray, factors: np.ndarray, far: np.ndarray) -> None:
        need, most, reach, beyond = self._bounds(own)
        some = slice(None, None, max(1, len(own) // TRIED))
        tried = self._survivors(own[some], far, reach[some], beyond[some])
        if np.count_nonzero(tried) * PRUNED > tried.size:
            # What is exact in a type is compared in it: a bound beyond its reach is beyond every score as well.
            whole = self.factors[own] @ factors.T
            kept = whole >= need.astype(self.exact)[:, None]
            if (most < np.iinfo(np.int64).max).any():
                kept &= whole <= most.astype(self.exact)[:, None]
            row, col = np.nonzero(kept)
            score = whole[row, col].astype(np.int64)
        else:
            row, col = np.nonzero(self._survivors(own, far, reach, beyond))
            score = (self.x[own[row]] * x[col].astype(np.int64)).sum(axis=1)
        other = np.flatnonzero(self.ids[own[row]] != ids[col])
        row, col, score = row[other], col[other], score[other]
        k = self.scores.shape[1]
        for j in range(self.each):
            slot = own * self.each + j
            least = np.maximum(self.low[own, j], self.scores[slot, -1])
            fit = np.flatnonzero((score >= least[row]) & (score <= self.high[own[row], j]))
            if len(fit) > 4 * k * len(own):  # a first leaf: only what may be among the best of it
                dense = np.full((len(own), len(ids)), _NONE)
                dense[row[fit], col[fit]] = score[fit]
                least = np.maximum(least, np.partition(dense, dense.shape[1] - k, axis=1)[:, -k])
                fit = fit[score[fit] >= least[row[fit]]]
            if len(fit):
                merged(self.scores, self.found, slot[row[fit]], score[fit], ids[col[fit]])

    def result(self) -> pa.RecordBatch:
        slot, place = np.nonzero(self.scores != _NONE)
        return batch(_FOUND_ARROW, self.ids[slot // self.each], (slot % self.each).astype(np.int32), self.found[slot, place], self.scores[slot, place])


def _searched(groups: DataFrame, blocks: DataFrame, stripes: int, sent, k: int, each: int, same: bool) -> DataFrame:
    """anchor_id, place, vec_id, score: for each slot the k best of all rows of the anchor's label (same), or of others.

    Rows stay where their group is; a copy of each block goes to every stripe of groups, and a task keeps one block's
    best while the groups of its stripe pass by.
    """
    left = blocks.withColumn("stripe", F.explode(F.sequence(F.lit(0), F.lit(stripes - 1))))
    right = groups.withColumn("stripe", F.pmod(F.xxhash64("group"), F.lit(stripes)).cast("int"))
    # Dealt by number, so that Spark does not bring stripes, small but much work, together in few tasks.
    dealt = [df.repartition(stripes, "dim", "stripe") for df in (left, right.hint("merge"))]
    pairs = dealt[0].join(dealt[1], ["dim", "stripe"]).select("dim", "block", "stripe", "anchors", "label", "ids", "data", "far")

    def run(batches):
        now = search = None
        for b in batches:
            for i in range(b.num_rows):
                key = tuple(b.column(c)[i].as_py() for c in range(3))
                if key != now:
                    if search is not None:
                        yield search.result()
                    now, search = key, _Search(b.column(3)[i].as_py(), sent.value, k, each)
                search.meet({c: b.column(n)[i].as_py() for n, c in enumerate(("label", "ids", "data", "far"), 4)}, same)
        if search is not None:
            yield search.result()

    return pairs.mapInArrow(run, _FOUND)


def _first(found: DataFrame, n: int) -> DataFrame:
    """The n best of each anchor and slot, with their rank."""
    order = Window.partitionBy("anchor_id", "place").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)


def mine(vectors: DataFrame, is_anchor: Column, positives: int = POSITIVES, negatives: int = NEGATIVES, scale: int = SCALE, pivots: int = PIVOTS, group: int = GROUP, block: int = BLOCK) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score for `vectors` (vec_id, embedding, label).

    Components become floor(scale * x); a row's score is its inner product with the anchor, an integer.  Anchors are the
    rows that `is_anchor` (over vec_id) holds for.  An anchor's positives are its `positives` best other rows of its
    label; for each of them the `negatives` best rows of other labels are found that score at least half and at most 95 %
    of what it scores.  Ties go to the smaller id.

    Rows without an id or label take no part, nor do vectors that are null or empty, or hold a null or non-finite
    component, or one whose integer is 2^31 or more, or have an integer squared length of 2^57 or more.  Of rows with one
    id the one with the smallest label, then the shortest vector, then the smallest bytes counts.  Only vectors of one
    length are compared.  Other columns are ignored; an empty table gives an empty one.
    """
    spark = vectors.sparkSession
    rows, p1 = cut(_rows(vectors, scale), "vectors")
    dims = F.floor(F.length("data") / 4)
    size = rows.groupBy(dims.alias("dim")).agg(F.max("square").alias("m"), F.count(F.lit(1)).alias("n"))
    common = size.orderBy(F.desc("n"), "dim").first()
    greatest = rows.agg(F.max("square")).first()[0]
    if common is None:
        return spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    sample = rows.where(dims == common["dim"]).orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).select("data").collect()
    matrix = np.frombuffer(b"".join(r["data"] for r in sample), "<i4").astype(np.float64).reshape(len(sample), -1)
    table_ = Pivots(matrix, greatest, pivots)
    sent = spark.sparkContext.broadcast(table_)

    def place(batches):
        for b in batches:
            data, squares = b.column(3).to_pylist(), b.column(2).to_numpy(zero_copy_only=False)
            far = np.zeros((len(data), pivots))
            by_length: dict[int, list[int]] = {}
            for i, x in enumerate(data):
                by_length.setdefault(len(x), []).append(i)
            for own in by_length.values():
                x = np.frombuffer(b"".join(data[i] for i in own), "<i4").reshape(len(own), -1)
                far[own] = sent.value.distances(x, squares[own], anchors=False)
            yield batch(_PLACED_ARROW, b.column(0), b.column(1), [len(x) // 4 for x in data], b.column(3), [x.tobytes() for x in far], far[:, 0])

    def gather(batches):
        held, n, first = [], 0, TaskContext.get().partitionId() << 32

        def made():
            nonlocal n
            n += 1
            ids = np.array([x[0] for x in held], np.int64).tobytes()
            return first + n - 1, held[0][1], held[0][2], ids, b"".join(x[3] for x in held), b"".join(x[4] for x in held)

        for b in batches:
            out = []
            for row in zip(*(b.column(i).to_pylist() for i in range(5)), strict=True):
                if held and (row[1:3] != held[0][1:3] or len(held) >= group):
                    out.append(made())
                    held = []
                held.append(row)
            if out:
                yield batch(_GROUPS_ARROW, *zip(*out, strict=True))
        if held:
            yield batch(_GROUPS_ARROW, *zip(*[made()], strict=True))

    placed = rows.mapInArrow(place, _PLACED)
    ordered = placed.repartitionByRange("dim", "label", "near", "vec_id").sortWithinPartitions("dim", "label", "near", "vec_id")
    groups, p2 = cut(ordered.mapInArrow(gather, _GROUPS), "groups")
    stripes = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-groups.count() // STRIPE))
    asking = rows.where(is_anchor)
    blocks = max(1, -(-asking.count() // block))
    anchors = asking.select("vec_id", "label", "square", "data", dims.alias("dim"), F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).alias("block"))

    def blocked(df: DataFrame, low: Column, high: Column) -> DataFrame:
        """A block's anchors are about `block` by the hash of their id, so its row is bounded."""
        return df.groupBy("dim", "block").agg(F.collect_list(F.struct("vec_id", "label", "square", "data", low.alias("low"), high.alias("high"))).alias("anchors"))

    every = F.array(F.lit(_NONE).cast("long")), F.array(F.lit(int(np.iinfo(np.int64).max)).cast("long"))
    found = _searched(groups, blocked(anchors, *every), stripes, sent, positives, 1, same=True)
    near, p3 = cut(_first(found, positives).select("anchor_id", F.col("vec_id").alias("positive_id"), "score", "rank"), "positives")
    # The window of each positive, in whole numbers: at least half of its score, at most 19 twentieths; none beyond them.
    lists = near.groupBy("anchor_id").agg(F.array_sort(F.collect_list(F.struct("rank", "score"))).alias("p"))
    low = F.expr("transform(p, x -> x.score - shiftright(x.score, 1))")
    high = F.expr("transform(p, x -> (x.score * 19 - pmod(x.score * 19, 20L)) div 20L)")
    filled = lambda c, none: F.slice(F.concat(c, F.array_repeat(F.lit(none).cast("long"), positives)), 1, positives)
    windowed = anchors.join(lists, anchors.vec_id == lists.anchor_id)
    found = _searched(groups, blocked(windowed, filled(low, 1), filled(high, 0)), stripes, sent, negatives, positives, same=False)
    best = _first(found, negatives).select("anchor_id", (F.col("place") + 1).alias("at"), "rank", F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"))
    held, _ = cut(best, "negatives")
    drop(spark, p1, p2)
    pairs = near.select("anchor_id", "positive_id", F.col("score").alias("positive_score"), F.col("rank").alias("at"))
    return pairs.join(held, ["anchor_id", "at"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """mine() of all `embeddings`, every 50th a question, the label of every 7th moved on by one first; null, odd and
    repeated rows as there."""
    vectors = table(spark, sf_dir, "embeddings")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine(vectors.select("vec_id", "embedding", moved.alias("label")), F.col("vec_id") % 50 == 0)


ORACLE = f"""
WITH v AS MATERIALIZED (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)) AS e
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS MATERIALIZED (SELECT a.vec_id AS anchor_id, a.label AS own, b.vec_id, b.label, list_dot_product(a.e, b.e)::BIGINT AS score FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE a.vec_id % 50 = 0),
p AS (SELECT * FROM (SELECT anchor_id, vec_id AS positive_id, score AS positive_score, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) AS n FROM s WHERE label = own) WHERE n <= {POSITIVES}),
m AS (SELECT anchor_id, positive_id, vec_id AS negative_id, positive_score, score AS negative_score, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id)::INT AS rank
  FROM p JOIN s USING (anchor_id) WHERE label <> own AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM m WHERE rank <= {NEGATIVES}
"""
