"""Benchmark decontamination by a Wu-Manber search over words (operator 10)."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import batch, cut, drop, narrowed, opened, table, utf8, wrapped

WINDOW = 10
#: Up to this many windows travel whole to the documents.  Of more, only tables of a fixed size travel: a shift for each
#: of 2**SLOT_BITS hashed blocks, and 2**KNOWN_BITS bits of hashed windows.
MOST_WINDOWS = 100_000
SLOT_BITS, KNOWN_BITS = 18, 26
#: What a frequent window's occurrences are dealt over.
SALTS = 8

# The bytes of words, and the map that lowers A-Z and makes all other bytes spaces.
_KEEP = bytes(range(0x30, 0x3A)) + bytes(range(0x41, 0x5B)) + bytes(range(0x61, 0x7B)) + bytes(range(0x80, 0x100))
_MAP = bytes((b + 32 if 0x41 <= b <= 0x5A else b) if b in _KEEP else 0x20 for b in range(256))

_SCHEMA = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, spans array<int>, items array<string>"
_ARROW = pa.schema([
    ("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_hit", pa.int64()), ("n_items", pa.int64()), ("items_sha256", pa.string()),
    ("contaminated", pa.bool_()), ("spans", pa.list_(pa.int32())), ("items", pa.list_(pa.string())),
])


def words(text: bytes | None) -> list[bytes]:
    """The words of UTF-8 bytes; a byte from 0x80 up is always part of one."""
    return text.translate(_MAP).split() if text else []


class WuManber:
    """Finds word sequences of one length `m`.

    Blocks are pairs of words (single words for m = 1).  `shift` says how far the window may move when its last block
    is the given one: blocks that no pattern holds move it past them.  A block with shift 0 ends some patterns: they
    stand in a bucket by that suffix, and each is compared directly.
    """

    def __init__(self, m: int, patterns: dict[tuple[bytes, ...], list[str]]):
        self.m, self.block = m, min(2, m)
        self.far = m - self.block + 1
        self.shift: dict[int, int] = {}
        self.bucket: dict[int, list[tuple[tuple[bytes, ...], list[str]]]] = {}
        for p, owners in patterns.items():
            for end in range(self.block, m + 1):
                h = hash(p[end - self.block : end])
                self.shift[h] = min(self.shift.get(h, self.far), m - end)
            self.bucket.setdefault(hash(p[m - self.block :]), []).append((p, owners))

    def find(self, text: list[bytes]) -> Iterator[tuple[int, list[str]]]:
        """(start, owners) of every occurrence."""
        end, n, m, block, far, shift = self.m, len(text), self.m, self.block, self.far, self.shift.get
        while end <= n:
            by = shift(h := hash(tuple(text[end - block : end])), far)
            if by:
                end += by
                continue
            here = tuple(text[end - m : end])
            for p, owners in self.bucket[h]:
                if p == here:
                    yield end - m, owners
            end += 1


def windows(item_words: list[bytes], size: int) -> list[tuple[bytes, ...]]:
    if len(item_words) < size:
        return [tuple(item_words)] if item_words else []
    return [tuple(item_words[i : i + size]) for i in range(len(item_words) - size + 1)]


def _windows(benchmark: DataFrame, size: int) -> DataFrame:
    """m, window (its words, joined by spaces), h (a hash of both), item: each window of each item once."""
    kind = pa.schema([("m", pa.int32()), ("window", pa.binary()), ("h", pa.int64()), ("item", pa.string())])

    def run(batches):
        for b in batches:
            out = []
            for item, text in zip(b.column(0).to_pylist(), utf8(b.column(1)), strict=True):
                for w in set(windows(words(text), size)):
                    joined = b" ".join(w)
                    out.append((len(w), joined, _hash(joined), item))
                    if len(out) > 20_000:
                        yield batch(kind, *zip(*out, strict=True))
                        out = []
            if out:
                yield batch(kind, *zip(*out, strict=True))

    return narrowed(benchmark, "item_id", "text").mapInArrow(run, "m int, window binary, h long, item string").distinct()


def _hash(window: bytes) -> int:
    h = xxhash.xxh64_intdigest(window)
    return h - (1 << 64) if h >> 63 else h


def _hits(text: list[bytes], searchers: list[WuManber]) -> tuple[list[int], set[str]]:
    """Hit stretches as flat (start, end) pairs, in order and apart; owners of the windows that occur."""
    found, owners = [], set()
    for s in searchers:
        for at, own in s.find(text):
            found.append((at, at + s.m))
            owners.update(own)
    return _spans(found), owners


def _spans(found: list[tuple[int, int]]) -> list[int]:
    spans: list[int] = []
    for a, b in sorted(found):
        if spans and a <= spans[-1]:
            spans[-1] = max(spans[-1], b)
        else:
            spans += (a, b)
    return spans


def _searchers(found: pa.Table) -> list[WuManber]:
    patterns: dict[int, dict[tuple[bytes, ...], list[str]]] = {}
    for m, window, item in zip(*(found.column(c).to_pylist() for c in ("m", "window", "item")), strict=True):
        owners = patterns.setdefault(m, {}).setdefault(tuple(window.split(b" ")), [])
        if item is not None:
            owners.append(item)
    return [WuManber(m, p) for m, p in sorted(patterns.items())]


_MIX = np.uint64(0x9E3779B97F4A7C15)


def _slots(text: list[bytes], block: int) -> np.ndarray:
    """The slot of the block that ends at each word, from the first whole block on."""
    h = np.fromiter(map(crc32, text), np.uint64, len(text)) * _MIX
    if block == 2:
        h = ((h[:-1] >> np.uint64(7)) ^ h[1:]) * _MIX
    return (h >> np.uint64(64 - SLOT_BITS)).astype(np.int64)


class HashedShifts:
    """Wu-Manber shift tables of a fixed size for any number of windows.  Blocks with one slot share the smaller shift,
    so no occurrence is passed over; a position whose shift is 0 and whose window's bit is set is a candidate."""

    def __init__(self, shifts: dict[int, np.ndarray], known: np.ndarray):
        self.shifts, self.known = shifts, known

    def candidates(self, text: list[bytes]) -> Iterator[tuple[int, int, int, bytes]]:
        """(start, m, hash, window)."""
        for m, shift in self.shifts.items():
            block, n = min(2, m), len(text)
            if n < m:
                continue
            by = shift[_slots(text, block)].tolist()
            end = m
            while end <= n:
                if k := by[end - block]:
                    end += k
                    continue
                window = b" ".join(text[end - m : end])
                bit = xxhash.xxh64_intdigest(window) & ((1 << KNOWN_BITS) - 1)
                if self.known[bit >> 3] >> (bit & 7) & 1:
                    yield end - m, m, _hash(window), window
                end += 1


def _tables(keys: DataFrame) -> HashedShifts:
    """From keys(m, window, h): both tables are made by aggregation, so the driver gets no more than their size."""

    def shifts(batches):
        kind = pa.schema([("m", pa.int32()), ("slot", pa.int32()), ("shift", pa.int32())])
        for b in batches:
            least: dict[tuple[int, int], int] = {}
            for m, window in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                block = min(2, m)
                for k, slot in enumerate(_slots(window.split(b" "), block).tolist()):
                    by = m - block - k
                    least[m, slot] = min(least.get((m, slot), by), by)
            if least:
                yield batch(kind, [m for m, _ in least], [s for _, s in least], list(least.values()))

    found = keys.select("m", "window").mapInArrow(shifts, "m int, slot int, shift int").groupBy("m", "slot").agg(F.min("shift").alias("shift")).toArrow()
    of, slot, shift = (found.column(c).to_numpy() for c in ("m", "slot", "shift"))
    out = {}
    for m in np.unique(of).tolist():
        out[m] = np.full(1 << SLOT_BITS, m - min(2, m) + 1, np.uint8 if m < 256 else np.int32)
        out[m][slot[of == m]] = shift[of == m]
    slots = keys.select((F.col("h").bitwiseAND(F.lit((1 << KNOWN_BITS) - 1))).cast("int").alias("bit"))
    bits = slots.selectExpr("shiftright(bit, 3) AS at", "shiftleft(1, bit & 7) AS b").groupBy("at").agg(F.bit_or("b").alias("b")).toArrow()
    known = np.zeros(1 << (KNOWN_BITS - 3), np.uint8)
    known[bits.column(0).to_numpy()] = bits.column(1).to_numpy()
    return HashedShifts(out, known)


def _found(docs: DataFrame, found: DataFrame) -> tuple[DataFrame, DataFrame, str]:
    """For more windows than travel: of each row of docs doc_id, hash (of its text), n_words; and the windows that occur
    in it as (doc_id, hash, at, m, window), compared whole.  Also the path of a table that both read."""
    spark = docs.sparkSession
    keys, held = cut(found.select("m", "window", "h").distinct(), "windows")
    sent = spark.sparkContext.broadcast(_tables(keys))
    kind = "doc_id long, hash long, n_words long, at array<int>, m array<int>, h array<long>, window array<binary>"
    arrow = pa.schema([("doc_id", pa.int64()), ("hash", pa.int64()), ("n_words", pa.int64()), ("at", pa.list_(pa.int32())), ("m", pa.list_(pa.int32())), ("h", pa.list_(pa.int64())), ("window", pa.list_(pa.binary()))])

    def run(batches):
        for b in batches:
            split = [words(x) for x in utf8(b.column(1))]
            met = [[*zip(*sent.value.candidates(w), strict=True)] or [(), (), (), ()] for w in split]
            yield batch(arrow, b.column(0), b.column(2), [len(w) for w in split], *([x[k] for x in met] for k in range(4)))

    each, path = cut(narrowed(docs, "doc_id", "text").withColumn("hash", F.xxhash64("text")).mapInArrow(run, kind), "candidates")
    salt = F.pmod(F.xxhash64("doc_id", "hash", "at"), F.lit(SALTS)).cast("int")
    met = each.select("doc_id", "hash", F.explode(F.arrays_zip("at", "m", "h", "window")).alias("c")).select("doc_id", "hash", "c.*").withColumn("salt", salt)
    own = keys.select("m", "h", F.col("window").alias("whole"), F.explode(F.array(*[F.lit(i) for i in range(SALTS)])).alias("salt"))
    sure, p = cut(met.join(own, ["m", "h", "salt"]).where("window = whole").select("doc_id", "hash", "at", "m", "h", "window").distinct(), "occurrences")
    sent.unpersist()
    drop(spark, held)
    return each.select("doc_id", "hash", "n_words"), sure, p


def _same(a: DataFrame, b: DataFrame):
    return a["doc_id"].eqNullSafe(b["doc_id"]) & (a["hash"] == b["hash"])


def search(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW, most: int = MOST_WINDOWS) -> DataFrame:
    """Columns doc_id, n_words, n_hit, n_items, items_sha256, contaminated, spans, items for each row of `docs`.

    spans: flat pairs of word positions (start, end) that windows of the benchmark cover; items: ids of the items with
    occurring windows, sorted as strings.  A null or empty text has no words; an item without words has no window; an
    item without an id marks words but is not listed; a null doc_id stays null; repeated rows are judged alike; other
    columns are ignored; an empty benchmark hits nothing.

    Up to `most` windows the documents are not shuffled.  Of more windows none travels: tables of a fixed size find
    candidates, which meet the windows by hash and are compared whole.  The rows are the same either way.
    """
    found, path = cut(_windows(benchmark, size), "benchmark")
    few = found.limit(most + 1).toArrow()
    if few.num_rows <= most:
        drop(docs.sparkSession, path)
        return _search_few(docs, few)
    each, sure, _ = _found(docs, found)
    places = sure.groupBy("doc_id", "hash").agg(F.collect_set(F.struct("at", (F.col("at") + F.col("m")).alias("end"))).alias("found"))
    owned = sure.select("doc_id", "hash", "m", "h", "window").distinct().join(found.where("item is not null"), ["m", "h", "window"])
    items = owned.select("doc_id", "hash", "item").distinct().groupBy("doc_id", "hash").agg(F.collect_list("item").alias("items"))
    places, items = places.alias("p"), items.alias("i")
    both = places.join(items, _same(places, items), "left").select("p.doc_id", "p.hash", "found", "items")
    whole = each.join(both, _same(each, both), "left").select(each["doc_id"], "n_words", "found", "items")

    def run(batches):
        for b in batches:
            spans = [_spans([(x["at"], x["end"]) for x in places or ()]) for places in b.column(2).to_pylist()]
            yield _judged(b.column(0), b.column(1).to_pylist(), spans, b.column(3).to_pylist())

    return whole.mapInArrow(run, _SCHEMA)


def _judged(ids, n_words: list[int], spans: list[list[int]], items: list) -> pa.RecordBatch:
    hit = [sum(s[1::2]) - sum(s[::2]) for s in spans]
    listed = [sorted(x or ()) for x in items]
    return batch(_ARROW, ids, n_words, hit, [len(x) for x in listed], [hashlib.sha256(",".join(x).encode()).hexdigest() for x in listed], [h > 0 for h in hit], spans, listed)


def _search_few(docs: DataFrame, few: pa.Table) -> DataFrame:
    sent = docs.sparkSession.sparkContext.broadcast(few)

    def run(batches):
        tables = _searchers(sent.value)
        for b in batches:
            split = [words(x) for x in utf8(b.column(1))]
            found = [_hits(w, tables) for w in split]
            yield _judged(b.column(0), [len(w) for w in split], [x[0] for x in found], [x[1] for x in found])

    return narrowed(docs, "doc_id", "text").mapInArrow(run, _SCHEMA)


def without_contaminated(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW, most: int = MOST_WINDOWS) -> DataFrame:
    """The rows of `docs`, with all their columns, in whose text no window of the benchmark occurs.

    Rows with a null or empty text stay, as do all rows for an empty benchmark; repeated rows are judged alike; columns
    of any name pass through; an empty table gives an empty one.
    """
    found, path = cut(_windows(benchmark, size), "benchmark")
    few = found.limit(most + 1).toArrow()
    if few.num_rows > most:
        _, sure, _ = _found(docs, found)
        row = wrapped(docs, doc_id=F.col("doc_id").cast("bigint"), hash=F.xxhash64(F.col("text").cast("string")))
        return row.join(hit := sure.select("doc_id", "hash").distinct(), _same(row, hit), "left_anti").select(*opened(docs.columns))
    drop(docs.sparkSession, path)
    sent, at = docs.sparkSession.sparkContext.broadcast(few), docs.columns.index("text")

    def run(batches):
        tables = _searchers(sent.value)
        for b in batches:
            split = [words(x) for x in utf8(b.column(at))]
            yield b.filter(pa.array([all(next(s.find(w), None) is None for s in tables) for w in split], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """search() of all `documents` for the windows of 10 words of all `benchmark` items, without spans and items; what
    it says of null, empty, repeated and extra input holds."""
    found = search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.drop("spans", "items")


_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
_WINDOWS = "unnest(list_transform(range(1, len(w) - m + 2), lambda i: array_to_string(w[i:i + m - 1], ' '))) AS t"

ORACLE = f"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT item_id, w, least(len(w), 10) AS m FROM (SELECT item_id, {_WORDS} AS w FROM benchmark) WHERE len(w) > 0),
p AS (SELECT DISTINCT item_id, m, {_WINDOWS} FROM b),
sizes AS (SELECT DISTINCT m FROM p),
o AS (SELECT k, m, unnest(range(0, len(w) - m + 1)) AS i, {_WINDOWS} FROM d, sizes WHERE len(w) >= m),
h AS (SELECT k, i, m, item_id FROM o JOIN p USING (m, t)),
n AS (SELECT k, count(DISTINCT j) AS n_hit FROM (SELECT DISTINCT k, unnest(range(i, i + m)) AS j FROM h) GROUP BY k),
s AS (SELECT k, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT k, item_id::VARCHAR AS item FROM h WHERE item_id IS NOT NULL) GROUP BY k)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN n USING (k) LEFT JOIN s USING (k)
"""
