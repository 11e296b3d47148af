"""Line deduplication by a fixed-depth tree of line templates (operator 8)."""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import batch, cut, drop, narrowed, opened, table, utf8, wrapped

#: Leading words in a path of the tree; share of words that a line has in common with its template.
DEPTH, SIMILARITY = 3, 0.8
#: A template recurs if two documents hold it; one of fewer words than SHORT only if it has this support.
SHORT, SHORT_SUPPORT = 8, 10
#: A leaf with more distinct lines than this is settled in rounds, by tasks of about so many lines.
FULL = 20_000
FIELD = b"<*>"
NOBODY = (1 << 63) - 1

_DIGIT = re.compile(rb"[0-9]")
_LINES = "path binary, line binary, docs long, first long, last long, low long, high long"
_LINES_ARROW = pa.schema([("path", pa.binary()), ("line", pa.binary()), ("docs", pa.int64()), ("first", pa.int64()), ("last", pa.int64()), ("low", pa.int64()), ("high", pa.int64())])

_PLACED = f"{_LINES}, at long, founder long, apart array<int>"
_PLACED_ARROW = pa.schema([*_LINES_ARROW, ("at", pa.int64()), ("founder", pa.int64()), ("apart", pa.list_(pa.int32()))])
_SETTLED = "digest binary, template binary, support long, keeper long, keeper_hash long"
_SETTLED_ARROW = pa.schema([("digest", pa.binary()), ("template", pa.binary()), ("support", pa.int64()), ("keeper", pa.int64()), ("keeper_hash", pa.int64())])


def masked(line: bytes) -> bytes:
    """The words of a line, one space apart; those with a digit are variable fields."""
    words = line.split()
    return b" ".join([FIELD if _DIGIT.search(w) else w for w in words] if _DIGIT.search(line) else words)


def path(words: list[bytes], depth: int) -> bytes:
    return b"%d " % len(words) + b" ".join(words[:depth])


def may_differ(n: int, similarity: float) -> int:
    """In how many of its n places a line may differ from its template's founder."""
    return int(n * (1 - similarity) + 1e-9)


def _text_lines(text: bytes | None) -> dict[bytes, list[int]]:
    """Masked line -> its positions, blank lines left out."""
    out: dict[bytes, list[int]] = {}
    for i, line in enumerate((text or b"").split(b"\n")):
        if m := masked(line):
            out.setdefault(m, []).append(i)
    return out


def _all() -> list[Column]:
    """docs, first, last, low and high of several rows."""
    return [F.sum("docs").alias("docs"), F.min("first").alias("first"), F.max("last").alias("last"), F.min("low").alias("low"), F.max("high").alias("high")]


def _both(a: Sequence, b: Sequence) -> list:
    """docs, first, last, low and high of two together."""
    low, high = [x for x in (a[3], b[3]) if x is not None], [x for x in (a[4], b[4]) if x is not None]
    return [a[0] + b[0], min(a[1], b[1]), max(a[2], b[2]), min(low, default=None), max(high, default=None)]


def _recurs(first: int, last: int, low: int | None, high: int | None) -> bool:
    """Whether two documents hold it: two ids, an id and none, or two texts without an id."""
    return first != last or first == NOBODY and low != high


def digest(line: bytes) -> bytes:
    return xxhash.xxh3_128_digest(line)


def distinct_lines(docs: DataFrame, depth: int = DEPTH, similarity: float = SIMILARITY) -> DataFrame:
    """Each masked line once, with the number of documents that hold it, the least and greatest of their ids, and of the
    hashes of the texts without an id.  Lines too short to differ anywhere have all their words as their path."""

    def run(batches):
        held: dict[bytes, list[int]] = {}

        def leaf_of(line):
            words = line.split(b" ")
            return path(words, depth if may_differ(len(words), similarity) else len(words))

        def made():
            lines = [*held]
            counts = [*held.values()]
            held.clear()
            return batch(_LINES_ARROW, [leaf_of(x) for x in lines], lines, *([c[k] for c in counts] for k in range(5)))

        size = 0
        for b in batches:
            for doc_id, text, h in zip(b.column(0).to_pylist(), utf8(b.column(1)), b.column(2).to_pylist(), strict=True):
                doc_id = NOBODY if doc_id is None else doc_id
                for line in _text_lines(text):
                    if (c := held.get(line)) is None:
                        held[line] = [1, doc_id, doc_id, h, h]
                        size += len(line) + 150
                    else:
                        c[0] += 1
                        c[1], c[2] = min(c[1], doc_id), max(c[2], doc_id)
                        if h is not None:
                            c[3], c[4] = (h, h) if c[3] is None else (min(c[3], h), max(c[4], h))
                if size > 60_000_000:
                    yield made()
                    size = 0
        if held:
            yield made()

    hashed = narrowed(docs, "doc_id", "text").withColumn("h", F.when(F.col("doc_id").isNull(), F.xxhash64("text")))
    return hashed.mapInArrow(run, _LINES).groupBy("path", "line").agg(*_all())


class Leaf:
    """The templates of one leaf.  A line joins the earliest template whose founding line it equals in enough places;
    places where they differ become variable fields.  Founders are found by equal stretches of the words after the path:
    of one more stretch than places may differ, one at least is equal."""

    def __init__(self, n: int, similarity: float, depth: int):
        self.n, self.may_differ = n, may_differ(n, similarity)
        depth = min(depth, n)
        edges = [depth + (n - depth) * k // (self.may_differ + 1) for k in range(self.may_differ + 2)]
        self.stretches = [*zip(edges, edges[1:], strict=False)]
        self.founders: list[list[bytes]] = []
        self.fields: list[set[int]] = []
        self.index: dict[tuple, list[int]] = {}

    def find(self, words: list[bytes]) -> tuple[int, list[int]] | None:
        """The earliest template that fits, and the places where the line differs from its founder."""
        if self.may_differ and self.founders:
            met = {k for i, (a, b) in enumerate(self.stretches) for k in self.index.get((i, *words[a:b]), ())}
            for k in sorted(met):
                apart = [i for i, (x, y) in enumerate(zip(words, self.founders[k], strict=True)) if x != y]
                if len(apart) <= self.may_differ:
                    return k, apart
        return None

    def found(self, words: list[bytes]) -> int:
        k = len(self.founders)
        self.founders.append(words)
        self.fields.append(set())
        if self.may_differ:
            for i, (a, b) in enumerate(self.stretches):
                self.index.setdefault((i, *words[a:b]), []).append(k)
        return k

    def add(self, words: list[bytes]) -> int:
        if fit := self.find(words):
            self.fields[fit[0]].update(fit[1])
            return fit[0]
        return self.found(words)

    def template(self, k: int) -> bytes:
        return _template(self.founders[k], self.fields[k])


def _template(words: list[bytes], fields: set[int]) -> bytes:
    return b" ".join(FIELD if i in fields else w for i, w in enumerate(words))


def _placed(lines: DataFrame, similarity: float, depth: int, grow: bool) -> DataFrame:
    """Each line with its template's founder, and the places where the two differ.

    Known lines are founders to meet, and are not returned.  A line that fits none founds a template if they may grow,
    else its founder is null.
    """

    def run(batches):
        now, leaf, at_of = None, None, []
        for b in batches:
            out = []
            for p, line, *sums, at, part, known in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if (p, part) != now:
                    now, leaf, at_of = (p, part), Leaf(int(p.split(b" ", 1)[0]), similarity, depth), []
                words = line.split(b" ")
                fit = None if known else leaf.find(words)
                if known or grow and fit is None:
                    leaf.found(words)
                    at_of.append(at)
                if not known:
                    founder, apart = (at_of[fit[0]], fit[1]) if fit else (at if grow else None, [])
                    out.append((p, line, *sums, at, founder, apart))
            if out:
                yield batch(_PLACED_ARROW, *zip(*out, strict=True))

    dealt = lines.repartition("path", "part").sortWithinPartitions("path", "part", F.desc("known"), "at")
    return dealt.mapInArrow(run, _PLACED)


def _crowded(lines: DataFrame, depth: int, similarity: float, short: int, short_support: int, full: int) -> DataFrame:
    """recurring() for leaves of any size, with the templates that one pass over a leaf in its order would find.

    In each round the first lines of a leaf, at most `full`, settle among themselves in one task.  Their founders come
    before all later ones, so whatever line of the rest fits one of them belongs there; the rest meets them in parts of
    at most `full` lines, and what fits none is left for the next round.
    """
    columns = ["path", "line", "docs", "first", "last", "low", "high", "at"]
    left, path_ = cut(lines.orderBy("path", F.desc("docs"), "line").withColumn("at", F.monotonically_increasing_id()), "crowded")
    old, rounds = [path_], []
    piece = F.shiftright("at", max(0, full.bit_length() - 3)).alias("piece")
    while not left.isEmpty():
        per = left.groupBy("path", piece).count()
        upto = F.sum("count").over(Window.partitionBy("path").orderBy("piece"))
        parts, p1 = cut(per.select("path", "piece", F.floor((upto - 1) / full).alias("part")), "parts")
        dealt, p2 = cut(left.select(*columns, piece).join(parts, ["path", "piece"]).select(*columns, "part", F.lit(False).alias("known")), "dealt")
        heads, _ = cut(_placed(dealt.where("part = 0"), similarity, depth, True), "heads")
        known = heads.where("founder = at").select(*columns).join(parts.where("part > 0").select("path", "part").distinct(), "path").withColumn("known", F.lit(True))
        met, _ = cut(_placed(dealt.where("part > 0").unionByName(known), similarity, depth, False), "met")
        rounds += [heads, met.where("founder is not null")]
        left = met.where("founder is null").select(*columns)
        for p in (*old, p1, p2):
            drop(lines.sparkSession, p)
        old = []
    placed = rounds[0]
    for r in rounds[1:]:
        placed = placed.unionByName(r)
    totals = placed.groupBy("founder").agg(*_all())
    fields = placed.select("founder", F.explode("apart").alias("place")).groupBy("founder").agg(F.collect_set("place").alias("fields"))
    kind = pa.schema([("founder", pa.int64()), *list(_SETTLED_ARROW)[1:]])

    def named(batches):
        for b in batches:
            rows = zip(*(c.to_pylist() for c in b.columns), strict=True)
            out = [(f, _template(words, set(places or ())), n, first, low if first == NOBODY else None) for f, line, places, n, first, last, low, high in rows if _recurs(first, last, low, high) and (len(words := line.split(b" ")) >= short or n >= short_support)]
            if out:
                yield batch(kind, *zip(*out, strict=True))

    def digests(batches):
        for b in batches:
            yield batch(_SETTLED_ARROW, [digest(x) for x in b.column(0).to_pylist()], *(b.column(k) for k in range(1, 5)))

    whole = totals.join(placed.where("founder = at").select("founder", "line"), "founder").join(fields, "founder", "left")
    whole = whole.select("founder", "line", "fields", "docs", "first", "last", "low", "high")
    templates, _ = cut(whole.mapInArrow(named, "founder long, template binary, support long, keeper long, keeper_hash long"), "named")
    return placed.select("founder", "line").join(templates, "founder").select("line", "template", "support", "keeper", "keeper_hash").mapInArrow(digests, _SETTLED)


def recurring(docs: DataFrame, depth: int = DEPTH, similarity: float = SIMILARITY, short: int = SHORT, short_support: int = SHORT_SUPPORT, full: int = FULL) -> DataFrame:
    """Columns digest, template, support, keeper, keeper_hash: for every masked line whose template recurs.

    support: how many (document, distinct line) pairs the template has; keeper: the smallest id of a document with it.
    Documents without an id come last, each text one document; if there are no others, keeper_hash names the text that
    keeps the line.
    """
    lines, _ = cut(distinct_lines(docs, depth, similarity), "lines")
    crowded, _ = cut(lines.groupBy("path").count().where(F.col("count") > full).select("path"), "crowded-leaves")
    apart = None if crowded.isEmpty() else _crowded(lines.join(crowded, "path", "left_semi"), depth, similarity, short, short_support, full)
    if apart is not None:
        lines = lines.join(crowded, "path", "left_anti")

    def settle(leaf: Leaf, members: list[tuple]) -> Iterator[tuple]:
        totals: dict[int, Sequence] = {}
        for k, _, sums in members:
            totals[k] = _both(totals[k], sums) if k in totals else sums
        for k, line, _ in members:
            support, first, last, low, high = totals[k]
            if _recurs(first, last, low, high) and (leaf.n >= short or support >= short_support):
                yield digest(line), leaf.template(k), support, first, low if first == NOBODY else None

    def run(batches):
        now, leaf, members, out = None, None, [], []
        for b in batches:
            for p, line, *sums in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if p != now:
                    if leaf:
                        out += settle(leaf, members)
                    now, leaf, members = p, Leaf(int(p.split(b" ", 1)[0]), similarity, depth), []
                members.append((leaf.add(line.split(b" ")), line, sums))
            if out:
                yield batch(_SETTLED_ARROW, *zip(*out, strict=True))
                out = []
        if leaf:
            out += settle(leaf, members)
        if out:
            yield batch(_SETTLED_ARROW, *zip(*out, strict=True))

    dealt = lines.repartition("path").sortWithinPartitions("path", F.desc("docs"), "line")
    settled = dealt.mapInArrow(run, _SETTLED)
    return settled if apart is None else settled.unionByName(apart)


def _dropped(docs: DataFrame, settled: DataFrame) -> DataFrame:
    """id, hash (of the text), gone (for each line up to the last that goes, whether it does) and n (how many go)."""
    kind = pa.schema([("id", pa.int64()), ("hash", pa.int64()), ("digest", pa.binary()), ("at", pa.list_(pa.int32()))])
    flags = pa.schema([("id", pa.int64()), ("hash", pa.int64()), ("gone", pa.list_(pa.bool_())), ("n", pa.int64())])

    def run(batches):
        for b in batches:
            out = []
            for doc_id, text, h in zip(b.column(0).to_pylist(), utf8(b.column(1)), b.column(2).to_pylist(), strict=True):
                out += ((doc_id, h, digest(line), at) for line, at in _text_lines(text).items())
                if len(out) > 20_000:
                    yield batch(kind, *zip(*out, strict=True))
                    out = []
            if out:
                yield batch(kind, *zip(*out, strict=True))

    def flagged(batches):
        for b in batches:
            gone, n = [], []
            for parts in b.column(2):
                at = np.unique(parts.values.flatten().to_numpy(zero_copy_only=False))
                own = np.zeros(at[-1] + 1, bool)
                own[at] = True
                gone.append(own)
                n.append(len(at))
            yield batch(flags, b.column(0), b.column(1), gone, n)

    each = narrowed(docs, "doc_id", "text").withColumn("h", F.xxhash64("text")).mapInArrow(run, "id long, hash long, digest binary, at array<int>")
    other = F.when(F.col("keeper_hash").isNull(), ~F.col("id").eqNullSafe(F.col("keeper"))).otherwise(F.col("id").isNotNull() | (F.col("hash") != F.col("keeper_hash")))
    gone = each.join(settled.select("digest", "keeper", "keeper_hash"), "digest").where(other)
    return gone.groupBy("id", "hash").agg(F.collect_list("at").alias("at")).mapInArrow(flagged, "id long, hash long, gone array<boolean>, n long")


def _rewritten(docs: DataFrame, **options) -> DataFrame:
    """row (all columns of `docs`), text (what is left of it), n_lines, n_dropped."""
    settled, p1 = cut(recurring(docs, **options), "templates")
    dropped, _ = cut(_dropped(docs, settled), "dropped")
    drop(docs.sparkSession, p1)
    keyed = wrapped(docs, key=F.col("doc_id").cast("bigint"), print=F.xxhash64(F.col("text").cast("string")), whole=F.col("text").cast("string"))
    both = keyed.join(dropped, keyed["key"].eqNullSafe(dropped["id"]) & (keyed["print"] == dropped["hash"]), "left")
    lines = F.split("whole", "\n", -1)
    rest = F.array_join(F.filter(lines, lambda _, i: ~F.coalesce(F.get("gone", i), F.lit(False))), "\n")
    text = F.when(F.col("gone").isNull(), F.col("whole")).otherwise(rest)
    return both.select("row", text.alias("text"), F.coalesce(F.size(lines), F.lit(0)).cast("long").alias("n_lines"), F.coalesce("n", F.lit(0).cast("long")).alias("n_dropped"))


def without_recurring(docs: DataFrame, n_chars: str | None = None, **options) -> DataFrame:
    """`docs` with all its columns, the lines of recurring templates dropped from `text` wherever they stand in another
    document than the template's keeper.  A column `n_chars`, if named, follows the new text where lines were dropped.

    Null texts stay null and empty ones empty; blank lines are never dropped; rows of one doc_id are one document; rows
    without an id lose what a document with one has, and each text among them is a document; very long lines are
    templates like any other; columns of any name pass through; an empty table gives an empty one.
    """
    changed = {"text": F.col("text")}
    if n_chars:
        kind = docs.schema[n_chars].dataType
        changed[n_chars] = F.when(F.col("n_dropped") > 0, F.length("text").cast(kind)).otherwise(F.col("row")[n_chars])
    return _rewritten(docs, **options).select(*opened(docs.columns, **changed))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of every row of `documents`: doc_id, text without recurring lines, n_lines (of the old text) and n_dropped; null,
    empty and repeated rows as without_recurring() says."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return _rewritten(docs).select("row.doc_id", "text", "n_lines", "n_dropped")
