"""Token ids in grammar-compressed files (operator 13)."""

from __future__ import annotations

import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.tables import shared_dir

from .common import batch, cut, drop, narrowed, table
from .token_counts import _straight_from_files
from .tokenizer import word_pieces

END = 1
#: Ids after which a shard ends, with the document that brings it there.
SHARD = 1 << 20
#: Texts that are read together.
TEXTS = 2048
#: A rule is used so often at least; a round takes the pairs that are no rarer than the commonest by this factor; rounds
#: end when one shortens a shard by less than this share; places of the table that pairs are looked up in.  They decide
#: how small a shard gets, never what it holds.
LEAST_USES, WITHIN, LEAST_GAIN, TABLE_BITS = 4, 128, 0.01, 18

# A row is one shard.  part, shard: its place; before: ids of the part's earlier shards; first_id, last_id: what its
# documents lie between; terminals: ids below this stand for themselves, the others for a rule; the lists are
# little-endian: rules are pairs of symbols, lengths the ids that a rule expands to; of each document doc_ids, its first
# symbol, and its first id; the last no_id documents have no id.
_SHARD = "part long, shard long, before long, ids long, docs long, no_id long, first_id long, last_id long, terminals long, width int, rules binary, lengths binary, symbols binary, doc_ids binary, symbol_starts binary, id_starts binary"
_LONGS = ("part", "shard", "before", "ids", "docs", "no_id", "first_id", "last_id", "terminals")
_LISTS = ("rules", "lengths", "symbols", "doc_ids", "symbol_starts", "id_starts")
_SHARD_ARROW = pa.schema([*((c, pa.int64()) for c in _LONGS), ("width", pa.int32()), *((c, pa.binary()) for c in _LISTS)])
_DOCS = "doc_id long, part long, at long, n_tokens long, ids_crc32 long"
_DOCS_ARROW = pa.schema([(c.split()[0], pa.int64()) for c in _DOCS.split(", ")])


def repair(ids: np.ndarray, last: np.ndarray, terminals: int, room: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Rules (pairs of symbols), the ids that each expands to in number, the symbols left, and which of them ends a
    document.

    Again and again the frequent pairs of neighbours become nonterminals, numbered from `terminals` on, at most `room` of
    them.  A round takes all pairs about as frequent as the commonest one.  Of places that overlap every second one counts,
    from the left.  A pair never reaches over the end of a document.
    """
    small = terminals + room <= 1 << 16
    kind, bits = (np.uint32, np.uint32(16)) if small else (np.uint64, np.uint64(32))
    s, rules, lengths = ids.astype(kind), [], np.ones(terminals, np.int64)
    while len(s) > 1 and len(rules) < room:
        keys = (s[:-1] << bits) | s[1:]
        inside = ~last[:-1]
        # No pair is more frequent than all pairs of its hash together, so only those of frequent hashes are sorted.
        place = _hashed(keys)
        crowd = np.bincount(place[inside], minlength=1 << TABLE_BITS)
        limit = max(LEAST_USES, int(crowd.max()) // WITHIN)
        ordered = np.sort(keys[inside & (crowd >= limit)[place]])
        if not len(ordered):
            break
        edges = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1], [True]]))
        n, pairs = np.diff(edges), ordered[edges[:-1]]
        chosen = np.flatnonzero(n >= limit)
        if not len(chosen):
            break
        chosen = chosen[np.argsort(-n[chosen], kind="stable")][: room - len(rules)]
        pairs = pairs[chosen]
        # A pair is looked up by a hash; of pairs with one hash the most frequent has it, the others wait for a later round.
        of = np.full(1 << TABLE_BITS, -1, np.int32)
        of[_hashed(pairs[::-1])] = np.arange(len(pairs) - 1, -1, -1, dtype=np.int32)
        rule = of[place]
        hit = (pairs[rule] == keys) & (rule >= 0) & inside
        at = np.flatnonzero(hit)
        rule = rule[at]
        fresh = np.concatenate([[True], at[1:] != at[:-1] + 1])  # the first of places in a row
        begin = np.flatnonzero(fresh)[np.cumsum(fresh) - 1]
        even = (np.arange(len(at)) - begin) % 2 == 0
        at, rule = at[even], rule[even]
        used = np.bincount(rule, minlength=len(pairs)) >= LEAST_USES
        kept = used[rule]
        at, number = at[kept], (np.cumsum(used) - 1)[rule[kept]]
        if not len(at):
            break
        gain, first = len(at) / len(s), terminals + len(rules)
        s[at], last[at] = (number + first).astype(kind), last[at + 1]
        stays = np.ones(len(s), bool)
        stays[at + 1] = False
        s, last = s[stays], last[stays]
        new = pairs[used].astype(np.uint64)
        new = np.stack([new >> np.uint64(bits), new & np.uint64((1 << int(bits)) - 1)], axis=1).astype(np.int64)
        lengths = np.concatenate([lengths, lengths[new].sum(axis=1)])
        rules += new.tolist()
        if gain < LEAST_GAIN:
            break
    return np.array(rules, np.uint32).reshape(-1, 2), lengths[terminals:], s.astype(np.uint32), last


def _hashed(keys: np.ndarray) -> np.ndarray:
    """TABLE_BITS bits by multiplication with a fixed odd number."""
    if keys.dtype == np.uint32:
        return (keys * np.uint32(2654435769)) >> np.uint32(32 - TABLE_BITS)
    return (keys * np.uint64(11400714819323198485)) >> np.uint64(64 - TABLE_BITS)


class Opened:
    """What each symbol stands for, the ids of all of them in line."""

    def __init__(self, rules: np.ndarray, lengths: np.ndarray, terminals: int):
        s = np.arange(terminals, terminals + len(rules))
        while (inner := s >= terminals).any():  # one level of rules after the other
            n = 1 + inner
            at, pair = (np.cumsum(n) - n)[inner], rules[s[inner] - terminals]
            s = np.repeat(s, n)
            s[at], s[at + 1] = pair[:, 0], pair[:, 1]
        self.flat = np.concatenate([np.arange(terminals), s]).astype(np.uint32)
        self.sizes = np.concatenate([np.ones(terminals, np.int32), lengths.astype(np.int32)])
        self.starts = np.concatenate([np.arange(terminals), terminals + np.cumsum(lengths) - lengths])

    def ids(self, symbols: np.ndarray) -> np.ndarray:
        sizes = self.sizes[symbols]
        ends = np.cumsum(sizes)
        at = np.repeat(self.starts[symbols] - (ends - sizes), sizes)
        at += np.arange(len(at))
        return self.flat[at]


class Shard:
    """A shard as read from its file."""

    def __init__(self, row: dict):
        self.terminals, kind = row["terminals"], "<u2" if row["width"] == 2 else "<u4"
        self.rules = np.frombuffer(row["rules"], kind).reshape(-1, 2).astype(np.int64)
        self.symbols, self.lengths = np.frombuffer(row["symbols"], kind), np.frombuffer(row["lengths"], "<u4").astype(np.int64)
        self.doc_ids, self.no_id = np.frombuffer(row["doc_ids"], "<i8"), row["no_id"]
        self.symbol_starts, self.id_starts = np.frombuffer(row["symbol_starts"], "<u4").astype(np.int64), np.frombuffer(row["id_starts"], "<u8").astype(np.int64)

    def ids(self) -> np.ndarray:
        return Opened(self.rules, self.lengths, self.terminals).ids(self.symbols)

    def slice(self, doc: int, start: int, length: int) -> np.ndarray:
        """Ids start to start + length of one document; of its symbols only those that hold them are opened."""
        own = self.symbols[self.symbol_starts[doc] : self.symbol_starts[doc + 1]].astype(np.int64)
        sizes, inner = np.ones(len(own), np.int64), own >= self.terminals
        sizes[inner] = self.lengths[own[inner] - self.terminals]
        ends = np.cumsum(sizes)
        i, j = np.searchsorted(ends, start, side="right"), np.searchsorted(ends, start + length, side="left") + 1
        if length <= 0 or i >= len(own):
            return np.empty(0, np.uint32)
        out, waiting = [], own[i:j][::-1].tolist()
        while waiting:
            x = waiting.pop()
            if x < self.terminals:
                out.append(x)
            else:
                a, b = self.rules[x - self.terminals].tolist()
                waiting += [b, a]
        skip = int(start - (ends[i] - sizes[i]))
        return np.array(out[skip : skip + length], np.uint32)


def write_ids(docs: DataFrame, tokenizer: str, path: str, end: int = END, shard: int = SHARD) -> None:
    """Write the ids of `docs` (doc_id, text) to `path`, in ascending doc_id order, a row of a Parquet table for each
    shard of about `shard` ids.

    A document is its ids and `end`; a null or empty text is `end` alone.  Rows without a doc_id come last; repeated rows
    are each written; other columns are ignored; an empty table makes an empty file.  Rows are dealt to parts by ranges of
    doc_id and of their place in the input, so an id that many rows have is dealt too; the input's partitions must come
    out alike when computed again, so one that is not read straight from files is written first.
    """
    narrow, held = narrowed(docs, "doc_id", "text"), None
    if not _straight_from_files(narrow):
        narrow, held = cut(narrow, "documents")
    order = [F.col("doc_id").asc_nulls_last(), F.col("place")]
    ordered = narrow.withColumn("place", F.monotonically_increasing_id()).repartitionByRange(*order).sortWithinPartitions(*order).drop("place")

    def run(batches):
        own, part = word_pieces(tokenizer), TaskContext.get().partitionId()
        tail, held, known = np.array([end], own.kind), [], 0
        number = before = 0

        def made():
            nonlocal number, before
            ids = np.concatenate([y for x in held for y in (x[1], tail)])
            sizes = np.array([len(x[1]) + 1 for x in held], np.int64)
            last = np.zeros(len(ids), bool)
            last[np.cumsum(sizes) - 1] = True
            terminals = max(own.size, end + 1)
            # A vocabulary of 16 bits leaves the rest of them to rules, and symbols stay as short.
            room = (1 << 16) - terminals if terminals < 1 << 16 else 1 << 16
            rules, lengths, symbols, last = repair(ids, last, terminals, room)
            kind = "<u2" if terminals + len(rules) <= 1 << 16 else "<u4"
            doc_ids = [x[0] for x in held if x[0] is not None]
            starts = np.concatenate([[0], np.flatnonzero(last) + 1]).astype("<u4").tobytes()
            row = (
                part, number, before, len(ids), len(held), len(held) - len(doc_ids), doc_ids[0] if doc_ids else None, doc_ids[-1] if doc_ids else None, terminals, int(kind[2]),
                rules.astype(kind).tobytes(), lengths.astype("<u4").tobytes(), symbols.astype(kind).tobytes(),
                np.array([0 if x[0] is None else x[0] for x in held], "<i8").tobytes(), starts, np.concatenate([[0], np.cumsum(sizes)]).astype("<u8").tobytes(),
            )
            number, before = number + 1, before + len(ids)
            return batch(_SHARD_ARROW, *zip(row, strict=True))

        for b in batches:
            for k in range(0, b.num_rows, TEXTS):
                doc_ids, texts = (c.slice(k, TEXTS).to_pylist() for c in b.columns)
                for doc_id, ids in zip(doc_ids, own.many([t or "" for t in texts]), strict=True):
                    held.append((doc_id, ids))
                    known += len(ids) + 1
                    if known >= shard:
                        yield made()
                        held, known = [], 0
        if held:
            yield made()

    ordered.mapInArrow(run, _SHARD).write.parquet(path)
    drop(docs.sparkSession, held)


def read_shards(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(_SHARD).parquet(path)


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of each document of the files: its first id's place among the ids of all, how
    many it has, and their CRC-32 as little-endian unsigned 32-bit numbers.

    A part's ids are counted from its shards' heads; the driver adds up one number for each part, as many as write_ids()
    had tasks.
    """
    shards = read_shards(spark, path)
    parts = sorted(shards.groupBy("part").agg(F.max(F.col("before") + F.col("ids"))).collect())
    starts = np.concatenate([[0], np.cumsum([n for _, n in parts])])
    firsts = spark.createDataFrame([(p, int(s)) for (p, _), s in zip(parts, starts, strict=False)], "part long, first long")

    def run(batches):
        for b in batches:
            for row in b.to_pylist():
                own = Shard(row)
                ids = memoryview(own.ids().astype("<u4").tobytes())
                edges = own.id_starts.tolist()
                crc = [zlib.crc32(ids[4 * i : 4 * j]) for i, j in zip(edges, edges[1:], strict=False)]
                n = len(crc)
                doc_ids = pa.array(own.doc_ids, pa.int64(), mask=np.arange(n) >= n - own.no_id)
                yield batch(_DOCS_ARROW, doc_ids, [row["part"]] * n, own.id_starts[:-1] + row["before"], np.diff(own.id_starts), crc)

    found = shards.mapInArrow(run, _DOCS)
    return found.join(F.broadcast(firsts), "part").select("doc_id", (F.col("first") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")


def fetch(spark: SparkSession, path: str, doc_id: int, start: int = 0, length: int = 1 << 30) -> list[list[int]]:
    """Some ids of a document, for each row that it has, without opening the rest of its shard; shards that can't hold it
    are not read."""
    out = []
    for row in read_shards(spark, path).where((F.col("first_id") <= doc_id) & (F.col("last_id") >= doc_id)).orderBy("part", "shard").toLocalIterator():
        own = Shard(row.asDict())
        known = own.doc_ids[: len(own.doc_ids) - own.no_id]
        out += [own.slice(int(k), start, length).tolist() for k in np.flatnonzero(known == doc_id)]
    return out


def op13_id_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All `documents` by word_bpe_49k.json, written by write_ids() and read back by read_ids(); null, empty, repeated
    and extra input as there.  The files lie in the shared folder."""
    import public_tokenizers

    path = f"{shared_dir(spark)}/ids-{uuid.uuid4().hex}"
    write_ids(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), path)
    return read_ids(spark, path)
