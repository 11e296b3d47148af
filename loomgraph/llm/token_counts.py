"""Token counts of whole texts without making ids (operator 4)."""

from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import batch, cut, narrowed, table
from .tokenizer import pieces, pre_tokens

#: Documents sampled for frequent pre-tokens, and how many of those a worker keeps the piece counts of.  This bounds
#: the broadcast; it decides what is shuffled, never what is counted.
SAMPLE_ROWS, FREQUENT, LONGEST = 8_000, 200_000, 48
LIMIT = 512
#: Parcels a batch makes for each shuffle partition.
PARCELS = 4

# A parcel of one batch: its rare pre-tokens of one bucket, or (bucket -1) its documents.
_SCHEMA = "batch long, bucket int, deal long, parcel binary"
_ARROW = pa.schema([("batch", pa.int64()), ("bucket", pa.int32()), ("deal", pa.int64()), ("parcel", pa.binary())])
_PART = pa.schema([("batch", pa.int64()), ("bucket", pa.int32()), ("parcel", pa.binary())])
_OUT = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64())])


def _packed(*arrays: np.ndarray | bytes) -> bytes:
    """Byte strings and 32-bit arrays in one compressed parcel."""
    parts = [x if isinstance(x, bytes) else x.astype("<u4").tobytes() for x in arrays]
    return zlib.compress(b"".join(len(x).to_bytes(8, "little") + x for x in parts), 1)


def _unpacked(parcel: bytes) -> list[bytes]:
    raw, out, at = zlib.decompress(parcel), [], 0
    while at < len(raw):
        n = int.from_bytes(raw[at : at + 8], "little")
        out.append(raw[at + 8 : at + 8 + n])
        at += 8 + n
    return out


def _u4(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, "<u4")


def _frequencies(text: str, own) -> tuple[Counter, int]:
    """How often each pre-token occurs, and how many special tokens there are."""
    counts, special = Counter(), 0
    for part in own.parts(text):
        if part in own.special:
            special += 1
        else:
            counts.update(pre_tokens(part))
    return counts, special


def frequent(docs: DataFrame, tokenizer: str, rows: int = SAMPLE_ROWS, most: int = FREQUENT) -> dict[str, int]:
    """Pre-token -> number of pieces, for the pre-tokens that most documents of a bounded sample hold."""
    spread = F.xxhash64("doc_id")
    ids = docs.select("doc_id").where("doc_id is not null").orderBy(spread, "doc_id").limit(rows).distinct()

    def run(batches):
        own = pieces(tokenizer)
        kind = pa.schema([("token", pa.string()), ("n", pa.int64())])
        counts = Counter()
        for b in batches:
            for text in b.column(0).to_pylist():
                counts.update(t for t in _frequencies(text or "", own)[0] if len(t) <= LONGEST)
                if len(counts) > 500_000:
                    yield batch(kind, [*counts], [*counts.values()])
                    counts.clear()
        yield batch(kind, [*counts], [*counts.values()])

    seen = docs.join(F.broadcast(ids), "doc_id").select("text").mapInArrow(run, "token string, n long").groupBy("token").agg(F.sum("n").alias("n"))
    top = seen.where("n > 1").orderBy(F.desc("n"), "token").limit(most).select("token").toArrow().column(0).to_pylist()
    own = pieces(tokenizer)
    return {t: own.count(t.encode("utf-8")) for t in top}


def _straight_from_files(docs: DataFrame) -> bool:
    """Whether the plan only scans files, selects columns and filters rows, so a lost task comes out alike."""
    plan = docs._jdf.queryExecution().optimizedPlan()
    while plan.nodeName() in ("Project", "Filter"):
        plan = plan.children().head()
    return plan.nodeName() == "LogicalRelation" or plan.nodeName().startswith("Relation")


def count_tokens(docs: DataFrame, tokenizer: str, rows: int = SAMPLE_ROWS, most: int = FREQUENT) -> DataFrame:
    """Columns doc_id, n_bytes, n_tokens for each row of `docs` (doc_id, text).

    Each document becomes its pre-tokens with their frequencies.  Those of the bounded table of frequent pre-tokens are
    summed at once.  The others travel in parcels, one of each batch of rows and bucket of pre-tokens: the bucket's task
    counts the pieces of each of its pre-tokens once, multiplies by the frequencies, and sends sums per document back to
    the batch.  A hot pre-token only lengthens parcels that exist anyway.  Special strings count as one token, as in the
    library.  A null or empty text has 0 tokens; a null doc_id stays null; repeated rows are each returned; other columns
    are ignored; an empty table gives an empty one.  A batch is known by its partition and place, so the input's
    partitions must come out alike when computed again: an input that is not read straight from files is written first.
    """
    narrow = narrowed(docs, "doc_id", "text")
    if not _straight_from_files(narrow):
        narrow, _ = cut(narrow, "documents")
    spark = docs.sparkSession
    known = spark.sparkContext.broadcast(frequent(narrow, tokenizer, rows, most))
    buckets = PARCELS * int(spark.conf.get("spark.sql.shuffle.partitions"))

    def split(batches):
        own, table_of, here = pieces(tokenizer), known.value, TaskContext.get().partitionId() << 32
        for number, b in enumerate(batches, here):
            n_bytes, n_tokens = np.zeros(b.num_rows, np.int64), np.zeros(b.num_rows, np.int64)
            rare: dict[str, list[int]] = {}
            for i, text in enumerate(b.column(1).to_pylist()):
                if not text:
                    continue
                n_bytes[i] = len(text.encode("utf-8"))
                counts, n = _frequencies(text, own)
                for t, times in counts.items():
                    if (k := table_of.get(t)) is None:
                        rare.setdefault(t, []).extend((i, times))
                    else:
                        n += k * times
                n_tokens[i] = n
            of: dict[int, list[str]] = {}
            for t in rare:
                of.setdefault(zlib.crc32(t.encode("utf-8")) % buckets, []).append(t)
            out = []
            for bucket, tokens in of.items():
                raw = [t.encode("utf-8") for t in sorted(tokens)]
                uses = [rare[t] for t in sorted(tokens)]
                flat = np.array([x for u in uses for x in u], np.int64).reshape(-1, 2)
                out.append((number, bucket, bucket, _packed(b"".join(raw), np.array([len(x) for x in raw]), np.array([len(u) // 2 for u in uses]), flat[:, 0], flat[:, 1])))
            ids = b.column(0)
            present = np.array(ids.is_valid().to_pylist(), np.uint8)
            whole = np.concatenate([ids.fill_null(0).to_numpy(zero_copy_only=False).astype("<i8"), n_bytes, n_tokens])
            out.append((number, -1, buckets + number, zlib.compress(present.tobytes() + whole.tobytes(), 1)))
            yield batch(_ARROW, *zip(*out, strict=True))

    def count(batches):
        own, now, seen = pieces(tokenizer), None, {}
        for b in batches:
            out = []
            for number, bucket, parcel in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(3).to_pylist(), strict=True):
                if bucket >= 0:
                    if bucket != now:
                        now, seen = bucket, {}
                    raw, lengths, uses, at, times = _unpacked(parcel)
                    ends = np.cumsum(_u4(lengths)).tolist()
                    k = np.empty(len(ends), np.int64)
                    for j, (x, y) in enumerate(zip([0, *ends], ends, strict=False)):
                        t = raw[x:y]
                        if (n := seen.get(t)) is None:
                            n = own.count(t)
                            if len(seen) < own.most:
                                seen[t] = n
                        k[j] = n
                    total = np.bincount(_u4(at), np.repeat(k, _u4(uses)) * _u4(times))
                    where = np.flatnonzero(total)
                    parcel = _packed(np.diff(where, prepend=0), total[where])
                out.append((number, bucket, parcel))
            yield batch(_PART, *zip(*out, strict=True))

    def finish(batches):
        now = documents = total = None

        def made():
            n = len(documents) // 25
            present, whole = np.frombuffer(documents[:n], np.uint8), np.frombuffer(documents[n:], "<i8").reshape(3, n)
            own = whole[2].copy()
            own[: len(total)] += total
            return batch(_OUT, pa.array(whole[0], pa.int64(), mask=present == 0), whole[1], own)

        for b in batches:
            for number, bucket, parcel in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if number != now:
                    if documents is not None:
                        yield made()
                    now, documents, total = number, None, np.zeros(0, np.int64)
                if bucket < 0:
                    documents = zlib.decompress(parcel)
                    continue
                where, n = map(_u4, _unpacked(parcel))
                where = np.cumsum(where)
                if where[-1] >= len(total):
                    total = np.concatenate([total, np.zeros(where[-1] + 1 - len(total), np.int64)])
                total[where] += n
        if documents is not None:
            yield made()

    parcels = narrow.mapInArrow(split, _SCHEMA)
    dealt = parcels.repartition("deal").sortWithinPartitions("bucket")
    sums = dealt.mapInArrow(count, "batch long, bucket int, parcel binary")
    return sums.repartition("batch").sortWithinPartitions("batch", "bucket").mapInArrow(finish, "doc_id long, n_bytes long, n_tokens long")


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """count_tokens() of all `documents` by byte_bpe_50k.json, and whether a text has over 512; null, empty, repeated
    and extra input as there."""
    import public_tokenizers

    counted = count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return counted.withColumn("over_limit", F.col("n_tokens") > LIMIT)
