"""Packing of tokenised documents into sequences of bounded length (operator 1)."""

from __future__ import annotations

import zlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

from .common import batch, narrowed, table, utf8
from .tokenizer import pieces

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
_ARROW = pa.schema([(c.split()[0], pa.int64()) for c in SCHEMA.split(", ")])

LIMIT = 1024
#: What a cut costs, in padded tokens: after a document nothing, after a sentence little, elsewhere more.
SENTENCE, ANYWHERE = 2, 6
#: A stretch without a sentence end gets cut points this far apart.
STRIDE = 32
#: So many tokens are laid out at a time.
CHUNK = 400_000


def cuts(points: list[int], costs: list[int], limit: int) -> list[int]:
    """The indices of the cut points that minimise padding plus cut costs.

    points: rising positions, from 0 to the end, no two further apart than limit; costs: of a cut at each.  A window
    from i to j costs limit - (points[j] - points[i]) + costs[j], so best[j] = limit - points[j] + costs[j] + the least
    best[i] + points[i] within reach: a sliding minimum, kept in a monotone queue.  Ties go to the longest window.
    """
    queue, keys, come = deque([0]), [0] * len(points), [0] * len(points)
    head, at = 0, points
    pop, popleft, push = queue.pop, queue.popleft, queue.append
    for j in range(1, len(points)):
        p = at[j]
        while p - at[queue[0]] > limit:
            popleft()
        come[j] = head = queue[0]
        key = keys[j] = keys[head] + limit + costs[j]
        while queue and keys[queue[-1]] > key:
            pop()
        push(j)
    out, j = [], len(points) - 1
    while j > 0:
        out.append(j)
        j = come[j]
    return out[::-1]


def _candidates(ends: np.ndarray, ids: np.ndarray, ends_sentence: np.ndarray) -> tuple[list[int], list[int]]:
    """Cut points and their costs: document ends, sentence ends, and points in long stretches of neither."""
    n = len(ids)
    inner = np.flatnonzero(ends_sentence[ids]) + 1
    known = np.unique(np.concatenate([[0], inner, ends, [n]]))
    gaps = np.diff(known)
    wide = np.flatnonzero(gaps > STRIDE)
    more = [np.arange(known[k] + STRIDE, known[k + 1], STRIDE) for k in wide]
    points = np.unique(np.concatenate([known, *more]))
    costs = np.full(len(points), ANYWHERE)
    costs[np.isin(points, known, assume_unique=True)] = SENTENCE
    costs[np.isin(points, ends, assume_unique=False)] = 0
    costs[0] = 0
    return points.tolist(), costs.tolist()


class _Layout:
    """Lays documents out one after the other; keeps what is not yet laid out in at most about CHUNK tokens and the
    tokens of one document."""

    def __init__(self, first_sequence: int, limit: int, ends_sentence: np.ndarray):
        self.held: list[list] = []  # [doc_id, ids as bytes, tokens already laid out]
        self.tokens, self.sequence, self.limit, self.ends = 0, first_sequence, limit, ends_sentence

    def add(self, doc_id, ids: bytes) -> Iterator[tuple]:
        self.held.append([doc_id, ids, 0])
        self.tokens += len(ids) // 4
        if self.tokens >= CHUNK:
            yield from self.lay(last=False)

    def lay(self, last: bool) -> Iterator[tuple]:
        if not self.held:
            return
        ids = np.frombuffer(b"".join(x[1][4 * x[2] :] for x in self.held), "<u4")
        ends = np.cumsum([len(x[1]) // 4 - x[2] for x in self.held])
        points, costs = _candidates(ends, ids, self.ends)
        chosen = cuts(points, costs, self.limit)
        windows = [points[k] for k in chosen]
        if not last:  # the end may still be laid out otherwise
            windows = windows[:-4]
        k, at = 0, 0
        for end in windows:
            offset = 0
            while at < end:
                doc_id, data, done = self.held[k]
                n = min(end - at, len(data) // 4 - done)
                yield doc_id, done, n, zlib.crc32(memoryview(data)[4 * done : 4 * (done + n)]), len(data) // 4, self.sequence, offset
                self.held[k][2] = done + n
                offset, at = offset + n, at + n
                if done + n == len(data) // 4:
                    k += 1
            self.sequence += 1
        self.held = self.held[k:]
        self.tokens -= at


def pack(docs: DataFrame, tokenizer: str, limit: int = LIMIT) -> DataFrame:
    """Pieces of `docs` (doc_id, text) laid out in their order in sequences of at most `limit` tokens.

    A document is its ids and id 0.  Each partition is laid out by itself in one pass, without a shuffle; a sequence id
    holds the partition's number in its upper bits.  Null and empty texts are the id 0 alone; a null doc_id stays null;
    repeated rows are packed once each; other columns are ignored; an empty table gives no pieces.  A text of any
    length is cut at sentence ends, and at every 32nd token where it has none.
    """

    def run(batches):
        own = pieces(tokenizer)
        ends_sentence = np.zeros(own.size, bool)
        for i, b in own.of_id.items():
            ends_sentence[i] = b[-1:] in (b".", b"!", b"?", b"\n")
        layout = _Layout(TaskContext.get().partitionId() << 36, limit, ends_sentence)
        zero, out = bytes(4), []
        for b in batches:
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                out += layout.add(doc_id, own.ids(text or "") + zero)
            if len(out) > 5_000:
                yield batch(_ARROW, *zip(*out, strict=True))
                out = []
        out += layout.lay(last=True)
        if out:
            yield batch(_ARROW, *zip(*out, strict=True))

    return narrowed(docs, "doc_id", "text").mapInArrow(run, SCHEMA)


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pack() of all `documents` by byte_bpe_50k.json; null, empty, repeated and extra input as there."""
    import public_tokenizers

    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
