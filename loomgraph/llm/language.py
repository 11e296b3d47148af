"""Language identification by prediction by partial matching (operator 7)."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import batch, fold, held_out, narrowed, table, utf8

#: Documents per language that the trees are grown from, at most.
SAMPLE_ROWS = 400
#: A symbol for each byte; the longest context.
SYMBOLS, ORDER = 256, 3
#: Bytes scored at a time; runs held while counting.
STRETCH, HELD = 1 << 20, 1 << 21

_FOLDED = np.array([b + 32 if 0x41 <= b <= 0x5A else 0x20 if b in b"\t\n\v\f\r" else b for b in range(256)], np.uint8)
_LETTER = regex.compile(r"\p{L}")
_ASCII_LETTER = re.compile(rb"[A-Za-z]")
_SCHEMA = "doc_id long, lang_pred string, score double"
_ARROW = pa.schema([("doc_id", pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64())])


def grams(text: bytes) -> np.ndarray:
    """For each byte the number made of its ORDER predecessors and itself; before the text stand spaces."""
    s = _FOLDED[np.frombuffer(b" " * ORDER + text, np.uint8)]
    code = s[:-ORDER].astype(np.int64)
    for k in range(1, ORDER + 1):
        code = code * SYMBOLS + s[k : len(s) - ORDER + k]
    return code


def _summed(codes: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each code once, in order, with its sum."""
    each, at = np.unique(codes, return_inverse=True)
    return each, np.bincount(at, n, len(each)).astype(np.int64)


def _find(known: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the codes stand in `known`, which is in order, and whether they do."""
    if not len(known):
        return np.zeros(len(codes), np.int64), np.zeros(len(codes), bool)
    at = np.minimum(np.searchsorted(known, codes), len(known) - 1)
    return at, known[at] == codes


def _chances(codes: np.ndarray, n: np.ndarray, symbols: int) -> list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For each depth the runs that were seen and the chance of their last symbol, the contexts and their escapes."""
    out = []
    for depth in range(ORDER + 1):
        runs, c = _summed(codes % symbols ** (depth + 1), n)
        shorter = out[-1][1][_find(out[-1][0], runs % symbols**depth)[0]] if depth else np.full(len(runs), 1.0 / symbols)
        contexts, at, kinds = np.unique(runs // symbols, return_inverse=True, return_counts=True)
        total = np.bincount(at, c, len(contexts))
        escape = kinds / (total + kinds)
        whole = total / (total + kinds) + escape * np.maximum(0, 1 - np.bincount(at, shorter, len(contexts)))
        out.append((runs, c / ((total + kinds) * whole)[at], contexts, escape / whole))
    return out


class Trees:
    """The context trees of all languages as sorted tables of what was seen.

    The context tree at depth k holds the counts of k + 1 symbols.  A context seen T times, with d different symbols
    after it, gives a seen symbol c / (T + d) and the escape to the shorter context d / (T + d); a symbol that nothing
    predicts is one of `symbols` alike.  The chances after a context are scaled to sum to 1.  The statistics are
    frozen, so the lengths are tables.
    """

    def __init__(self, counts: list[tuple[np.ndarray, np.ndarray]], symbols: int):
        self.symbols, self.langs = symbols, len(counts)
        each = [_chances(codes, n, symbols) for codes, n in counts]
        self.levels: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []
        for depth in range(ORDER + 1):
            own = [x[depth] for x in each]
            contexts = np.unique(np.concatenate([x[2] for x in own]))
            escapes = np.zeros((len(contexts), self.langs), np.float32)
            for k, x in enumerate(own):
                escapes[np.searchsorted(contexts, x[2]), k] = -np.log2(x[3])
            runs = np.unique(np.concatenate([x[0] for x in own]))
            bits = self._shorter(runs, depth, contexts, escapes)
            for k, x in enumerate(own):
                bits[np.searchsorted(runs, x[0]), k] = -np.log2(x[1])
            self.levels.append((runs, bits, contexts, escapes))

    def _shorter(self, codes: np.ndarray, depth: int, contexts: np.ndarray, escapes: np.ndarray) -> np.ndarray:
        """Bits of runs that the tree at this depth does not hold."""
        out = self.lengths(codes % self.symbols**depth, depth - 1) if depth else np.full((len(codes), self.langs), np.log2(self.symbols), np.float32)
        at, held = _find(contexts, codes // self.symbols)
        out[held] += escapes[at[held]]
        return out

    def lengths(self, codes: np.ndarray, depth: int = ORDER) -> np.ndarray:
        """(runs, languages): bits of the last symbol of each run of depth + 1 symbols after those before it."""
        runs, bits, contexts, escapes = self.levels[depth]
        at, held = _find(runs, codes)
        out = np.empty((len(codes), self.langs), np.float32)
        out[held] = bits[at[held]]
        if not held.all():
            out[~held] = self._shorter(codes[~held], depth, contexts, escapes)
        return out


def code_lengths(counts: np.ndarray, symbols: int) -> np.ndarray:
    """Bits of each symbol after each context of ORDER symbols, from the counts of such runs."""
    seen = np.flatnonzero(counts)
    return Trees([(seen, counts[seen])], symbols).lengths(np.arange(symbols ** (ORDER + 1))).ravel()


class Model:
    """Languages and the sparse counts of the context trees; small enough to broadcast."""

    def __init__(self, langs: list[str], counts: list[tuple[np.ndarray, np.ndarray]]):
        self.langs, self.counts = langs, counts
        self._trees: Trees | None = None

    def __getstate__(self):
        return self.__dict__ | {"_trees": None}

    def trees(self) -> Trees:
        """Made once in a worker."""
        if self._trees is None:
            self._trees = Trees(self.counts, SYMBOLS)
        return self._trees

    def bits(self, text: bytes) -> np.ndarray:
        total, trees = np.zeros(len(self.langs)), self.trees()
        for i in range(0, len(text), STRETCH):
            before = max(0, i - ORDER)
            codes, n = np.unique(grams(text[before : i + STRETCH])[i - before :], return_counts=True)
            total += n @ trees.lengths(codes).astype(np.float64)
        return total

    def predict(self, text: bytes | None) -> tuple[str, float]:
        if not text or not self.langs or not (_ASCII_LETTER.search(text) or _LETTER.search(text.decode("utf-8", "replace"))):
            return "und", 0.0
        bits = self.bits(text)
        k = int(bits.argmin())
        return self.langs[k], float(1 / np.exp2(np.maximum(bits[k] - bits, -1000)).sum())


def train(docs: DataFrame, rows: int = SAMPLE_ROWS) -> Model:
    """Trees of each language from at most `rows` labelled documents, those with the smallest hash of their id.  A row
    without text, id or lang teaches nothing; an id with several languages teaches each; of an empty table nothing is
    learnt."""
    labelled = narrowed(docs, "doc_id", "lang").where("lang is not null and doc_id is not null")
    first = F.row_number().over(Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id"))
    # Each partition keeps its first rows of a language before the shuffle, so a hot language is no hot task.
    ids = labelled.withColumn("_n", first).where(F.col("_n") <= rows).select("doc_id", F.col("lang").alias("_lang")).distinct().toArrow()
    langs = sorted(set(ids.column(1).to_pylist()))
    if not langs:
        return Model([], [])
    picked = F.broadcast(docs.sparkSession.createDataFrame(ids))
    full = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    sample = full.join(picked, "doc_id").where("lang = _lang").select("lang", "text")

    def runs(batches):
        kind = pa.schema([("lang", pa.string()), ("code", pa.int64()), ("n", pa.int64())])
        held: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}

        def made():
            for lang, parts in held.items():
                codes, n = _summed(*(np.concatenate(x) for x in zip(*parts, strict=True)))
                yield batch(kind, [lang] * len(codes), codes, n)
            held.clear()

        size = 0
        for b in batches:
            for lang, x in zip(b.column(0).to_pylist(), utf8(b.column(1)), strict=True):
                for i in range(0, len(x or b""), STRETCH):
                    part = np.unique(grams(x[max(0, i - ORDER) : i + STRETCH])[min(i, ORDER) :], return_counts=True)
                    held.setdefault(lang, []).append(part)
                    size += len(part[0])
                if size > HELD:
                    yield from made()
                    size = 0
        yield from made()

    found = sample.mapInArrow(runs, "lang string, code long, n long").groupBy("lang", "code").agg(F.sum("n").alias("n")).toArrow()
    of, codes, n = found.column(0).to_pylist(), found.column(1).to_numpy(), found.column(2).to_numpy()
    of = np.array(of, dtype=object)
    return Model(langs, [(codes[of == lang], n[of == lang]) for lang in langs])


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """Columns doc_id, lang_pred, score for each row of `docs` (doc_id, text).

    The language whose trees code the text in the fewest bits; equally few: the first by name.  score: its share of
    2^-bits over all languages.  A text that is null or has no letter, and any text if nothing was learned, is `und`
    with score 0.  A null doc_id stays null; repeated rows are judged alike; other columns are ignored.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for b in batches:
            found = [sent.value.predict(x) for x in utf8(b.column(1))]
            yield batch(_ARROW, b.column(0), [x[0] for x in found], [x[1] for x in found])

    return narrowed(docs, "doc_id", "text").mapInArrow(run, _SCHEMA)


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """identify() of all `documents` by trees of those that are not held out; a row without an id is not held out, and
    teaches nothing."""
    docs = table(spark, sf_dir, "documents")
    model = train(docs.where(fold(F.col("doc_id"), 5) != 0))
    return identify(docs, model).select("doc_id", held_out(F.col("doc_id"), 5, 0).alias("held_out"), "lang_pred", "score")
