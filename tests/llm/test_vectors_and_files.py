"""Hard negatives, vector codes and id files against brute force, on rows with every oddity."""

import hashlib
import math
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from loomgraph.llm import hard_negatives, id_files, vector_codes
from loomgraph.llm.tokenizer import word_pieces

PATH = public_tokenizers.path("word_bpe_49k.json")
LIBRARY = Tokenizer.from_file(PATH)
VECTORS = "vec_id long, embedding array<float>, label int, code string, error double"
NAN, INF = float("nan"), float("inf")


def vectors(n, dims=8, seed=5, spread=0.4):
    g = np.random.default_rng(seed)
    rows = [(i, g.normal(0, spread, dims).astype(np.float32).tolist(), i % 3, "x", 0.5) for i in range(n)]
    rows += [(n + i, rows[7][1], 1, "x", 0.5) for i in range(12)]  # copies
    odd = [None, [], [None] * dims, [NAN] * dims, [INF] + [0.0] * (dims - 1), [1.0], [0.0] * dims, [3e38] * dims]
    return rows + [(n + 20 + i, v, 2, None, None) for i, v in enumerate(odd)] + [(n + 40, rows[3][1], None, None, None), (None, rows[4][1], 0, None, None)]


def whole(v, scale, most):
    if not v or any(x is None or not math.isfinite(x) for x in v):
        return None
    out = [math.floor(scale * x) for x in v]
    return out if all(abs(x) < most for x in out) else None


def negatives_by_hand(rows, anchor, positives=5, negatives=3):
    known = {}
    for vec_id, v, label, *_ in rows:
        x = whole(v, 256, 2**31)
        if vec_id is not None and label is not None and x and sum(c * c for c in x) < 2**57:
            known[vec_id] = min(known.get(vec_id, (label, x)), (label, x))
    out = set()
    for a, (own, q) in known.items():
        if not anchor(a):
            continue
        scored = sorted((-sum(p * c for p, c in zip(q, x, strict=True)), i, label) for i, (label, x) in known.items() if i != a and len(x) == len(q))
        for s, i, _ in [x for x in scored if x[2] == own][:positives]:
            fit = [(n, j) for n, j, label in scored if label != own and 50 * -s <= 100 * -n <= 95 * -s][:negatives]
            out |= {(a, i, k, j, -s, -n) for k, (n, j) in enumerate(fit, 1)}
    return out


@pytest.mark.parametrize("group, block, pivots", [(4096, 2048, 8), (5, 3, 2)])
def test_hard_negatives(spark, group, block, pivots):
    rows = vectors(120)
    df = spark.createDataFrame(rows, VECTORS).repartition(3)
    found = hard_negatives.mine(df, F.col("vec_id") % 10 == 0, group=group, block=block, pivots=pivots)
    want = negatives_by_hand(rows, lambda i: i % 10 == 0)
    assert {tuple(r) for r in found.collect()} == want and len(want) > 50


def test_hard_negatives_of_close_rows_are_pruned_alike(spark):
    """Tight clusters far apart, where pivots decide nearly everything; and large components, beyond single precision."""
    g = np.random.default_rng(2)
    for scale in (1.0, 3e4):
        rows = [(i, ((g.integers(0, 4) * 3 + g.normal(0, 0.05, 6)) * scale).tolist(), int(g.integers(0, 4)), "", 0.0) for i in range(150)]
        found = hard_negatives.mine(spark.createDataFrame(rows, VECTORS.replace("float", "double")), F.col("vec_id") % 7 == 0, group=20, block=9)
        assert {tuple(r) for r in found.collect()} == negatives_by_hand(rows, lambda i: i % 7 == 0)


def test_hard_negatives_of_nothing_and_of_repeated_rows(spark):
    none = spark.createDataFrame([], VECTORS)
    assert hard_negatives.mine(none, F.lit(True)).collect() == []
    rows = vectors(30)
    once = {tuple(r) for r in hard_negatives.mine(spark.createDataFrame(rows, VECTORS), F.col("vec_id") % 5 == 0).collect()}
    twice = hard_negatives.mine(spark.createDataFrame(rows + rows, VECTORS), F.col("vec_id") % 5 == 0).collect()
    assert len(twice) == len(once) and {tuple(r) for r in twice} == once
    odd = [(0, [1.0], 0, "", 0.0), (1, [1.0, 2.0], 0, "", 0.0), (2, [0.9], 1, "", 0.0)]
    assert hard_negatives.mine(spark.createDataFrame(odd, VECTORS), F.col("vec_id") == 0).collect() == []


def test_pivots_bracket_every_score():
    g = np.random.default_rng(9)
    x = g.integers(-300, 300, (200, 12))
    squares = (x * x).sum(axis=1)
    pivots = hard_negatives.Pivots(x[:60].astype(float), int(squares.max()), 4)
    far, asked = pivots.distances(x, squares, anchors=False), pivots.distances(x[:20], squares[:20], anchors=True)
    near = np.abs(asked[:, None] - far[None]).max(axis=2)
    wide = (asked[:, None] + far[None]).min(axis=2)
    total = (squares[:20] + squares.max())[:, None]
    score = x[:20] @ x.T
    assert (score <= (total - near**2) / 2 + 1e-3).all() and (score >= (total - wide**2) / 2 - 1e-3).all()


def codes_by_hand(rows, parts, entries, rounds, scale=1024):
    kept = [(vec_id, label, x) for vec_id, v, label, *_ in rows if (x := whole(v, scale, 2**26)) and len(x) % parts == 0]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, np.array(r[2], "<i4").tobytes()))
    kept = [r for r in kept if len(r[2]) == len(kept[0][2])]
    w = len(kept[0][2]) // parts
    cut = lambda x, p: x[p * w : (p + 1) * w]
    books = [[list(cut(r[2], p)) for r in kept[:entries]] for p in range(parts)]
    nearest = lambda x, book: min((sum((a - b) ** 2 for a, b in zip(x, c, strict=True)), i) for i, c in enumerate(book))
    for _ in range(rounds):
        for p, book in enumerate(books):
            own = {}
            for r in kept:
                own.setdefault(nearest(cut(r[2], p), book)[1], []).append(cut(r[2], p))
            for i, xs in own.items():
                book[i] = [sum(c) // len(xs) for c in zip(*xs, strict=True)]
    coded = []
    for vec_id, label, x in kept:
        found = [nearest(cut(x, p), book) for p, book in enumerate(books)]
        coded.append((vec_id, label, "".join(f"{i:02x}" for _, i in found), sum(d for d, _ in found)))
    text = ",".join(str(c) for book in books for e in book for c in e)
    return coded, hashlib.sha256(text.encode()).hexdigest()


@pytest.mark.parametrize("entries, rounds", [(16, 3), (256, 2)])
def test_codes(spark, entries, rounds):
    rows = vectors(150)
    coded, books = vector_codes.compress(spark.createDataFrame(rows + rows[:5], VECTORS).repartition(4), entries=entries, rounds=rounds)
    want, sha = codes_by_hand(rows + rows[:5], 4, entries, rounds)
    key = lambda r: (r[0] is None, *[(x is None, x) for x in r])
    assert sorted(map(tuple, coded.collect()), key=key) == sorted(want, key=key) and vector_codes.digest(books) == sha
    errors = {}
    for _, label, _, error in want:
        errors[label] = errors.get(label, 0) + error
    for most in (100, 0):  # the sums of labels broadcast, and joined
        assert {r["label"]: r["label_error"] for r in vector_codes.with_label_errors(coded, most, 3).collect()} == errors
    one = next(r for r in want if r[0] == 9)
    assert np.abs(vector_codes.decoded(one[2], books) - np.array(rows[9][1])).max() < 0.01 + math.sqrt(one[3]) / 1024


def test_codes_of_nothing_and_odd_parameters(spark):
    coded, books = vector_codes.compress(spark.createDataFrame([], VECTORS))
    assert coded.collect() == [] and books == [] and vector_codes.digest(books) == hashlib.sha256(b"").hexdigest()
    with pytest.raises(ValueError):
        vector_codes.compress(spark.createDataFrame([], VECTORS), entries=257)


def test_nearest_entries_are_exact_where_single_precision_is_not():
    g = np.random.default_rng(4)
    for size in (3, 2**12, 2**25):
        entries = g.integers(-size, size, (60, 5))
        entries[20:30] = entries[:10]
        x = np.vstack([g.integers(-size, size, (300, 5)), entries + g.integers(-1, 2, (60, 5)), (entries[:30] + entries[30:]) // 2])
        apart = ((x[:, None].astype(object) - entries[None].astype(object)) ** 2).sum(axis=2)
        index, far = vector_codes.Codebook(entries).nearest(x)
        assert index.tolist() == [int(np.argmin(row)) for row in apart] and far.tolist() == [min(row) for row in apart]


random.seed(12)
LETTERS = "aB1 \n\t'.,é×²\x85\xa0\x1c一½٣  's😀ΣİßÉ́ǅſK"
SENTENCE = "the quick brown fox doesn't jump over 12 lazy dogs. "
TEXTS = [None, "", " \n\t", "one", SENTENCE * 30, SENTENCE * 30, "x" * 3000, "a<|endoftext|>b <|startoftext|>", '"!" ' * 50, SENTENCE + "Größe naïve 一二", "\x1c\x1d a\x1cb"]
TEXTS += ["".join(random.choice(LETTERS) for _ in range(random.randrange(40))) for _ in range(60)] + [SENTENCE * k for k in range(5)]
DOCS = "doc_id long, text string, n_tokens long, part string"


def ids_of(text):
    return [*LIBRARY.encode(text or "", add_special_tokens=False).ids, 1]


def test_word_ids_are_the_library_s():
    own = word_pieces(PATH)
    odd = ["".join(random.choice(LETTERS) for _ in range(random.randrange(30))) for _ in range(3000)] + [t or "" for t in TEXTS] + ["I'LL we'Ve DON'T", "'s''s'"]
    want = [LIBRARY.encode(t, add_special_tokens=False).ids for t in odd]
    assert [np.frombuffer(own.ids(t), own.kind).tolist() for t in odd] == want
    assert [x.tolist() for x in own.many(odd)] == want


@pytest.mark.parametrize("shard", [1 << 20, 150])
def test_id_files_hold_the_library_s_ids(spark, tmp_path, shard):
    rows = [(i * 3 % 80, t, 9, "z") for i, t in enumerate(TEXTS)] + [(None, "no id", 1, None), (None, None, 1, None)] + [(5, SENTENCE, 1, None)] * 4
    path = str(tmp_path / "ids")
    id_files.write_ids(spark.createDataFrame(rows, DOCS).repartition(3), PATH, path, shard=shard)
    got = sorted(map(tuple, id_files.read_ids(spark, path).collect()), key=lambda r: r[1])
    assert [r[0] for r in got] == sorted((r[0] for r in rows), key=lambda x: (x is None, x or 0))
    start, left = 0, [(r[0], ids_of(r[1])) for r in rows]
    for doc_id, at, n, crc in got:
        assert at == start
        start += n
        fit = next(x for x in left if x[0] == doc_id and len(x[1]) == n and zlib.crc32(np.array(x[1], "<u4").tobytes()) == crc)
        left.remove(fit)
    assert not left
    number = next(i for i, t in enumerate(TEXTS) if t == SENTENCE * 30)
    want = ids_of(TEXTS[number])
    for a, n in ((0, 1 << 30), (7, 5), (100, 64), (len(want) - 1, 9), (len(want), 3), (4, 0)):
        assert want[a : a + n] in id_files.fetch(spark, path, number * 3 % 80, a, n)
    assert id_files.fetch(spark, path, 10_000) == []


def test_rules_shorten_and_open_again():
    g = np.random.default_rng(1)
    for n, kinds in ((0, 5), (1, 5), (4000, 3), (4000, 60), (3000, 1)):
        ids, last = g.integers(0, kinds, n), g.random(n) < 0.05
        last[-1:] = True
        for room in (0, 7, 10_000, 1 << 20):
            rules, lengths, symbols, ends = id_files.repair(ids, last.copy(), kinds, room)
            opened = id_files.Opened(rules.astype(np.int64), lengths, kinds)
            assert opened.ids(symbols).tolist() == ids.tolist() and len(rules) <= room and ends.sum() == last.sum()
            assert np.cumsum(opened.sizes[symbols])[ends].tolist() == (np.flatnonzero(last) + 1).tolist()
        assert n < 100 or kinds > 3 or len(symbols) < 0.8 * n


def test_id_files_of_nothing(spark, tmp_path):
    path = str(tmp_path / "none")
    id_files.write_ids(spark.createDataFrame([], DOCS), PATH, path)
    assert id_files.read_ids(spark, path).collect() == []


def test_plain_words_need_no_stand_ins():
    import public_tokenizers
    from tokenizers import Tokenizer

    from loomgraph.llm.tokenizer import WordPieces

    path = public_tokenizers.path("word_bpe_49k.json")
    own, library = WordPieces(path), Tokenizer.from_file(path)
    texts = ["Plain words, 12 of them; it's (so)!", "Straße Öl naïve ÿ", "x" * 300, "!?" * 200, "a\x7fb \x01c \x1fd", "", " ", "ªµº 日本 ﬁ"]
    assert [x.tolist() for x in own.many(texts)] == [library.encode(t, add_special_tokens=False).ids for t in texts]
    own = WordPieces(path)
    own._stand_in = {}
    assert own.many(texts[:1])[0].tolist() == library.encode(texts[0], add_special_tokens=False).ids
