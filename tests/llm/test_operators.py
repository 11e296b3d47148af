"""The corpus operators against brute force, on rows with every oddity the contracts name."""

import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from loomgraph.llm import components, decontaminate, language, line_dedup, packing, quality, simhash, token_counts, toxicity, url_filter, vector_dedup
from loomgraph.llm.tokenizer import pieces

PATH = public_tokenizers.path("byte_bpe_50k.json")
LIBRARY = Tokenizer.from_file(PATH)
random.seed(11)
WORDS = "alpha beta gamma delta naïve Straße 12 don't x.y ΩΣ 一二 end. stop! a_b".split()
LINE = "this passage of words is shared by several documents and long enough"


def sentence(n):
    return " ".join(random.choice(WORDS) for _ in range(n))


TEXTS = [None, "", "  \n\t ", "one", "two words", sentence(40), sentence(40), "x" * 5000, sentence(4000), f"{LINE}\n{sentence(9)}", f"{sentence(9)}\n{LINE}", "a<|endoftext|>b", "\x1c\x85  \n tabs\t", "É\u0301 ²½ ١٢"]
TEXTS += [TEXTS[5], TEXTS[5] + " tail", TEXTS[5].replace("alpha", "alpha", 1)]
ROWS = [(i, t, "en", "s", len(t or ""), 0.5, "z", 7) for i, t in enumerate(TEXTS)] + [(5, TEXTS[5], "en", "s", 1, 0.5, "z", 7), (None, "no id here", None, None, None, None, None, None)]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, fp string, label int"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA).repartition(3, "doc_id").cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def ids_of(text):
    return LIBRARY.encode(text or "", add_special_tokens=False).ids


def least(n, links):
    root = list(range(n))
    for _ in range(n):
        for a, b in links:
            root[a] = root[b] = min(root[a], root[b])
    return root


def test_ids_are_the_library_s():
    own, letters = pieces(PATH), "aB1 \n\t'.,é×²\x85\xa0\x1c一½٣  's😀"
    odd = ["".join(random.choice(letters) for _ in range(random.randrange(25))) for _ in range(2000)] + [t or "" for t in TEXTS]
    assert all(np.frombuffer(own.ids(t), "<u4").tolist() == ids_of(t) for t in odd)


def test_components(spark):
    e = [(random.randrange(60), random.randrange(60)) for _ in range(45)] + [(i, i + 1) for i in range(100, 160)]
    root = least(200, e)
    got = {r.node: r.root for r in components.components(spark.createDataFrame(e, "a long, b long"), "a", "b").collect()}
    assert got == {x: root[x] for a, b in e if a != b for x in (a, b)}


def test_cuts_are_optimal():
    for _ in range(200):
        points = [0, *itertools.accumulate(random.randint(1, 5) for _ in range(random.randint(1, 12)))]
        costs = [random.randint(0, 6) for _ in points]
        cost = lambda chosen: sum(8 - (points[b] - points[a]) + costs[b] for a, b in itertools.pairwise([0, *chosen]))  # noqa: E731, B023
        ways = [[*w, len(points) - 1] for n in range(len(points)) for w in itertools.combinations(range(1, len(points) - 1), n)]
        best = min(cost(w) for w in ways if all(points[b] - points[a] <= 8 for a, b in itertools.pairwise([0, *w])))
        assert cost(packing.cuts(points, costs, 8)) == best


def test_packing_round_trip(docs, none):
    out = packing.pack(docs, PATH).collect()
    spots = {}
    for r in out:
        assert spots.setdefault(r.sequence_id, {}).setdefault(r.offset, r) is r
    for s in spots.values():
        ends = [0, *itertools.accumulate(s[k].length for k in sorted(s))]
        assert sorted(s) == ends[:-1] and ends[-1] <= 1024
    whole = {}
    for r in sorted(out, key=lambda r: r.start):
        whole.setdefault(r.doc_id, []).append(r)
    for i, text, *_ in ROWS:
        ids = np.array([*ids_of(text), 0], "<u4")
        rows = whole[i]
        assert sum(r.length for r in rows) == len(ids) * sum(x[0] == i for x in ROWS)
        assert all(r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(ids[r.start : r.start + r.length].tobytes()) for r in rows)
    assert packing.pack(none, PATH).count() == 0


@pytest.mark.parametrize("most", [50_000, 0])
def test_url_filter(spark, monkeypatch, most):
    monkeypatch.setattr(url_filter, "MOST_BROADCAST", most)
    urls = [None, "", "no scheme", "http://", "http://a.COM/en/x?y://z", "https://www.example.com/en/1#t", "x://Example.com/en/", "http://example.com/EN/", "http://a.net/es/q", "http://net/fr/", "ftp://n.net?q=/es/", "http://xnet/es/", "http://m.www.example.com/en/", "http://a.com", "a://b.com/\n/x", "http://" + "a." * 20_000 + "net/es/" + "x/" * 20_000, "http://..net/fr/", "http://.com./"]
    rows = [(i % 9 or None, u, "junk") for i, u in enumerate(urls + urls[:6])]

    def judged(u):
        m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", u or "")
        h, p = (re.sub("[A-Z]", lambda c: c[0].lower(), m[1]), m[2]) if m else ("", "")
        fits = [(len(a + b), a + b, v) for a, b, v in url_filter.RULES if (h == a or h.endswith("." + a)) and p.startswith(b)]
        return (h, p, *(max(fits)[1:] if fits else (None, "allow")))

    df = spark.createDataFrame(rows, "page_id long, url string, host string")
    got = sorted(map(tuple, url_filter.judge(df, url_filter.RULES).collect()), key=str)
    assert got == sorted([(i, *judged(u)) for i, u, _ in rows], key=str)
    assert url_filter.judge(df.limit(0), url_filter.RULES).count() == 0


def test_vector_dedup(spark):
    rng = np.random.default_rng(4)
    base = rng.normal(size=(25, 12))
    rows = [(i, (base[i % 25] + 0.02 * rng.normal(size=12) * (i % 4)).tolist(), i % 2) for i in range(120)]
    rows += [(200 + i, base[3].tolist(), 1) for i in range(40)]
    rows += [(300, None, 1), (301, [], 1), (302, [0.0] * 12, 1), (303, [float("nan")] * 12, 1), (304, [None] * 12, 1), (305, base[3].tolist(), None), (None, base[3].tolist(), 1), (306, base[3].tolist()[:5], 1), (307, (1e200 * base[3]).tolist(), 1), (200, base[3].tolist(), 1)]
    valid = [(k, np.array(v, float), x) for k, (i, v, x) in enumerate(rows) if i is not None and x is not None and v and None not in v and np.isfinite(v).all() and np.any(v)]
    unit = lambda v: (v / np.abs(v).max()) / np.linalg.norm(v / np.abs(v).max())
    links = [(a, b) for (a, v, x), (b, w, y) in itertools.combinations(valid, 2) if x == y and len(v) == len(w) and unit(v) @ unit(w) >= 0.98]
    n = np.bincount(np.array(links).ravel(), minlength=len(rows))
    near = least(len(rows), links)
    expected = []
    for k, (i, *_) in enumerate(rows):
        c = min((r[0] for j, r in enumerate(rows) if near[j] == near[k] and r[0] is not None), default=None)
        expected.append((i, int(n[k]), c, i is not None and i == c))
    df = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<double>, label int, rep int")
    for sizes in ((vector_dedup.BLOCK, vector_dedup.LEAF), (6, 2)):
        assert sorted(map(str, map(tuple, vector_dedup.near_duplicates(df, 0.98, *sizes).collect()))) == sorted(map(str, expected))
    assert vector_dedup.near_duplicates(df.limit(0)).count() == 0


@pytest.mark.parametrize("rows,most", [(1000, 1000), (2, 3)])
def test_token_counts(docs, none, rows, most):
    got = sorted(map(tuple, token_counts.count_tokens(docs, PATH, rows, most).collect()), key=str)
    assert got == sorted([(i, len((t or "").encode()), len(ids_of(t))) for i, t, *_ in ROWS], key=str)
    assert token_counts.count_tokens(none, PATH).count() == 0


def test_simhash(docs, none):
    def print_of(t):
        w = re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda c: c[0].lower(), t or ""))
        if not w:
            return 0
        h = [xxhash.xxh64_intdigest(" ".join(w[i : i + 3]).encode(), 42) for i in range(max(1, len(w) - 2))]
        return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))

    prints = [print_of(t) for _, t, *_ in ROWS]
    near = least(len(ROWS), [(a, b) for a, b in itertools.combinations(range(len(ROWS)), 2) if (prints[a] ^ prints[b]).bit_count() <= 2])
    expected = [(r[0], prints[k], min((x[0] for j, x in enumerate(ROWS) if near[j] == near[k] and x[0] is not None), default=None)) for k, r in enumerate(ROWS)]
    got = [(r.doc_id, r.fp % (1 << 64), r.component_id) for r in simhash.near_duplicates(docs).collect()]
    assert sorted(got, key=str) == sorted(expected, key=str)
    kept = simhash.one_of_each(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.where("doc_id is not null").collect()) == sorted({c for _, _, c in expected if c is not None})
    assert kept.where("doc_id is null").count() == 1
    assert simhash.near_duplicates(none).count() == 0


def test_simhash_keeps_one_row_of_each_group(spark):
    a, b, c = (" ".join(f"{w}{k}" for k in range(30)) for w in ("one", "two", "three"))
    rows = [(None, a, k) for k in range(40)] + [(None, f"  {a}", 99)]  # copies, and one that is not, none with an id
    rows += [(5, b, 1), (5, c, 2), (2, c, 3), (7, c, 4), (None, c, 5), (None, None, 6), (None, "", 7), (None, None, 6)]
    for seed in range(3):
        dealt = random.Random(seed).sample(rows, len(rows))
        kept = simhash.one_of_each(spark.createDataFrame(dealt, "doc_id long, text string, n int").repartition(4)).collect()
        assert sorted((r.doc_id or 0, (r.text or "").strip()) for r in kept) == sorted([(0, a), (5, b), (2, c), (0, "")])
        assert seed == 0 or {tuple(r) for r in kept} == before
        before = {tuple(r) for r in kept}


def test_half_balls_find_every_pair(spark):
    fps = {random.getrandbits(64) for _ in range(20)}
    for f in [*fps]:
        fps |= {f ^ (1 << random.randrange(64)) ^ (1 << random.randrange(64)) for _ in range(4)}
    fps = sorted(fps)
    signed = [int(np.uint64(f).astype(np.int64)) for f in fps]
    linked = [(a, b) for a, b in itertools.combinations(range(len(fps)), 2) if (fps[a] ^ fps[b]).bit_count() <= 2]
    of = {f: i for i, f in enumerate(signed)}
    found = [(of[r.fp], of[r.other]) for r in simhash.links(spark.createDataFrame([(f,) for f in signed], "fp long")).collect()]
    assert {tuple(sorted(x)) for x in found} <= set(linked)
    assert least(len(fps), found) == least(len(fps), linked)


@pytest.mark.parametrize("most", [100_000, 7])
def test_decontaminate(spark, docs, none, most):
    pick = (TEXTS[8] or "").split()
    items = [(1, " ".join(pick[100:125])), (2, "Two, WORDS!"), (3, None), (4, ""), (5, " ".join(pick[110:130]) + " other"), (None, "one"), (10, " ".join(pick[100:125])), (7, "never seen words")]
    bench = spark.createDataFrame([(*x, "b") for x in items], "item_id long, text string, doc_id string")
    split = lambda t: re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda c: c[0].lower(), t or ""))
    expected = []
    for i, t, *_ in ROWS:
        w, hit, seen = split(t), set(), set()
        for item, text in items:
            own = split(text)
            for p in [own[k : k + 10] for k in range(max(1, len(own) - 9))] if own else []:
                for at in range(len(w) - len(p) + 1):
                    if w[at : at + len(p)] == p:
                        hit.update(range(at, at + len(p)))
                        seen |= {str(item)} if item is not None else set()
        expected.append((i, len(w), len(hit), len(seen), hashlib.sha256(",".join(sorted(seen)).encode()).hexdigest(), bool(hit)))
    got = [tuple(r) for r in decontaminate.search(docs, bench, most=most).drop("spans", "items").collect()]
    assert sorted(got, key=str) == sorted(expected, key=str)
    clean = decontaminate.without_contaminated(docs, bench, most=most)
    assert clean.columns == docs.columns and clean.count() == sum(not e[-1] for e in expected)
    assert decontaminate.search(none, bench).count() == 0
    assert decontaminate.search(docs, bench.limit(0)).where("contaminated").count() == 0


def test_line_dedup(spark, docs, none):
    assert line_dedup.without_recurring(docs).columns == docs.columns
    out = {(r.doc_id, i): r for i, r in enumerate(line_dedup.without_recurring(docs).collect())}
    by = {k[0]: r.text for k, r in out.items()}
    assert LINE in by[9] and LINE not in by[10] and by[10] == TEXTS[10].split("\n")[0]
    assert by[0] is None and by[1] == "" and by[5] == TEXTS[5] and by[14] == "" and by[8] == TEXTS[8]
    shared = "report number 17 of the northern office was filed on time today"
    other = shared.replace("17", "99")
    varied = shared.replace("northern", "southern")
    rows = [(1, f"{shared}\nfirst body"), (2, f"second body\n\n{other}\n"), (3, f"{varied}\nthird body"), (4, "All rights reserved."), (5, "All rights reserved."), (None, shared), (7, f"{shared} and\nseventh body")]
    got = {r.row.doc_id: (r.text, r.n_lines, r.n_dropped) for r in line_dedup._rewritten(spark.createDataFrame([(*r, 3) for r in rows], "doc_id long, text string, keeper int")).collect()}
    assert got == {1: (rows[0][1], 2, 0), 2: ("second body\n\n", 4, 1), 3: ("third body", 2, 1), 4: ("All rights reserved.", 1, 0), 5: ("All rights reserved.", 1, 0), None: ("", 1, 1), 7: (rows[6][1], 2, 0)}
    split = {r.doc_id: r.text for r in line_dedup.without_recurring(spark.createDataFrame(rows, "doc_id long, text string"), full=1).collect()}
    assert split[2] == "second body\n\n"
    assert line_dedup.without_recurring(none).count() == 0


def test_line_templates_are_the_same_at_every_size(spark):
    rng = random.Random(7)
    lines = [" ".join(["it", "is", "the", *(rng.choice("abc") for _ in range(n - 3))]) for n in (4, 5, 9, 12) for _ in range(40)]
    lines += [f"thanks to our reader {w} for the kind letter of today" for w in WORDS * 3]
    rows = [(i, "\n".join(rng.sample(lines, 4))) for i in range(70)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    held = {}
    for i, text in rows:
        for line in text.encode().split(b"\n"):
            held.setdefault(line_dedup.masked(line), set()).add(i)
    founders, of = [], {}
    for line in sorted(held, key=lambda x: (-len(held[x]), x)):
        w = line.split()
        fit = lambda f: len(f) == len(w) and f[:3] == w[:3] and sum(a != b for a, b in zip(f, w, strict=True)) <= int(len(w) / 5 + 1e-9)  # noqa: E731, B023
        of[line] = next((k for k, f in enumerate(founders) if fit(f)), len(founders))
        founders += [w] if of[line] == len(founders) else []
    expected = set()
    for line, k in of.items():
        own = [x for x in of if of[x] == k]
        ids, support = set().union(*(held[x] for x in own)), sum(len(held[x]) for x in own)
        words = [b"<*>" if len({x.split()[i] for x in own}) > 1 else w for i, w in enumerate(founders[k])]
        if len(ids) > 1 and (len(words) >= 8 or support >= 10):
            expected.add((line_dedup.digest(line), b" ".join(words), support, min(ids)))
    assert any(b"<*>" in t for _, t, *_ in expected)
    for full in (line_dedup.FULL, 8):
        got = [(bytes(r.digest), bytes(r.template), r.support, r.keeper) for r in line_dedup.recurring(docs, full=full).collect()]
        assert len(got) == len(expected) and set(got) == expected


@pytest.mark.parametrize("full", [line_dedup.FULL, 1])
def test_line_dedup_counts_rows_without_an_id(spark, full):
    lines = [f"the same notice of the northern office stands below {w} every letter" for w in ("here", "there")]
    alone = "this long line stands in one of the texts alone and stays"
    rows = [(None, f"{lines[k % 2]}\nletter {w}") for k, w in enumerate("abcdef")] + [(None, alone)] * 2 + [(-4, f"{alone[5:]}\nown")]
    got = line_dedup.without_recurring(spark.createDataFrame(rows, "doc_id long, text string"), full=full).collect()
    texts = sorted(r.text for r in got)
    assert sum("notice" in t for t in texts) == 1 and len(texts) == len(rows)
    assert texts.count(alone) == 2 and f"{alone[5:]}\nown" in texts


def test_language_code_lengths_are_chances():
    counts = np.zeros(5**4, np.int64)
    counts[np.random.default_rng(1).integers(0, 5**4, 60)] += 3
    p = np.exp2(-language.code_lengths(counts, 5).astype(float)).reshape(-1, 5)
    assert np.allclose(p.sum(axis=1), 1, atol=1e-4)


def test_language_code_lengths_of_every_byte():
    texts = ["ab aç Жук abc".encode() * 3, "жук ىتب ab".encode(), b""]
    seen = []
    for t in texts:
        padded = b"   " + t.translate(bytes(language._FOLDED))
        seen.append([{} for _ in range(4)])
        for i in range(len(t)):
            for k in range(4):
                run = padded[i + 3 - k : i + 4]
                seen[-1][k][run] = seen[-1][k].get(run, 0) + 1

    def chances(held, context):
        if context is None:
            return [1 / 256] * 256
        shorter = chances(held, context[1:] if context else None)
        own = {r[-1]: c for r, c in held[len(context)].items() if r[:-1] == context}
        if not own:
            return shorter
        whole = sum(own.values()) + len(own)
        out = [own[b] / whole if b in own else shorter[b] * len(own) / whole for b in range(256)]
        return [x / sum(out) for x in out]

    model = language.Model(["a", "b", "c"], [np.unique(language.grams(t), return_counts=True) for t in texts])
    for context in (b"   ", b"ab ", b" \xd0\xb6", b"k\xd8\xaa", b"\xff\xfe\xfd", b"zab"):
        got = np.exp2(-model.trees().lengths(np.array([int.from_bytes(context + bytes([b]), "big") for b in range(256)])).astype(float))
        assert np.allclose(got, np.array([chances(held, context) for held in seen]).T, rtol=1e-4)


def test_language_keeps_scripts_apart(spark):
    rng = random.Random(3)
    make = lambda letters, n: " ".join("".join(rng.choice(letters) for _ in range(4)) for _ in range(n))
    latin = "abcdefghijklmnopqrstuvwxyz0123456789.,;:-!?()"
    alphabets = {"ar": "ابتثجحخد", "fa": "رزسشصضطظ", "bg": "абвгдежз", "ru": "иклмнопр", "en": latin}
    rows = [(100 * k + i, make(a, 30), lang) for k, (lang, a) in enumerate(alphabets.items()) for i in range(60 if lang == "en" else 12)]
    rows += [(9999, make(latin, 200_000), "en")]
    model = language.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    asked = [(k, make(a, 8), lang) for k, (lang, a) in enumerate(sorted(alphabets.items()) * 5)]
    got = {r.doc_id: r.lang_pred for r in language.identify(spark.createDataFrame(asked, "doc_id long, text string, lang string"), model).collect()}
    assert got == {k: lang for k, _, lang in asked}


def test_language(spark, docs, none):
    out = language.op7_language(spark, "/root/testdata/sf0.01").alias("o").join(spark.read.parquet("/root/testdata/sf0.01/documents.parquet").alias("d"), "doc_id")
    held = out.where("held_out")
    assert held.where("lang_pred = lang").count() >= 0.97 * held.count()
    model = language.train(docs)
    got = {r.doc_id: r.lang_pred for r in language.identify(docs, model).collect()}
    assert got[0] == got[1] == got[2] == "und" and got[3] == "en"
    assert language.identify(none, model).count() == 0
    assert {r.lang_pred for r in language.identify(docs, language.train(none)).collect()} == {"und"}


def test_ftrl_is_the_scalar_one():
    rng = np.random.default_rng(3)
    rows = [(np.sort(rng.choice(12, 4, replace=False)), rng.random(4)) for _ in range(30)]
    labels = [int(i.min() < 3) for i, _ in rows]
    alpha, beta, l1, l2 = 0.3, 1.0, 0.05, 0.5
    z, n = [0.0] * 12, [0.0] * 12

    def weight(i):
        if abs(z[i]) <= l1:
            return 0.0
        return -(z[i] - (1 if z[i] > 0 else -1) * l1) / ((beta + n[i] ** 0.5) / alpha + l2)

    order = np.random.default_rng(1)
    for _ in range(3):
        for k in order.permutation(len(rows)):
            at, x = rows[k]
            w = [weight(i) for i in at]
            p = 1 / (1 + np.exp(-sum(a * b for a, b in zip(w, x, strict=True))))
            for i, v, old in zip(at, x, w, strict=True):
                g = (p - labels[k]) * v
                sigma = ((n[i] + g * g) ** 0.5 - n[i] ** 0.5) / alpha
                z[i] += g - sigma * old
                n[i] += g * g
    kept, w = quality.train(rows, labels, alpha, beta, l1, l2, epochs=3)
    expected = {i: weight(i) for i in range(12) if weight(i)}
    assert len(expected) > 5 and dict(zip(kept.tolist(), w.tolist(), strict=True)) == pytest.approx(expected, rel=1e-5)


def test_risk_gradient_is_the_numeric_one():
    rng = np.random.default_rng(6)
    column, prior, signs = np.arange(1 << 20), 0.3, set()
    p, u = (toxicity._Rows([rng.choice(8, 3, replace=False) for _ in range(n)], column) for n in (9, 14))
    for scale, c in ((0.5, 0.1), (2.0, -3.0), (0.1, 4.0), (3.0, 0.0)):
        w = scale * rng.normal(size=8)
        if c == 4.0:  # the classifier is sure of positives alone: the corrected part falls below 0
            w, c = np.where(np.bincount(u.at, minlength=8) > 4, -9.0, 0.0), 6.0
        sign = -1 if toxicity.risk(p, u, w, c, prior)[1] < 0 else 1
        signs.add(sign)
        total = lambda w, c, s=sign: -toxicity.risk(p, u, w, c, prior)[1] if s < 0 else sum(toxicity.risk(p, u, w, c, prior))
        g, gc = toxicity.gradient(p, u, w, c, prior)
        for i in range(8):
            step = np.eye(8)[i] * 1e-6
            assert g[i] == pytest.approx((total(w + step, c) - total(w - step, c)) / 2e-6, abs=1e-5)
        assert gc == pytest.approx((total(w, c + 1e-6) - total(w, c - 1e-6)) / 2e-6, abs=1e-5)
    direct = prior * np.mean([np.log1p(np.exp(-(w[p.at[p.row == k]].sum() + c))) for k in range(9)])
    assert toxicity.risk(p, u, w, c, prior)[0] == pytest.approx(direct)


def test_training_rows_are_bounded_by_their_features(spark):
    from loomgraph.llm.features import bounded

    rows = spark.createDataFrame([(i, i % 2, [*range(10 + i % 3)]) for i in range(40)] + [(7, 1, [5, 6])], "doc_id long, label int, at array<int>")
    assert bounded(rows, "label").num_rows == 41
    few = bounded(rows, "label", 100)
    assert 0 < few.num_rows < 12 and sum(len(x) for x in few.column("at").to_pylist()) <= 100
    assert few.equals(bounded(rows.repartition(5), "label", 100))


@pytest.mark.parametrize("op,label", [(quality.op5_quality, "quality"), (toxicity.op6_toxicity, "toxic")])
def test_classifiers_on_held_out_rows(spark, op, label):
    sf = "/root/testdata/sf0.01"
    out = op(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out").select("score", label).collect()
    good, bad = [r.score for r in out if r[label] == 1], [r.score for r in out if r[label] == 0]
    assert np.mean([(g > b) + (g == b) / 2 for g in good for b in bad]) > 0.93


def test_classifiers_on_odd_rows(spark, docs, none):
    labels = spark.createDataFrame([(5, 1, 0), (8, 0, 1), (None, 1, 1), (9, None, None), (99, 1, 1)], "doc_id long, quality int, toxic int")
    q = quality.learn(docs, labels)
    t = toxicity.learn(docs, labels.where("toxic = 1").select("doc_id"), 0.2)
    for f, model in ((quality.score, q), (toxicity.score, t)):
        got = f(docs, model).collect()
        assert len(got) == len(ROWS) and all(0 <= r.score <= 1 for r in got)
        assert f(none, model).count() == 0
    empty = toxicity.learn(docs, labels.limit(0).select("doc_id"), 0.2)
    assert toxicity.score(docs, empty).where("predicted = 1 or score > 0").count() == 0
    assert toxicity.without_toxic(docs, empty).count() == len(ROWS)
    assert quality.score(docs, quality.learn(docs, labels.limit(0))).select("score").distinct().count() == 1


def test_non_negative_risk_learns_from_unlabelled_rows():
    rng = np.random.default_rng(2)
    other = lambda: rng.choice(np.arange(100, 400), 12, replace=False)
    toxic = [np.unique(np.append(other(), rng.choice([1, 2, 3]))) for _ in range(60)]
    mixed = [np.unique(np.append(other(), rng.choice([1, 2, 3]))) if k % 5 == 0 else other() for k in range(300)]
    kept, w, c = toxicity.train(toxic, mixed, 0.2)
    full = np.zeros(1 << 20)
    full[kept] = w
    scores = [full[s].sum() + c for s in mixed]
    assert np.mean([scores[k] for k in range(0, 300, 5)]) > np.mean([s for k, s in enumerate(scores) if k % 5]) + 2


def test_pipeline(spark):
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, before = docs.columns, docs.count()
    model = toxicity.from_labels(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    toxic = {r.doc_id for r in toxicity.score(docs, model).where("predicted = 1").collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out, _ = corpus_pipeline.cut(stage(spark, docs, sf), name)
        assert out.columns == columns and out.count() <= docs.count()
        if name == "toxicity":
            assert {r.doc_id for r in out.collect()} == {r.doc_id for r in docs.collect()} - toxic
        if name == "line_dedup":
            assert out.count() == docs.count() and out.where("n_chars <> length(text)").count() <= docs.where("n_chars <> length(text)").count()
        if name == "simhash":
            assert {r.doc_id for r in out.collect()} == {r.component_id for r in simhash.near_duplicates(docs).collect()}
        if name == "decontaminate":
            assert {r.doc_id for r in out.collect()} == {r.doc_id for r in decontaminate.search(docs, spark.read.parquet(f"{sf}/benchmark.parquet")).where("not contaminated").collect()}
        docs = out
    assert 0 < docs.count() < before
    packed = corpus_pipeline.run(spark, sf)
    assert {r.doc_id for r in packed.select("doc_id").distinct().collect()} == {r.doc_id for r in docs.collect()}
    whole = lambda df: {(r.doc_id, r.n) for r in df.groupBy("doc_id").agg(F.sum("length").alias("n")).collect()}
    assert whole(packed) == whole(packing.pack(docs, PATH))


NAMES = "row key print whole gone n _id _hash _gone _kept _row _text_hash id hash fp root first best item m h window at order found items".split()


def _clashing(spark, rows):
    """Rows (doc_id, text) with a column of every name that stages use inside."""
    schema = "doc_id long, text string, n_chars int, " + ", ".join(f"{c} string" for c in NAMES)
    return spark.createDataFrame([(i, t, len(t or ""), *(f"{c}{k}" for c in NAMES)) for k, (i, t) in enumerate(rows)], schema)


def test_pipeline_of_odd_rows(spark, tmp_path):
    import corpus_pipeline

    shared = "this notice of the northern office stands in many letters of the year"
    item = "which of these ten words would nobody write by chance here today"
    body = lambda k: " ".join(f"{w}{k}" for w in "one two three four five six seven eight nine ten eleven twelve".split())
    rows = [(1, None), (2, ""), (None, None), (3, f"{shared}\n{body('a')}"), (4, f"{body('b')}\n{shared}"), (4, f"{body('b')}\n{shared}"), (None, body("c")), (None, f"{shared}\n{body('d')}"), (5, f"{body('e')} {item}"), (6, "awful vile words " + body("f")), (7, body("a") + " x" * 30_000), (4, body("g"))]
    labels = spark.createDataFrame([(100, 1, 1), (101, 1, 0), (None, 1, 1), (3, None, None)], "doc_id long, quality int, toxic int")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([("i1", item), (None, ""), ("i2", None)], "item_id string, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = _clashing(spark, rows)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    same = lambda a, b: sorted(map(str, map(tuple, a.collect()))) == sorted(map(str, map(tuple, b.collect())))
    kept, stages = {}, docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, stages, str(tmp_path))
        assert out.columns == docs.columns
        assert stage(spark, stages.limit(0), str(tmp_path)).count() == 0
        stages, _ = corpus_pipeline.cut(out, name)
        kept[name] = stages
    assert same(kept["toxicity"], docs)  # nothing was learnt, so nothing goes
    lines = kept["line_dedup"]
    assert lines.count() == len(rows) and lines.where("n_chars <> coalesce(length(text), 0)").count() == 0
    assert same(lines.drop("text", "n_chars"), docs.drop("text", "n_chars"))
    assert sorted(str(r.doc_id) for r in lines.where(F.col("text").contains(shared)).collect()) == ["3"]
    one = kept["simhash"].collect()
    assert sorted((str(r.doc_id), (r.text or "")[:4]) for r in one) == sorted([("1", ""), ("3", "this"), ("4", "oneb"), ("4", "oneg"), ("None", "onec"), ("None", "oned"), ("5", "onee"), ("6", "awfu"), ("7", "onea")])
    assert {r.doc_id for r in kept["decontaminate"].collect()} == {1, 3, 4, None, 6, 7}
    packed = corpus_pipeline.run(spark, str(tmp_path))
    assert packed.groupBy().agg(F.sum("length")).first()[0] == sum(len(ids_of(r.text)) + 1 for r in kept["decontaminate"].collect())
    assert packing.pack(docs.limit(0), PATH).count() == 0


def test_held_out_is_never_null_and_ids_are_integers(spark, tmp_path):
    spark.createDataFrame([(1, "a b", "en"), (None, "c d", "en"), (None, None, None)], "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for op in (quality.op5_quality, toxicity.op6_toxicity, language.op7_language):
        got = op(spark, str(tmp_path)).collect()
        assert len(got) == 3 and all(r.held_out is False for r in got if r.doc_id is None) and None not in [r.held_out for r in got]
    with pytest.raises(TypeError):
        simhash.near_duplicates(spark.createDataFrame([("x", "a")], "doc_id string, text string"))


def test_many_dropped_lines_of_one_text(spark):
    lines = [f"the line of letter {chr(97 + k % 26)}{chr(97 + k // 26 % 26)}{chr(97 + k // 676)} and some more words here" for k in range(3000)]
    rows = [(1, "\n".join(lines)), (2, "\n".join([*lines[::-1], "", "own last line"]))]
    got = {r.row.doc_id: r for r in line_dedup._rewritten(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1].n_dropped == 0 and got[2].n_dropped == 3000 and got[2].text == "\nown last line" and got[2].n_lines == 3002
