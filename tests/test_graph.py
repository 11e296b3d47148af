import os
import pickle
import random
import re
import zlib

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from loomgraph.config import EngineConfig
from loomgraph.functions import decision
from loomgraph.operators import algorithms, ingest, measure, post, retrieve
from loomgraph.plans.queries import QUERIES, SQL
from loomgraph.sources import factory
from loomgraph.sources.store import GraphStore, vacuum

TABLES = "region nation customer supplier part orders lineitem events documents embeddings benchmark conversations labels pages".split()


def test_best_first_rules():
    e = lambda **k: {a: [(t, 0.8, 5.0) for t in b] for a, b in k.items()}
    assert retrieve.best_first({}, "Root", 2, 5) == [(["Root"], 1.0, 0, False)]
    one = retrieve.best_first(e(A="B"), "A", 1, 1)
    assert one[0][0] == ["A", "B"] and one[0][1] == pytest.approx(0.545)
    assert retrieve.best_first(e(A="B", B="A"), "A", 4, 5) == []
    assert sorted(p for p, *_ in retrieve.best_first(e(A="BC", B="D", C="D"), "A", 2, 9)) == [["A", "B", "D"], ["A", "C", "D"]]
    assert [p for p, *_ in retrieve.best_first(e(A="BC", B="A"), "A", 4, 9)] == [["A", "C"]]
    fan = {"R": [("Hi", 0.8, 9.0), ("Lo", 0.8, 1.0)]}
    assert [(p[-1], round(f, 3)) for p, f, *_ in retrieve.best_first(fan, "R", 1, 9)] == [("Hi", 0.645), ("Lo", 0.445)]
    flagged = retrieve.best_first(e(A="B", B="C"), "A", 4, 9, stop=lambda p: len(p) == 2)
    assert flagged == [(["A", "B"], pytest.approx(0.545), 1, True)]


def test_greedy_stops_at_target():
    assert retrieve.greedy({"A": [("B", 0.9, 0), ("C", 0.5, 0)], "B": [("D", 0.1, 0)]}, "A", "C", 3) == ["A", "C"]


def test_config_ranges():
    with pytest.raises(ValueError):
        EngineConfig(boundary=1.5)
    with pytest.raises(ValueError):
        EngineConfig(max_pagerank=0.0)


def test_algorithms_against_brute_force(spark):
    random.seed(5)
    pairs = [(f"n{random.randrange(30)}", f"n{random.randrange(30)}") for _ in range(35)]
    edges = spark.createDataFrame(pairs, "src string, tgt string")
    near = {}
    for a, b in pairs:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    least = {n: n for n in near}
    for _ in near:
        least = {n: min([least[n], *(least[m] for m in near[n])]) for n in near}
    assert {r.name: r.community for r in algorithms.components(edges).collect()} == least
    core = dict.fromkeys(near, 0)
    for k in range(1, 6):
        left = {n: {m for m in v if m != n} for n, v in near.items()}
        while gone := [n for n, v in left.items() if len(v) < k]:
            left = {n: v - set(gone) for n, v in left.items() if n not in gone}
        core.update(dict.fromkeys(left, k))
    assert {r.name: r.core for r in algorithms.k_core(edges).collect()} == core
    assert sum(r.pagerank for r in algorithms.pagerank(edges, iterations=8).collect()) == pytest.approx(1.0)


def _ranks(pairs, mode, steps=20, d=0.85):
    out = {}
    for a, b in pairs:
        out.setdefault(a, []).append(b)
        out.setdefault(b, [])
    rank = dict.fromkeys(out, 1 / len(out) if mode == "nx" else 1 - d)
    for _ in range(steps):
        loose = sum(rank[a] for a in out if not out[a]) / len(out)
        new = dict.fromkeys(out, (1 - d) / len(out) + d * loose if mode == "nx" else 1 - d)
        for a, to in out.items():
            for b in to:
                new[b] += d * rank[a] / len(to)
        rank = new
    return rank


@pytest.mark.parametrize("name,mode,digits", [("pagerank_nx", "nx", 9), ("pagerank_gds", "gds", 9)])
def test_ranks_of_twenty_steps(spark, sf_dir, monkeypatch, name, mode, digits):
    pairs = {(f"n{i}", f"n{i + 1}") for i in range(14)} | {("n9", "n2"), ("n3", "n3"), ("n14", "n7"), ("n20", "n4"), ("n20", "n21")}
    store = GraphStore(None, spark.createDataFrame([*pairs, ("n0", "n1")], "src string, tgt string"))
    monkeypatch.setattr("loomgraph.plans.queries.business_graph", lambda *_: store)
    got = {r.name: r.pagerank for r in QUERIES[name](spark, sf_dir).collect()}
    assert got == pytest.approx(_ranks(pairs, mode), abs=10**-digits)


def test_ranks_without_cycles_settle_early_and_quiet_nodes_cost_little(spark, monkeypatch):
    pairs = {(f"n{i}", f"n{j}") for i in range(9) for j in (i + 1, i + 3)} | {("x", f"n{i}") for i in range(9)}
    edges = spark.createDataFrame(sorted(pairs), "src string, tgt string")
    steps = []
    monkeypatch.setattr(algorithms.Links, "sent", lambda self, *a, of=algorithms.Links.sent: steps.append(1) or of(self, *a))
    ranks, settled = algorithms.ranked_until(edges, mode="gds")
    assert settled and len(steps) <= 12 and {r.name: r.pagerank for r in ranks.collect()} == pytest.approx(_ranks(pairs, "gds"), abs=1e-12)
    ring = sorted(pairs | {("n11", "n0"), ("n10", "n2")})
    exact, near = (algorithms.ranked_until(spark.createDataFrame(ring, "src string, tgt string"), mode="gds", iterations=60, quiet=q)[0].collect() for q in (0.0, 1e-6))
    assert {r.name: r.pagerank for r in near} == pytest.approx({r.name: r.pagerank for r in exact}, abs=1e-4)


def test_components_and_cores_over_all_edges(spark, monkeypatch):
    chain = [(f"c{i:02}", f"c{i + 1:02}", "PART_OF") for i in range(18)]
    hub = [("hub", f"h{i}", "CONTAINS") for i in range(12)] + [(f"h{i}", f"h{j}", "SUPPLIED_BY") for i in range(4) for j in range(i)]
    pairs = [*chain, *hub, ("c18", "hub", "LOCATED_IN"), ("o1", "z1", "PLACED_BY"), ("z1", "z1", "PLACED_BY")]
    store = GraphStore(None, spark.createDataFrame(pairs, "src string, tgt string, rel_type string"))
    monkeypatch.setattr("loomgraph.plans.queries.business_graph", lambda *_: store)
    near = {}
    for a, b, _ in pairs:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    least = {n: n for n in near}
    for _ in near:
        least = {n: min([least[n], *(least[m] for m in near[n])]) for n in near}
    assert {r.name: r.community for r in QUERIES["wcc"](spark, "").collect()} == least
    core = dict.fromkeys(near, 0)
    for k in range(1, 6):
        left = {n: v - {n} for n, v in near.items()}
        while gone := [n for n, v in left.items() if len(v) < k]:
            left = {n: v - set(gone) for n, v in left.items() if n not in gone}
        core.update(dict.fromkeys(left, k))
    assert {r.name: r.core for r in QUERIES["kcore"](spark, "").collect()} == core and max(core.values()) > 3


def test_conflicts_of_whole_texts(spark, tmp_path):
    texts = [f"zzz yyy {'x' * 90}", f"the of and was der und {'x' * 90} end of it", "third"]
    rows = [(i, t, "web", "en") for i, t in enumerate(texts)] + [(9, "alone", "web", "de"), (8, "none", None, "de")]
    spark.createDataFrame(rows, "doc_id long, text string, source string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    assert [tuple(r) for r in QUERIES["conflicts"](spark, str(tmp_path)).collect()] == [(0, "web en", *texts[:2])]
    assert [tuple(r) for r in QUERIES["resolve_conflicts"](spark, str(tmp_path)).collect()] == [(0, "web en", texts[1])]
    log = QUERIES["conflict_log"](spark, str(tmp_path)).first()
    assert log.selected == "b" and 0.5 < log.confidence <= 1


def test_store_guards_ends_and_merges(spark):
    nodes = spark.createDataFrame([("a", "E", {"x": "1"}, None, None), ("b", "E", None, 2.0, None)], "name string, label string, props map<string,string>, pagerank double, community_id long")
    store = GraphStore(nodes, spark.createDataFrame([("a", "b", "R", None)], "src string, tgt string, rel_type string, props map<string,string>"))
    store = store.upsert_nodes(spark.createDataFrame([("a", None, {"x": "2", "y": "3"})], "name string, label string, props map<string,string>"))
    got = {r.name: (r.label, r.props) for r in store.nodes.collect()}
    assert got["a"] == ("E", {"x": "2", "y": "3"})
    store = store.upsert_edges(spark.createDataFrame([("a", "zz", "R", None), ("b", "a", "R", None)], "src string, tgt string, rel_type string, props map<string,string>"))
    assert {(r.src, r.tgt) for r in store.edges.collect()} == {("a", "b"), ("b", "a")}
    assert {(r.src, r.tgt) for r in store.delete_edges(spark.createDataFrame([("a", "b", "R")], "src string, tgt string, rel_type string")).edges.collect()} == {("b", "a")}
    assert [(r.tgt, r.pagerank) for r in store.neighbors(spark.createDataFrame([("b",)], "src string")).collect()] == [("a", 0.0)]


def test_repeated_keys_make_one_row(spark):
    kinds = "name string, label string, props map<string,string>"
    store = GraphStore.empty(spark).upsert_nodes(spark.createDataFrame([("a", "old", {"x": "1", "y": "1"}, 1), ("a", "new", {"x": "2"}, 2), ("a", None, {"z": "3"}, 3), ("b", "E", None, 1), (None, "E", None, 1)], f"{kinds}, ord int"))
    assert {r.name: (r.label, r.props) for r in store.nodes.collect()} == {"a": ("new", {"x": "2", "y": "1", "z": "3"}), "b": ("E", {})}
    edges = spark.createDataFrame([("a", "b", "R", {"k": "1"}, 1), ("a", "b", "R", {"k": "2"}, 2), ("a", "c", "R", None, 1)], "src string, tgt string, rel_type string, props map<string,string>, ord int")
    store = store.upsert_edges(edges).upsert_edges(edges.where("ord = 1"))
    assert [(r.src, r.tgt, r.props) for r in store.edges.collect()] == [("a", "b", {"k": "1"})]
    vectors = spark.createDataFrame([("a", [1.0], 1), ("a", [2.0], 2), ("zz", [3.0], 1), ("b", None, 1)], "name string, embedding array<double>, ord int")
    store = store.set_embeddings(vectors).set_embeddings(vectors.where("name = 'a'"))
    assert [tuple(r) for r in store.embeddings.collect()] == [("a", [2.0])]
    assert store.duplicates().count() == 0


def test_a_store_saved_over_itself_keeps_its_data(spark, tmp_path):
    path = f"{tmp_path}/graph"
    with pytest.raises(FileNotFoundError):
        GraphStore.open(spark, path)
    nodes = spark.createDataFrame([("a", "E", None), ("b", "E", None)], "name string, label string, props map<string,string>")
    store = GraphStore.create(spark, path).upsert_nodes(nodes).upsert_edges(spark.createDataFrame([("a", "b", "R", None)], "src string, tgt string, rel_type string, props map<string,string>"))
    store.set_embeddings(spark.createDataFrame([("a", [0.5, 1.0])], "name string, embedding array<double>")).save(path)
    opened = GraphStore.create(spark, path)
    opened.save(path)
    again = factory.open_store(spark, " PARQUET ", path)
    for one in (opened, again):
        assert (one.nodes.count(), [tuple(r)[:3] for r in one.edges.collect()], [tuple(r) for r in one.embeddings.collect()]) == (2, [("a", "b", "R")], [("a", [0.5, 1.0])])
    os.makedirs(f"{path}/v0000000009-broken/nodes")  # of a save that did not end
    vacuum(spark, path)
    assert sorted(os.listdir(path))[0] == "_versions" and len(os.listdir(path)) == 2
    assert GraphStore.open(spark, path).edges.count() == 1


def test_stores_by_name(spark):
    assert [factory.resolve(x) for x in (None, " ", "Folder", "views", "odd")] == ["parquet", "parquet", "parquet", "views", "odd"]
    assert factory.resolve("", "tables") == "views" and factory.resolve("memory", "tables") == "memory"
    store = GraphStore.empty(spark)
    store.nodes.createOrReplaceTempView("some_nodes")
    store.edges.createOrReplaceTempView("some_edges")
    assert factory.open_store(spark, "views", "some").embeddings is None
    assert factory.open_store(spark, "memory").nodes.count() == 0
    for bad in (("odd", "x"), ("parquet", "")):
        with pytest.raises(ValueError):
            factory.open_store(spark, *bad)


def test_merge_fold(spark):
    kind = "g int, ord int, a string, b string, score double"
    pairs = spark.createDataFrame([(1, 0, "abc", "abcde", 0.99), (1, 1, "abc", "abcdefgh", 0.97), (1, 2, "xx", "yy", 0.96)], kind)
    assert [(r.loser, r.winner) for r in ingest.merge_names(pairs, "g").collect()] == [("abc", "abcde"), ("abcde", "abcdefgh"), ("yy", "xx")]
    # The second pair is judged as abcde and abcdefgh, which are less alike than abc and abcdefgh.
    unlike = pairs.unionByName(spark.createDataFrame([(1, None, "abcde", "abcdefgh", 0.5)], kind))
    assert [(r.loser, r.winner) for r in ingest.merge_names(unlike, "g", 0.95).collect()] == [("abc", "abcde"), ("yy", "xx")]
    assert {(r.name, r.canonical) for r in ingest.canonical_names(unlike, "g", 0.95).collect()} == {("abc", "abcde"), ("abcde", "abcde"), ("xx", "xx"), ("yy", "xx")}
    assert {(r.name, r.canonical) for r in ingest.merge_components(pairs).collect()} == {("abc", "abcdefgh"), ("abcde", "abcdefgh"), ("abcdefgh", "abcdefgh"), ("xx", "xx"), ("yy", "xx")}


def _merges_in_order(pairs, least=None, score=None):
    """The fold as it is defined: one pair after another, every name renamed at each merge."""
    called, log = {}, []
    for _, a, b, s in sorted(pairs):
        a, b = called.get(a, a), called.get(b, b)
        p = s if least is None else score(a, b)
        if a == b or least is not None and p < least:
            continue
        winner, loser = (a, b) if len(a) >= len(b) else (b, a)
        called = {k: winner if v == loser else v for k, v in called.items()} | {loser: winner, winner: winner}
        log.append((loser, winner, p))
    return log, called


@pytest.mark.parametrize("judged", [False, True])
@pytest.mark.parametrize("most", [7, 1000])
def test_merges_in_parallel_are_those_in_order(spark, judged, most):
    rng = random.Random(5)
    names = ["n" * rng.randrange(1, 4) + str(i) for i in range(60)]
    few = [(1, i, *rng.sample(names[:40], 2), rng.random()) for i in range(55)]
    hub = [(2, i, "hub", n, 0.5) if i % 2 else (2, i, n, "hub", 0.5) for i, n in enumerate(rng.sample(names, 30))]
    chain = [(3, 20 - i, names[i], names[i + 1], 0.25) for i in range(20)]
    tied = [(4, 0, "a", "b", 0.1), (4, 0, "a", "c", 0.2), (4, 0, "a", "c", 0.2), (4, 1, "b", "b", 0.3)]
    odd = [(None, 1, "a", "b", 0.1), (5, None, "a", "b", 0.1), (5, 1, None, "b", 0.1)]
    pairs = spark.createDataFrame(few + hub + chain + tied + odd, "g int, ord int, a string, b string, score double").repartition(4)
    score = lambda a, b: zlib.crc32(f"{a} {b}".encode()) % 1000 / 1000
    asked = []

    def judge(rows):
        asked.append(rows.count())
        return rows.withColumn("score", F.pmod(F.crc32(F.concat_ws(" ", "a", "b").cast("binary")), F.lit(1000)) / 1000)

    log, called = ingest.merged(pairs, "g", 0.4 if judged else None, judge if judged else None, most)
    got, on = log.collect(), called.collect()
    for g, of in ((1, few), (2, hub), (3, chain), (4, tied)):
        merges, names_on = _merges_in_order([x[1:] for x in of], 0.4 if judged else None, score)
        assert sorted((r.loser, r.winner, r.score) for r in got if r.g == g) == sorted(merges)
        assert {r.name: r.canonical for r in on if r.g == g} == names_on
    assert {r.g for r in on} <= {1, 2, 3, 4}
    assert not judged or len(asked) > 1  # new names were asked about


def test_merges_of_nothing(spark):
    none = spark.createDataFrame([], "g int, ord int, a string, b string")
    log, called = ingest.merged(none, "g")
    assert (log.columns, log.count(), called.columns, called.count()) == (["g", "loser", "winner", "score"], 0, ["g", "name", "canonical"], 0)


def test_names_merge_by_their_context(spark):
    rows = [("Ada Lovelace", "Ada Lovelaces", "Ada Lovelace wrote"), ("Ada", "Bob", "Bob met Ada"), ("Ada", "Bob", f"{'x' * 300} Ada"), ("Ada", "Ada", None)]
    df = spark.createDataFrame(rows, "a string, b string, c string")
    assert [r.p for r in df.select(ingest.should_merge(F.col("a"), F.col("b"), F.col("c")).alias("p")).collect()] == [0.25, 0.0, 0.0, 1.0]


def test_pruned_edges_are_listed_and_gone(spark):
    edges = spark.createDataFrame([("a", "b", "R"), ("a", "c", "S"), ("d", "e", "T")], "src string, tgt string, rel_type string").withColumn("props", F.lit(None).cast("map<string,string>"))
    store = GraphStore(spark.createDataFrame([("a",)], "name string"), edges)
    left, gone, stats = ingest.prune(store, F.lit("a r b"))
    assert {r.rel_type for r in left.edges.collect()} == {"R", "S"} and [(r.rel_type, r.score) for r in gone.collect()] == [("T", 0.0)]
    assert tuple(stats.first()) == (3, 1, 2)
    left, gone, stats = ingest.prune(store, F.lit("zzz"), limit=2)
    assert {r.rel_type for r in left.edges.collect()} == {"T"} and tuple(stats.first()) == (2, 2, 0)


def test_alignment_by_a_schema_of_ones_own(spark):
    schema = [("BOSS", "leads directs manages"), ("HOME", "lives resides located")]
    edges = spark.createDataFrame([("a", "b", "Lives_In", 7), ("", None, "odd", 8), ("x", "y", None, 9)], "src string, tgt string, rel_type string, n int")
    got = [tuple(r) for r in ingest.align_edges(edges, ontology=schema, fallback="ELSE").orderBy("n").collect()]
    assert got == [("a", "b", "HOME", 7), ("", None, "ELSE", 8), ("x", "y", "ELSE", 9)]
    assert [tuple(r)[:2] for r in ingest.align(spark.createDataFrame([("manages",)], "raw string"), ontology=schema).collect()] == [("manages", "BOSS")]


def _random_store(spark, seed):
    rng = random.Random(seed)
    names = [f"n{i}" for i in range(40)]
    pairs = {(rng.choice(names), rng.choice(names)) for _ in range(110)}
    edges = spark.createDataFrame([(a, b, "R") for a, b in pairs], "src string, tgt string, rel_type string")
    nodes = spark.createDataFrame([(n, float(i % 13) if i % 4 else None) for i, n in enumerate(names)], "name string, pagerank double")
    return names, sorted(pairs), GraphStore(nodes, edges)


def _word_share(context, instruction):
    tok = lambda x: {t for t in re.split(r"[^a-z0-9]+", x.lower()) if t}
    return len(tok(context) & tok(instruction)) / len(tok(instruction)) if tok(instruction) else 0.0


def test_a_search_asks_for_what_it_lacks_and_no_more():
    known = {"A": [("B", 0.9, 0.0), ("C", 0.1, 0.0)], "B": [("D", 0.5, 0.0)]}
    search = retrieve.BestFirst("A", 4, 5, retrieve.DEFAULT, judges=True)
    search.learn(known, {})
    assert search.run(9) == [(None, ["A", "B"]), ("D", ["A", "B", "D"]), ("C", ["A", "C"])] and search.out == []
    assert search.run(1) == [(None, ["A", "B"])]
    again = pickle.loads(pickle.dumps(search))
    again.learn({}, {("A", "B"): True})
    assert again.run(9) == [("C", ["A", "C"])] and [p for p, *_ in again.out] == [["A", "B"]] and "A" not in again.known
    search.max_paths = 1
    search.learn({}, {("A", "B"): True})
    assert search.run(9) == [] and search.out[0][0] == ["A", "B"]


def test_a_search_fetches_nothing_below_what_is_certain():
    """Paths that end at the depth bound come before C, so C's edges can't matter if they are as many as are wanted."""
    edges = {"A": [("B", 1.0, 9.0), ("Y", 0.99, 9.0), ("C", 0.0, 0.0)], "B": [("D", 0.9, 9.0), ("E", 0.9, 9.0)]}
    for most, wanted in ((2, ["Y"]), (3, ["Y", "C"])):
        search = retrieve.BestFirst("A", 2, most, retrieve.DEFAULT, judges=False)
        search.learn(edges, {})
        assert search.run(9) == [(n, None) for n in wanted]
    search.learn({"Y": [], "C": []}, {})
    assert search.run(9) == [] and [p[-1] for p, *_ in search.out] == ["Y", "D", "E"]


@pytest.mark.parametrize("early,scorer", [(None, "lexical"), (0.2, "own")])
def test_searches_are_the_sequential_ones(spark, early, scorer, monkeypatch):
    """In rounds with few nodes at a time, with the caller's scorer, and with seeds that have no edges."""
    monkeypatch.setattr(retrieve, "AHEAD", 4)
    names, pairs, store = _random_store(spark, 3)
    own = lambda c, i: F.least(F.lit(1.0), (F.length(i) % 7) / 5)
    column, value = (decision.lexical, _word_share) if scorer == "lexical" else (own, lambda c, i: min(1.0, len(i) % 7 / 5))
    question = "which n1 r n3 and n5 and n7 r n9"
    ranks = {n: float(i % 13) if i % 4 else 0.0 for i, n in enumerate(names)}
    score = lambda s: s * s + 0.5 * (2 * s * (1 - s))
    edges = {}
    for a, b in pairs:
        edges.setdefault(a, []).append((b, round(score(value(question, f"{a} R {b}")), 6), ranks[b]))
    stop = (lambda way: value(question, " → ".join(way)) ** 2 > early) if early is not None else (lambda way: False)
    seeds = [*names[:12], "lone"]
    starts = spark.createDataFrame([(i, question, s) for i, s in enumerate(seeds)] + [(99, question, None)], "query_id long, question string, seed string")
    expected = {(i, k, tuple(p), round(f, 6), n, e) for i, s in enumerate(seeds) for k, (p, f, n, e) in enumerate(retrieve.best_first(edges, s, 3, 4, stop))}
    got = {(r.query_id, r.path_ord, tuple(r.path), r.score, r.depth, r.early_terminated) for r in retrieve.traverse(store, starts, 3, 4, early, scorer=column).collect()}
    assert got == expected and any(e[5] for e in expected) == (early is not None) and (12, 0, ("lone",), 1.0, 0, False) in got
    if early is None:
        walks = {r.query_id: r.path for r in retrieve.walk_greedily(store, starts, "n30", 3, column).collect()}
        assert walks == {i: retrieve.greedy(edges, s, "n30", 3) for i, s in enumerate(seeds)} and walks[12] == []
        both = retrieve.expansions(store, starts, "n30", 3, scorer=column).collect()
        assert {r.query_id for r in both} == set(range(13)) and all(r.greedy >= 0 for r in both)


def test_search_plans_do_not_grow_with_depth(spark):
    _, _, store = _random_store(spark, 4)
    starts = spark.createDataFrame([(1, "n1 n2", "n1")], "query_id long, question string, seed string")
    plan = retrieve.traverse(store, starts, 5)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan  # what a search returns is read from written tables


def test_beam_takes_a_scorer(spark):
    _, _, store = _random_store(spark, 5)
    starts = spark.createDataFrame([(1, "q", "n1"), (2, "q", "n2")], "query_id long, question string, seed string")
    flat = retrieve.beam(store, starts, 2, 2, scorer=lambda c, i: F.lit(1.0)).collect()
    assert flat and all(r.f >= round(0.65 - 0.1 * r.depth, 6) for r in flat)


def test_walks_and_steps(spark):
    _, pairs, store = _random_store(spark, 6)
    out = {}
    for a, b in pairs:
        out.setdefault(a, []).append(b)
    expected, now = set(), {n: len(v) for n, v in out.items()}
    for hop in range(1, 5):
        expected |= {(hop, n, k) for n, k in now.items()}
        now = {n: s for n, v in out.items() if (s := sum(now.get(t, 0) for t in v))}
    assert {tuple(r) for r in algorithms.walks(store.edges, 4).collect()} == expected
    got = {(r.hop, r.src): r.node for r in measure.follow(store, store.nodes.select(F.col("name").alias("src")), 3).collect()}
    for a in out:
        assert got[1, a] == min(out[a]) and got.get((2, a)) == (min(out[min(out[a])]) if min(out[a]) in out else None)
    times = measure.hop_latency(store, store.nodes.select(F.col("name").alias("src")), 2, 1)
    assert [r.hop for r in times.orderBy("hop").collect()] == [1, 2] and measure.speedup(times, times).count() == 2
    with measure.MemoryWatch(spark, 1e9, 0.05) as w:
        store.nodes.count()
    assert w.peak_mb >= w.mean_mb >= 0 and not w.breached


def test_ranks_say_whether_they_settled(spark):
    ring = spark.createDataFrame([(f"n{i}", f"n{(i + 1) % 5}") for i in range(5)], "src string, tgt string")
    assert algorithms.ranked_until(ring)[1]
    star = spark.createDataFrame([("a", f"n{i}") for i in range(5)] + [("n0", "a")], "src string, tgt string")
    assert not algorithms.ranked_until(star, iterations=2)[1]


@pytest.mark.parametrize("n", range(1, 12))
def test_rerank_keeps_the_floor(spark, n):
    nodes = spark.createDataFrame([(0, i, f"w{i}", f"w{i}") for i in range(n)], "query_id int, ord int, name string, text string")
    assert post.rerank(nodes, F.lit("w1 w2")).count() == max(1, int(n * 0.8 + 1e-9))


def test_stream_matches_batch(spark, tmp_path):
    from loomgraph.streaming.watch import verified_stream

    edges = spark.createDataFrame([("a", "b", "R"), ("c", "d", "S")], "src string, tgt string, rel_type string")
    edges.write.parquet(str(tmp_path / "in"))
    q = verified_stream(spark, str(tmp_path / "in"), "src string, tgt string, rel_type string", "a r b").writeStream.format("memory").queryName("seen").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(map(tuple, spark.table("seen").collect())) == sorted(map(tuple, ingest.verify(edges, F.lit("a r b")).collect()))


def _text(v):
    return f"{v:.5f}" if isinstance(v, float) else str(float(v)) if hasattr(v, "as_tuple") else str(v)


CHECKED = """wcc_kept word_neighbours neighbors_out node_upsert edge_upsert_guarded graph_changes store_roundtrip vector_topk_lists edge_delete vector_topk khop_counts khop_paths hop_walk chunks_fold ner_regex entity_merge_cc edge_prune align_edges
choice_argmax ask_batch score_detailed softmax_scores cloud_batch cloud_decode bestfirst_tree beam_level early_exit answer_local format_bullets citations conflict_log ablation_log_stats ablation_primary ab_prompts ner_parse""".split()


@pytest.mark.parametrize("name", CHECKED)
def test_query_matches_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    df = QUERIES[name](spark, sf_dir)
    cols = sorted(df.columns)
    cur = con.execute(SQL[name])
    at = [[x[0] for x in cur.description].index(c) for c in cols]
    assert sorted([_text(v) for v in r] for r in df.select(*cols).collect()) == sorted([_text(r[i]) for i in at] for r in cur.fetchall())


def test_entry_runs(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
