"""What the graph queries spend on tables that grow: shuffles, rounds and layouts."""

from collections import Counter

from pyspark.sql import functions as F

from loomgraph.operators import learnt


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_pairs_of_words_travel_as_numbers(spark, monkeypatch):
    """Counted in pieces of a few tokens, under a first hash that collides; words come back only at the end."""
    monkeypatch.setattr(learnt, "TOKENS", 7)
    texts = ["a b a a c", None, "", "d", "b c d e f g a b", "a a a", "c c d d e"] * 3
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id long, text string").repartition(3)
    number = lambda word, salt: F.when(salt == 0, F.lit(7).cast("long")).otherwise(F.xxhash64(word, salt))
    pairs, words = learnt.weights(docs, 2, 1, number)
    assert dict(pairs.dtypes)["a"] == dict(pairs.dtypes)["b"] == "bigint"
    name = {r.id: r.word for r in words.collect()}
    n = Counter()
    for t in texts:
        w = (t or "").split()
        n.update(tuple(sorted((w[i], w[j]))) for i in range(len(w)) for j in range(i + 1, min(i + 3, len(w))))
    of = Counter()
    for (a, b), k in n.items():
        of.update({a: k} if a == b else {a: k, b: k})
    wanted = {p for p, k in n.items() if k * sum(of.values()) > of[p[0]] * of[p[1]]}
    assert {tuple(sorted((name[r.a], name[r.b]))) for r in pairs.collect()} == wanted and len(wanted) > 5
    assert {(r.a, r.b) for r in learnt.neighbours(docs, 2, 1).collect()} == wanted | {(b, a) for a, b in wanted}


def test_edges_are_brought_to_the_ontology_where_they_stand(spark):
    from loomgraph.operators import ingest

    edges = spark.range(20, numPartitions=2).select(F.concat(F.lit("a"), "id").alias("src"), F.lit("b").alias("tgt"), F.lit("located_in").alias("rel_type"), F.col("id").alias("n"))
    found = ingest.align_edges(edges)
    assert "Exchange" not in plan(found)
    assert {r.rel_type for r in found.collect()} == {"LOCATED_IN"} and found.count() == 20


def test_only_fetches_lay_the_graph_out(spark, sf_dir):
    """The edges by source are made for queries that fetch; buckets grow with the edges."""
    from loomgraph.sources import adjacency, business_graph

    assert business_graph.business_graph(spark, sf_dir).adjacency is None
    store = business_graph.graph_by_source(spark, sf_dir)
    assert store.adjacency is not None and store is business_graph.graph_by_source(spark, sf_dir)
    known = store.edges.select("src", "tgt")
    n = known.count()
    assert adjacency._dealt(known, "src", None, 4096, 100)[0] == -(-n // 100) and adjacency._dealt(known, "src", None, 4096, n)[0] == 3


def test_pagerank_of_nx_ends_with_the_longest_path(spark, monkeypatch):
    from loomgraph.operators import algorithms

    def dense(pairs, steps=20):
        names = sorted({x for p in pairs for x in p})
        r = {x: 1 / len(names) for x in names}
        out = {x: [b for a, b in pairs if a == x] for x in names}
        for _ in range(steps):
            r, was = {x: 0.15 / len(names) + 0.85 * sum(r[y] for y in names if not out[y]) / len(names) for x in names}, r
            for a in names:
                for b in out[a]:
                    r[b] += 0.85 * was[a] / len(out[a])
        return r

    steps, real = [], algorithms.written
    monkeypatch.setattr(algorithms, "written", lambda *a: steps.append(1) or real(*a))
    for pairs in ([("a", "b"), ("b", "c"), ("a", "c"), ("d", "c")], [("a", "b"), ("b", "a"), ("b", "c"), ("d", "a")]):
        steps.clear()
        found = {r.name: r.pagerank for r in algorithms.pagerank(spark.createDataFrame(pairs, "src string, tgt string")).collect()}
        assert all(abs(found[x] - v) < 1e-12 for x, v in dense(pairs).items()) and len(found) == 4
        assert len(steps) < 9 or ("b", "a") in pairs


def test_searches_pass_by_in_sorted_rows(spark, monkeypatch):
    """Many searches of a task, handed on in pieces of two rows; two seeds of one question that share their nodes."""
    from loomgraph.operators import retrieve
    from loomgraph.sources.store import GraphStore

    monkeypatch.setattr(retrieve, "_HELD", (1, 1))
    edges = spark.createDataFrame([(f"n{i}", f"n{j}", "TO") for i in range(6) for j in range(i + 1, 7)], "src string, tgt string, rel_type string")
    nodes = spark.createDataFrame([(f"n{i}", float(i)) for i in range(7)], "name string, pagerank double")
    store = GraphStore(nodes, edges)
    starts = spark.createDataFrame([(q, f"to n{q}", f"n{s}") for q in range(4) for s in (0, 1, 6)], "query_id long, question string, seed string")
    found = {}
    for r in retrieve.traverse(store, starts, 3, 4, None).orderBy("path_ord").collect():
        found.setdefault((r.query_id, r.seed), []).append(r.path)
    for (q, seed), paths in found.items():
        of = {}
        for r in retrieve.scored_edges(store, spark.createDataFrame([(q, f"to n{q}", f"n{i}") for i in range(7)], "query_id long, question string, src string")).orderBy("src", "tgt").collect():
            of.setdefault(r.src, []).append((r.tgt, r.score, r.pagerank))
        assert paths == [p for p, *_ in retrieve.best_first(of, seed, 3, 4)]
    assert len(found) == 12 and found[0, "n6"] == [["n6"]]
    plans = []
    real = retrieve.written
    monkeypatch.setattr(retrieve, "written", lambda df: plans.append(plan(df)) or real(df))
    retrieve.traverse(store, starts.limit(3), 2, 4, None).collect()
    assert any("MapInArrow" in p for p in plans) and not any("FlatMapGroupsInPandas" in p for p in plans)


def test_components_send_edges_once_a_level(spark, monkeypatch):
    """Chains, a circle, a star that points outward, loops and null ends, under a first hash that collides: a level sends
    the edges, not every step of a chain, and nothing is laid out both ways."""
    from loomgraph.operators import algorithms

    pairs = [("h", f"l{i}") for i in range(9)] + [(f"p{i:02d}", f"p{i + 1:02d}") for i in range(20)] + [("a", "b"), ("b", "c"), ("c", "a"), ("u", "v"), ("v", "u"), ("x", "x"), (None, "y"), ("z", None), ("l3", "l4")]
    on = {x: x for p in pairs for x in p if x}
    for _ in on:
        for a, b in pairs:
            if a and b:
                on[a] = on[b] = min(on[a], on[b])
    edges = spark.createDataFrame(pairs, "src string, tgt string")
    levels, real = [], algorithms._led
    monkeypatch.setattr(algorithms, "_led", lambda first: levels.append(1) or real(first))
    monkeypatch.setattr(algorithms, "Links", None)
    number = lambda name, salt: F.when(salt == 0, F.pmod(F.xxhash64(name), F.lit(20))).otherwise(F.xxhash64(name, salt))
    assert {r.name: r.community for r in algorithms.components(edges, 0, number).collect()} == on and len(levels) <= 4
    assert {r.name: r.community for r in algorithms.components(edges).collect()} == on


def test_a_removal_from_most_of_the_graph_joins_no_edges_to_its_members(spark, tmp_path, monkeypatch):
    from loomgraph.operators import upkeep
    from loomgraph.sources.changes import ChangeStore
    from loomgraph.sources.store import GraphStore

    pairs = [(f"n{i}", f"n{i + 1}", "R") for i in range(8)] + [("x", "y", "R")]
    nodes = spark.createDataFrame([(n,) for n in sorted({x for p in pairs for x in p[:2]})], "name string").selectExpr("name", "'E' label", "cast(null as map<string,string>) props", "cast(null as double) pagerank", "cast(null as long) community_id")
    graph = GraphStore(nodes, spark.createDataFrame(pairs, "src string, tgt string, rel_type string").selectExpr("*", "cast(null as map<string,string>) props"))
    store, gone = ChangeStore.create(spark, f"{tmp_path}/graph", graph, buckets=2), spark.createDataFrame(pairs[3:4], "src string, tgt string, rel_type string")
    now = upkeep.Components.build(graph, f"{tmp_path}/labels", buckets=2)
    monkeypatch.setattr(ChangeStore, "edges_from", None)
    found = {r.name: r.community for r in now.removed(gone, store.delete_edges(gone)).all().collect()}
    assert found == {f"n{i}": "n0" if i < 4 else "n4" for i in range(9)} | {"x": "x", "y": "x"}
