"""What must not grow faster than the input: rows that are judged once, tasks, and what is shuffled."""

import numpy as np
from pyspark.sql import functions as F

from loomgraph.functions import decision as d
from loomgraph.operators import post, retrieve
from loomgraph.plans.queries import QUERIES
from loomgraph.sources.store import GraphStore


def _counted(spark):
    """A scorer that counts the texts it takes apart and the pairs it compares."""
    seen = {"texts": spark.sparkContext.accumulator(0), "pairs": spark.sparkContext.accumulator(0)}

    def prepare(text):
        n = seen["texts"]
        return F.udf(lambda t: (n.add(1), sorted(set(t.split())))[1], "array<string>")(text)

    def compare(a, b):
        n = seen["pairs"]
        return F.udf(lambda x, y: (n.add(1), len(set(x) & set(y)) / len(y) if y else 0.0)[1], "double")(a, b)

    def scorer(a, b):
        return compare(prepare(a), prepare(b))

    scorer.prepare, scorer.compare = prepare, compare
    return scorer, seen


def _star(spark, n=40):
    nodes = spark.createDataFrame([(f"n{i}", "t", None, float(i), None) for i in range(n)], "name string, label string, props map<string,string>, pagerank double, community_id long")
    return GraphStore(nodes, spark.createDataFrame([("n0", f"n{i}", "R", None) for i in range(1, n)], "src string, tgt string, rel_type string, props map<string,string>"))


def test_a_gate_on_scores_judges_each_edge_once(spark):
    """the filter was moved below the score, which was worked out anew there for each use; each edge took its question
    apart."""
    store, (scorer, seen) = _star(spark), _counted(spark)
    front = spark.createDataFrame([(1, "n0 R n3", "n0")], "query_id long, question string, src string")
    for most in (False, True):
        before = {k: v.value for k, v in seen.items()}
        rows = retrieve.bfs(store, front, 0.5, scorer, most=most).collect()
        assert [r.edge_ord for r in rows] == list(range(1, len(rows) + 1)) and rows[0].tgt == "n3" and all(r.score >= 0.5 for r in rows)
        assert seen["pairs"].value - before["pairs"] == 39 and seen["texts"].value - before["texts"] == 40


def test_edges_of_most_nodes_are_those_of_some(spark):
    store = _star(spark)
    more = GraphStore(store.nodes, store.edges.unionByName(spark.createDataFrame([("n1", "nowhere", "R", None), (None, "n1", "R", None), ("n2", "n0", "R", None)], store.edges.schema)))
    front = spark.createDataFrame([(1, "n0"), (2, "n0"), (3, "n2"), (4, "none"), (5, None), (6, "n1")], "query_id long, src string")
    key = lambda df: sorted(map(str, df.collect()))
    assert key(more.edges_of_most(front)) == key(more.edges_of(front)) and more.edges_of_most(front).count() == 79


def test_what_is_dealt_by_question_grows_in_tasks(spark, sf_dir, monkeypatch):
    """F18, F21 to F25: a task's share of a question's edges does not grow with the graph; nothing is laid out for it."""
    from loomgraph.plans import queries
    from loomgraph.sources import store as stores

    monkeypatch.setattr(queries, "graph_by_source", None)
    monkeypatch.setattr(stores, "NAMED", 500)
    n = queries.business_graph(spark, sf_dir).edges.count()
    for name in ("paths_to_nodes", "edges_to_nodes", "bfs_gated"):
        plan = QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
        assert f"hashpartitioning(query_id#" in plan and f", {-(-n // 500)})" in plan


def test_edges_meet_ranks_in_tasks_that_grow_in_number(spark, monkeypatch):
    """F18, F21 to F25: what sorts the edges by target was as many tasks for any graph."""
    from loomgraph.sources import store as stores

    store = _star(spark)
    monkeypatch.setattr(stores, "NAMED", 2)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = store.edges_of_most(spark.createDataFrame([(1, "n0")], "query_id long, src string"))
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning(tgt") == 2 and plan.count(", 20)") == plan.count("Exchange hashpartitioning(") == 4
        assert found.count() == 39
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_contexts_of_dense_ranks(spark):
    """ten lines in order, whether or not they are ranked anew; a null line is left out."""
    rows = [(1, i, f"n{i}", f"t{i}" if i != 4 else None, 0.5) for i in range(1, 14)] + [(2, 1, "a", "b", 0.1)]
    nodes = spark.createDataFrame(rows, "query_id long, rank int, name string, text string, score double")
    want = {1: " | ".join(f"n{i}: t{i}" for i in range(1, 11) if i != 4), 2: "a: b"}
    for dense in (False, True):
        found = post.context(nodes, dense=dense)
        assert {r.query_id: r.context for r in found.collect()} == want
        assert "ObjectHashAggregate" not in found._jdf.queryExecution().executedPlan().toString()


def test_nodes_of_names_of_one_node_are_not_joined(spark):
    """without two nodes of one name there is nothing to settle."""
    asked = spark.createDataFrame([(1, "a b")], "query_id long, question string")
    one = spark.createDataFrame([(1, 2, "x", "a", 0.5), (1, 5, "y", "b", 0.4)], "query_id long, rank int, name string, text string, score double")
    found = post.settled(one, asked)
    assert [(r["rank"], r.name) for r in found.orderBy("rank").collect()] == [(1, "x"), (2, "y")]
    assert "Join" not in found._jdf.queryExecution().executedPlan().toString()
    two = one.unionByName(spark.createDataFrame([(1, 7, "x", "a b", 0.3)], one.schema))
    assert [(r.name, r.text) for r in post.settled(two, asked).orderBy("rank").collect()] == [("y", "b"), ("x", "a")]


def test_a_prepared_question_scores_alike(spark):
    nodes = spark.createDataFrame([(1, i, f"n {i}", f"n {i}", "which n 3") for i in range(5)], "query_id long, ord int, name string, text string, question string")
    plain = post.rerank(nodes, F.col("question"))
    ready = post.rerank(nodes.withColumn("asked", d.lexical.prepare(F.col("question"))), F.col("asked"), ready=True)
    assert sorted(plain.collect()) == sorted(ready.collect())


def test_core_numbers_send_what_fell(spark, monkeypatch):
    """after the first round only nodes whose number fell tell their neighbours, and what is kept of a node is a row
    for each number below its own."""
    from loomgraph.operators import algorithms
    from loomgraph.sources.adjacency import Links

    chain = [(f"c{i}", f"c{i + 1}") for i in range(20)]
    clique = [(f"k{i}", f"k{j}") for i in range(6) for j in range(i)]
    odd = [("c20", "c0x"), ("k0", "c20"), ("z", "z"), ("lone", None), (None, "c3"), ("k1", "k0"), ("k0", "k1")]
    edges = spark.createDataFrame([*chain, *clique, *odd], "src string, tgt string")
    told, sent = [], Links.sent
    monkeypatch.setattr(Links, "sent", lambda self, values, *what: (told.append(values.count()), sent(self, values, *what))[1])
    found = {r.name: r.core for r in algorithms.k_core(edges).collect()}
    assert found == {f"c{i}": 1 for i in range(21)} | {"c0x": 1, "z": 0, "lone": 0} | {f"k{i}": 5 for i in range(6)}
    assert len(told) > 8 and told[0] == 28 and sum(told[1:]) < 28
    build = Links.build
    monkeypatch.setattr(Links, "build", lambda e, both=False: build(e, both, buckets=9, least=3))  # with hubs
    assert {r.name: r.core for r in algorithms.k_core(edges).collect()} == found


def test_greedy_walks_from_every_order(spark, sf_dir):
    """only every hundredth order was a seed."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderkey").cast("long")).distinct()
    found = QUERIES["greedy"](spark, sf_dir)
    assert sorted(r.query_id for r in found.collect()) == sorted(r[0] for r in orders.collect())


def test_searches_in_pages_are_the_sequential_ones():
    """a search that is sent the best edges first, in pages, many edges of equal worth, does what one does that
    knows all edges; it asks for few of a large node's."""
    import random

    pick, page, asked = random.Random(3), 2, 0

    def through(search, edges, value, ahead):
        nonlocal asked
        search.ask(start, 0)
        while True:
            for node, (depth, at) in search.asked.items():
                best = sorted(((*e, (e[0], "R")) for e in edges.get(node, [])), key=lambda e: (-value(e, depth + 1), e[3]))
                asked += 1
                search.learn_page(node, best[at : at + max(page, at)], len(best) > at + max(page, at))
            search.learn({}, {tuple(way): stop(way) for _, way in wants if way is not None})
            wants[:] = search.run(ahead)
            if not wants:
                return search
            begun = type(search).__new__(type(search))
            begun.__dict__.update(search.__dict__)
            begun.restore(search.state())
            search = begun

    c, wants = retrieve.DEFAULT, []
    for trial in range(300):
        n = pick.choice([5, 12, 40])
        edges = {f"n{i:02d}": [(t, pick.choice([0.0, 0.2, 0.5, 0.9]), pick.choice([None, 0.0, 3.0, 12.0])) for t in sorted({f"n{pick.randrange(n):02d}" for _ in range(pick.choice([0, 1, 4, 30]))})] for i in range(n)}
        stop = lambda way: trial % 2 == 1 and sum(map(ord, way[-1])) % 5 == 0  # noqa: E731, B023
        start, depth, paths, ahead = "n00", pick.randint(1, 5), pick.choice([1, 3, 50]), pick.choice([1, 3, 8])
        wants.clear()
        search = retrieve.BestFirst(start, depth, paths, c, judges=trial % 2 == 1)
        f = lambda e, d: c.alpha * e[1] + c.beta * min((e[2] or 0.0) / c.max_pagerank, 1.0) - c.gamma * d
        assert through(search, edges, f, ahead).out == retrieve.best_first(edges, start, depth, paths, stop)
        wants.clear()
        walk = through(retrieve.Greedy(start, "n04", depth), edges, lambda e, d: e[1], ahead)
        assert walk.way == retrieve.greedy(edges, start, "n04", depth)
    many, asked, page, stop, start = {"n00": [(f"x{i:05d}", 0.5, 1.0) for i in range(5000)]}, 0, 8, lambda way: False, "n00"
    wants.clear()
    assert len(through(retrieve.BestFirst(start, 1, 3, c, judges=False), many, f, 8).out) == 3 and asked == 1


def test_all_paths_of_two_steps_are_joins(spark):
    """every path went through a search's state in Python.  Circles, loops, parallel edges and dead ends; the same paths
    as of a sequential search."""
    pairs = sorted({(f"n{i}", f"n{(i * i + 5 * j) % 14}", r) for i in range(12) for j in range(1, 5) for r in ("n4", "R")[: 1 + i % 2]} | {("n3", "n3", "R"), ("n13", "n13", "R")})
    rank = {f"n{i}": float(i % 3) for i in range(14)} | {"lone": 0.0}
    store = GraphStore(spark.createDataFrame(list(rank.items()), "name string, pagerank double"), spark.createDataFrame(pairs, "src string, tgt string, rel_type string"))
    question, edges = "n1 n4 r n9", {}
    for a, b, r in pairs:
        o = len({"n1", "n4", "r", "n9"} & (own := {a, b, r.lower()})) / len(own)
        edges.setdefault(a, []).append((b, round(o * o + 0.5 * (2 * o * (1 - o)), 6), rank[b]))
    starts = spark.createDataFrame([(i, question, s) for i, s in enumerate(rank)] + [(99, question, None)], "query_id long, question string, seed string")
    found = retrieve.two_steps(store, starts)
    assert "MapInArrow" not in found._jdf.queryExecution().executedPlan().toString()
    want = [(i, s, tuple(p), round(f, 6), n) for i, s in enumerate(rank) for p, f, n, _ in retrieve.best_first(edges, s, 2, 10**9)]
    assert sorted((r.query_id, r.seed, tuple(r.path), r.score, r.depth) for r in found.collect()) == sorted(want) and {w[4] for w in want} == {0, 1, 2}


def test_names_get_their_vectors_in_many_tasks(spark):
    """all names of one kind lay in one file, so one task made their vectors."""
    from loomgraph.operators import engine

    store = GraphStore(_star(spark).nodes.coalesce(1), _star(spark).edges)
    assert engine.name_vectors(store).rdd.getNumPartitions() == store.tasks() > 1


def test_few_scores_are_sorted(monkeypatch):
    """F1: every score of a block was rounded and sorted.  Ties go to the smaller id, within 6 digits, as before."""
    from loomgraph.sources import vectors

    rng, seen, real = np.random.default_rng(7), [], vectors.best_of
    s, i = np.full((6, 4), -np.inf), np.zeros((6, 4), np.int64)
    held_s, held_i = s, i
    monkeypatch.setattr(vectors, "best_of", lambda *a: (seen.append(1), real(*a))[1])
    for _ in range(40):
        new, ids = rng.integers(-9, 9, (6, 50)) / 9 + rng.uniform(-9e-7, 9e-7, (6, 50)), rng.permutation(10**6)[:50]
        s, i = vectors.merged_best(s, i, new, ids, 4)
        held_s, held_i = real(np.hstack([held_s, np.round(new, 6)]), np.hstack([held_i, np.broadcast_to(ids, new.shape)]), 4)
        assert (s == held_s).all() and (i == held_i).all()
    assert len(seen) == 1


def test_counts_of_pairs_go_before_the_weights_are_laid_out(spark, monkeypatch):
    """the counts and the weights both ways were kept beside the weights in buckets."""
    from loomgraph.operators import learnt

    kept, laid, real = {}, [], {n: getattr(learnt, n) for n in ("written", "forget", "bucketed")}

    def written(df):
        out = real["written"](df)
        kept[out.written_to] = out
        return out

    def forget(*tables):
        for t in tables:
            del kept[t.written_to]
        real["forget"](*tables)

    def bucketed(rows, *rest):
        laid.append([(t.columns, t.count()) for t in kept.values()])
        return real["bucketed"](rows, *rest)

    for f in (written, forget, bucketed):
        monkeypatch.setattr(learnt, f.__name__, f)
    texts = spark.createDataFrame([(" ".join(f"w{(i * j) % 7}" for j in range(1, 9)),) for i in range(1, 30)], "text string")
    pairs, _ = learnt.weights(texts)
    one = pairs.count()
    kept.clear()
    assert learnt.word_vectors(texts).count() == 7 and len(laid) == 2
    assert all([n for columns, n in tables if "w" in columns] == [one] and not any("n" in c and "b" in c for c, _ in tables) for tables in laid)
