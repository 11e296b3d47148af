import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomgraph import __main__
from loomgraph.config import EngineConfig
from loomgraph.functions import decision, generate
from loomgraph.functions.embedding import hashed, vector
from loomgraph.operators import algorithms, engine, ingest, post
from loomgraph.plans.queries import QUERIES
from loomgraph.sources.vectors import VectorIndex, recall, vector_top_k

rng = np.random.default_rng(8)
V = rng.normal(size=(60, 6))
V[10] = V[20] = V[30]
ROWS = [(i, v.tolist(), "hot" if i % 4 else "cold") for i, v in enumerate(V)]
KIND = "vec_id long, embedding array<double>, label string"


def _cos(a, b):
    return round(float(a @ b / (np.sqrt(a @ a) * np.sqrt(b @ b) + 1e-9)), 6)


def test_top_k_in_blocks(spark):
    odd = [(None, [1.0] * 6, "x"), (99, None, "x"), (97, [float("nan")] * 6, "x"), (96, [1.0, None, 1.0, 1.0, 1.0, 1.0], "x"), (95, [float("inf")] * 6, "x"), (94, [], "x"), (93, [1.0] * 5, "x")]
    vectors = spark.createDataFrame([*ROWS, *odd], KIND).repartition(3)
    queries = vectors.where("vec_id % 10 = 0 or vec_id in (97, 94)").select(F.col("vec_id").alias("query"), "embedding")
    expected = []
    for q in range(0, 60, 10):
        best = sorted(((-_cos(V[q], V[i]), i) for i in range(60)))[:4]
        expected += [(q, i, -s, n) for n, (s, i) in enumerate(best, 1)]
    for size, asked in ((4096, 1024), (7, 2), (3, 4)):
        assert sorted(map(tuple, vector_top_k(vectors, queries, 4, size, asked).collect())) == sorted(expected, key=lambda r: (r[0], r[1], r[2]))
    assert vector_top_k(vectors, queries.limit(0), 4).count() == 0
    assert vector_top_k(vectors.limit(0), queries, 4).count() == 0


def test_cosine_pairs_in_slices(spark):
    vectors = spark.createDataFrame([*ROWS, (None, [1.0] * 6, "hot"), (99, None, "hot"), (98, [float("nan")] * 6, "hot"), (97, [1.0] * 4, "hot")], KIND)
    expected = {(i, j) for i in range(60) for j in range(i + 1, 60) if ROWS[i][2] == ROWS[j][2] and _cos(V[i], V[j]) > 0.3}
    for size in (1024, 7):
        got = ingest.cosine_pairs(vectors, "label", 0.3, slice_=size).collect()
        assert len(got) == len(expected) and {(r.a, r.b) for r in got} == expected
    assert ingest.cosine_pairs(vectors.limit(0), "label", 0.3).count() == 0


def test_hashed_vectors(spark):
    texts = [None, "", "ab", "Nation 7", "nation 7"]
    got = [r.v for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").orderBy("i").select(hashed(F.col("t")).alias("v")).collect()]
    assert got[0] is None and got == [vector(t) for t in texts] and got[3] == got[4]
    assert abs(sum(x * x for x in got[3]) - 1) < 1e-9


def test_communities_find_planted_groups(spark):
    random.seed(3)
    pairs = [(f"c{g}_{i}", f"c{g}_{j}") for g in range(3) for i in range(5) for j in range(i)]
    pairs += [(f"c{g}_0", f"c{(g + 1) % 3}_1") for g in range(3)] + [("solo", "solo"), ("c0_1", "c0_0")]
    got = {r.name: r.community for r in algorithms.communities(spark.createDataFrame(pairs, "src string, tgt string"), turns=6, levels=2).collect()}
    assert got == {n: "solo" if n == "solo" else f"{n[:2]}_0" for p in pairs for n in p}
    loops = spark.createDataFrame([("a", "a")], "src string, tgt string")
    assert [tuple(r) for r in algorithms.communities(loops).collect()] == [("a", "a")]


def test_a_step_of_communities_sends_each_edge_once(spark, monkeypatch):
    plans, found, written = [], [], algorithms.written
    monkeypatch.setattr(algorithms, "written", lambda df: plans.append((df.columns, df._jdf.queryExecution().optimizedPlan().toString())) or written(df))
    for hub in (4096, 3):  # with hubs apart, the same groups
        monkeypatch.setattr(algorithms, "HUB", hub)
        plans.clear()
        pairs = [(f"{g}{i}", f"{g}{j}") for g in "ab" for i in range(4) for j in range(i)] + [("a0", "b0"), ("a0", "b1"), ("a0", "x"), ("a0", "y")]
        found.append(sorted(map(tuple, algorithms.communities(spark.createDataFrame(pairs, "src string, tgt string"), turns=2, levels=1).collect())))
        # Edges stay in their buckets, and what they send is dealt once; the modularity takes no pass of its own.
        steps = [p for c, p in plans if c == ["a", "c", "k", "loop", "name"]][1:]
        assert len(steps) == 3 and all(p.count("RepartitionByExpression") == 1 for p in steps)
    assert found[0] == found[1] and len(found[0]) == 10


def test_documents_to_answers(spark, tmp_path):
    docs = spark.createDataFrame([(1, "Ada Lovelace met Charles Babbage in London Town. Charles Babbage built engines. Ada Lovelace wrote notes."), (2, "Charles Babbage knew Ada Lovelace well."), (3, None), (4, "")], "doc_id long, text string")
    store = engine.build(docs, config=EngineConfig(iterations=3))
    assert {r.name for r in store.nodes.collect()} == {"Ada Lovelace", "Charles Babbage", "London Town"}
    assert {(r.src, r.tgt) for r in store.edges.collect()} == {("Ada Lovelace", "Charles Babbage"), ("Charles Babbage", "Ada Lovelace"), ("Charles Babbage", "London Town")}
    asked = spark.createDataFrame([(1, "Ada Lovelace related to Charles Babbage"), (2, "how things connect from Ada Lovelace to London Town"), (3, "zzz"), (4, None)], "query_id long, text string")
    got = {r.query_id: (r.route, r.answer) for r in engine.answer(store, asked, config=EngineConfig(gate=0.1)).collect()}
    assert got[1][0] == "local" and "Ada Lovelace" in got[1][1] and "Charles Babbage" in got[1][1]
    assert got[2][0] == "multi_hop" and "London Town" in got[2][1]
    assert got[3][1] == engine.ABSTAIN and got[4][1] == engine.NO_SEED
    store.save(f"{tmp_path}/graph")
    assert __main__.ask(spark, f"{tmp_path}/graph", "zzz", 2) == engine.ABSTAIN
    made_up = engine.answer(store, asked.where("query_id = 1"), lambda question, context: F.lit("something else"), EngineConfig(gate=0.1)).first().answer
    assert made_up == engine.UNVERIFIED + "something else"


def test_answers_of_the_business_graph(spark, sf_dir):
    out = QUERIES["answer_routed"](spark, sf_dir).collect()
    assert len(out) == spark.read.parquet(f"{sf_dir}/supplier.parquet").count()
    assert {r.route for r in out} == {"local", "multi_hop", "global"} and any(r.answer != engine.ABSTAIN for r in out)


def test_scorers_and_questions(spark):
    from pyspark.errors import PySparkException

    one = spark.createDataFrame([(1, "a b", "b c")], "id long, context string, instruction string")
    p = decision.probabilities(decision.lexical(F.col("context"), F.col("instruction")))
    ask = lambda kind: one.select(decision.ask(F.lit(kind), p, F.lit("x")).alias("r")).first().r
    assert ask("score").answer == 0.5 and ask("noul").answer == 0.25 and ask("choice").selected == "x"
    with pytest.raises(PySparkException):
        ask("essay")
    with pytest.raises(ValueError):
        decision.scorer_named("no such")
    with pytest.raises(ValueError):
        decision.choose(one, "id", spark.createDataFrame([], "option string, ord int, description string"), F.col("context"), F.col("instruction"))
    decision.register("flat", lambda c, i: F.lit(0.5))
    full = one.select(decision.decide(F.col("context"), F.col("instruction"), "flat").alias("r")).first().r
    assert (full.score, full.confidence, full.backend, full.primitive, full.selected) == (0.5, 0.5, "flat", "score", None) and full.raw_probs["critical"] == 0.25


@pytest.mark.parametrize("logits,low,high", [([0, 0, 10], 0.9, 1), ([10, 0, 0], 0, 0.1), ([0, 10, 0], 0.4, 0.6), ([1000, 0, 0], 0, 1e-9)])
def test_logits(spark, logits, low, high):
    labels = ["irrelevant", "tangential", "critical"]
    r = spark.range(1).select(decision.labelled(F.array(*[F.lit(float(x)) for x in logits]), labels).alias("p")).select("p", decision.label_score(F.col("p")).alias("s"), decision.label_noul(F.col("p")).alias("n")).first()
    assert low <= r.s <= high and abs(sum(r.p.values()) - 1) < 1e-12 and r.n == r.p["critical"]


def test_remote_service(spark):
    with pytest.raises(ValueError):
        decision.Cloud(" ", lambda key, asked: [])

    def transport(key, requests):
        if requests[0]["state"] == "down":
            raise OSError("no route")
        return ['{"questions": {"q": {"score": 6}, "c": {"selected": "b", "confidence": 0.9}}}']

    kind = "id long, state string, questions array<struct<name:string,kind:string,first:string>>"
    questions = [("q", "score", None), ("c", "choice", "a"), ("z", "essay", None)]
    asked = spark.createDataFrame([(1, "up", questions), (2, "down", questions)], kind)
    got = {(r.id, r.question): (r.score, r.confidence, r.selected) for r in decision.cloud_batch(decision.Cloud("k", transport).ask(asked)).collect()}
    assert got == {(1, "q"): (1.0, 0.0, None), (1, "c"): (0.9, 0.9, "b"), (2, "q"): (0.5, 0.0, None), (2, "c"): (0.5, 0.0, "a")}
    lone = spark.createDataFrame([(1, "oops"), (2, '{"probability": 0.25}'), (3, None)], "id int, answer string")
    rows = lone.select(decision.cloud_detailed(F.col("answer"), F.lit("noul"), F.lit(None).cast("string")).alias("r"), decision.cloud_detailed(F.col("answer"), F.lit("choice"), F.lit("a")).alias("c")).collect()
    assert [(x.r.score, x.r.confidence, x.r.raw_probs) for x in rows] == [(0.5, 0.0, {}), (0.25, 0.25, {"yes": 0.25, "no": 0.75}), (0.5, 0.0, {})]
    assert [(x.c.score, x.c.selected) for x in rows] == [(0.0, "a")] * 3


def test_log_of_two_scorers(spark, tmp_path):
    prompts = spark.createDataFrame([(1, "a b c", "a b"), (2, "x", "y z")], "id long, context string, instruction string")
    path = f"{tmp_path}/sub/log"
    none = post.comparison_stats(post.read_log(spark, path)).first()
    assert none.n == 0 and none.error
    with pytest.raises(ValueError):
        post.harness(prompts, "choice")
    assert post.harness(prompts, "odd").first().primitive == "score"
    chosen = post.harness(prompts, "choice", [("p", "a"), ("q", "zzz")], main="b")
    for rows in (post.harness(prompts.withColumns({"latency_a": F.lit(4.0), "latency_b": F.lit(2.0)})), chosen):
        post.write_log(rows, path)
    log = post.read_log(spark, path)
    assert log.count() == 4 and {(r.primitive, r.primary) for r in log.collect()} == {("score", "a"), ("choice", "b")}
    stats = post.comparison_stats(log).first()
    assert (stats.n, stats.ms_a, stats.ms_b, stats.error) == (4, 4.0, 2.0, None)
    first = {r.id: (r.score, r.selected, r.latency_ms) for r in post.primary(log.where("primitive = 'score'"), "a").collect()}
    assert first == {1: (1.0, None, 4.0), 2: (0.0, None, 4.0)}
    assert {r.selected for r in post.primary(chosen, "a").collect()} == {"p"}
    post.write_table(stats_frame := post.comparison_stats(log), f"{tmp_path}/csv")
    assert spark.read.option("header", True).csv(f"{tmp_path}/csv").columns == stats_frame.columns
    prompts.drop("id").write.json(f"{tmp_path}/prompts")
    assert post.read_prompts(spark, f"{tmp_path}/prompts").where("id is not null").count() == 2


def test_bullets(spark):
    nodes = spark.createDataFrame([(1, 1, "b", "B"), (1, 0, "a", None)], "query_id long, ord int, name string, text string")
    asked = spark.createDataFrame([(1,), (2,)], "query_id long")
    assert {r.query_id: r.text for r in post.bullets(nodes, asked).collect()} == {1: "- a: \n- b: B", 2: post.NOTHING}


def test_chunks_are_those_of_the_sequential_fold(spark):
    rng = random.Random(9)
    rows = [(i, " ".join(" ".join(rng.choice("red blue green old new".split()) for _ in range(rng.randrange(1, 4))) + rng.choice(".!?") for _ in range(rng.randrange(0, 14)))) for i in range(60)]
    docs = spark.createDataFrame([*rows, (90, None), (91, "  raw text  ")], "doc_id long, text string")
    plain = lambda c, i: decision.lexical(c, i)

    def fold(text, least, threshold):
        s = [x.strip() for x in re.split(r"(?<=[.!?])\s+", text) if x.strip()]
        if len(s) <= least:
            return [text]
        out, now = [], [s[0]]
        for a, b in zip(s, s[1:], strict=False):
            x, y = (set(re.findall(r"\w+", t)) for t in (a, b))
            if 1 - len(x & y) / len(y) >= threshold and len(now) >= least:
                out.append(" ".join(now))
                now = []
            now.append(b)
        return [*out, " ".join(now)]

    for least, threshold in ((1, 0.6), (2, 0.6), (3, 0.3)):
        expected = {(i, k, c) for i, t in [*rows, (91, "  raw text  ")] for k, c in enumerate(fold(t, least, threshold))}
        for scorer in (decision.lexical, plain):
            assert {tuple(r) for r in ingest.chunks(docs, threshold, least, scorer).collect()} == expected


def test_texts_of_prompts(spark):
    asked = spark.createDataFrame([(1, "who?", "a: A | b: B | c: C | d: D"), (2, "who?", ""), (3, None, None)], "id long, question string, context string")
    load = lambda: lambda prompts: [f"  {len(p)} words follow {'x ' * 9}" for p in prompts]
    p = generate.prompt(F.col("question"), F.col("context"), "Be short.")
    rows = asked.select("id", p.alias("p"), generate.generated(F.when(F.col("id") < 3, p), load, 4).alias("said"), generate.extracted(F.col("question"), F.col("context")).alias("e")).orderBy("id").collect()
    assert [r.p for r in rows] == ["Be short.\nContext: a: A | b: B | c: C | d: D\nQuestion: who?", "Be short.\nQuestion: who?", "Be short."]
    assert [r.said for r in rows] == [f"{len(rows[0].p)} words follow x", f"{len(rows[1].p)} words follow x", None]
    assert [r.e for r in rows] == ["a: A | b: B | c: C", "", ""]
