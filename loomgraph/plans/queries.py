"""The registered graph queries, each with the same in SQL where SQL can express it."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.config import EngineConfig
from loomgraph.functions import decision as d
from loomgraph.operators import algorithms, engine, ingest, learnt, measure, post, retrieve
from loomgraph.operators.upkeep import Components
from loomgraph.sources.adjacency import bucketed
from loomgraph.sources.business_graph import SQL as GRAPH
from loomgraph.sources.business_graph import business_graph, graph_by_source, read
from loomgraph.sources.changes import ChangeStore
from loomgraph.sources.factory import open_store
from loomgraph.sources.store import EDGE, GraphStore
from loomgraph.sources.vectors import VectorIndex, vector_top_k
from loomgraph.functions.text import ENDS, WHITE
from loomgraph.tables import own_dir, written

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def put(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return put


# --- the lexical scorer in SQL


def _tok(x: str) -> str:
    return f"list_distinct(list_filter(regexp_split_to_array(lower({x}), '[^\\p{{L}}\\p{{N}}]+'), lambda t: t <> ''))"


def _overlap(context: str, instruction: str) -> str:
    return f"(CASE WHEN len({_tok(instruction)}) = 0 THEN 0.0 ELSE coalesce(len(list_intersect({_tok(context)}, {_tok(instruction)})), 0)::DOUBLE / len({_tok(instruction)}) END)"


def _score(context: str, instruction: str) -> str:
    return f"round({_of(_overlap(context, instruction))}, 6)"


def _of(o: str) -> str:
    return f"({o} * {o} + 0.5 * (2 * {o} * (1 - {o})))"


EDGE_TEXT = "concat_ws(' ', src, rel_type, tgt)"
ASKED = "which supplier nation is located in region 3 and part of it"
QUESTIONS = "questions AS (SELECT conv_id * 1000 + turn AS query_id, text FROM conversations WHERE role = 'user')"


def _questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "conversations").where("role = 'user'").select((F.col("conv_id") * 1000 + F.col("turn")).alias("query_id"), "text")


# --- scans and changes


@query(GRAPH + " SELECT src, tgt, rel_type, coalesce(pagerank, 0.0) AS pagerank FROM edges JOIN nodes ON name = tgt")
def neighbors_out(spark, sf_dir):
    store = graph_by_source(spark, sf_dir)
    return store.neighbors(store.nodes.select(F.col("name").alias("src")))


@query(GRAPH + " SELECT src, tgt, rel_type FROM edges ORDER BY ALL LIMIT 10000")
def edge_scan_limit(spark, sf_dir):
    return business_graph(spark, sf_dir).edge_scan(10_000)


@query(GRAPH + " SELECT DISTINCT src, tgt FROM edges")
def edge_distinct(spark, sf_dir):
    return business_graph(spark, sf_dir).digraph()


@query(GRAPH + " SELECT src, tgt FROM edges")
def edge_list(spark, sf_dir):
    return business_graph(spark, sf_dir).edges.select("src", "tgt")


@query(GRAPH + ", new AS (SELECT 'nation:' || i AS name, 'country' AS label, i FROM range(20, 40) t(i)) SELECT coalesce(nodes.name, new.name) AS name, coalesce(new.label, nodes.label) AS label, CASE WHEN nodes.name IS NULL THEN NULL ELSE nodes.label END AS kind, CASE WHEN new.name IS NULL THEN NULL ELSE '2' END AS seen, CASE WHEN new.name IS NULL THEN NULL ELSE '1' END AS once FROM nodes FULL JOIN new ON nodes.name = new.name")
def node_upsert(spark, sf_dir):
    """Each new name comes three times: the latest label and properties count, and what only earlier rows have stays."""
    times = spark.range(20, 40).crossJoin(F.broadcast(spark.range(3).select(F.col("id").alias("ord"))))
    props = F.when(F.col("ord") == 1, F.create_map(F.lit("seen"), F.lit("1"), F.lit("once"), F.lit("1"))).otherwise(F.create_map(F.lit("seen"), F.col("ord").cast("string")))
    new = times.select(F.concat(F.lit("nation:"), "id").alias("name"), F.element_at(F.array(F.lit("state"), F.lit("country"), F.lit(None)), F.col("ord").cast("int") + 1).alias("label"), props.alias("props"), "ord")
    out = business_graph(spark, sf_dir).upsert_nodes(new).nodes
    return out.select("name", "label", *[F.try_element_at("props", F.lit(k)).alias(k) for k in ("kind", "seen", "once")])


@query(GRAPH + ", new AS (SELECT 'nation:' || i AS src, 'region:' || (i % 7) AS tgt, 'NEAR' AS rel_type FROM range(0, 40) t(i)) SELECT src, tgt, rel_type, NULL::VARCHAR AS ord FROM edges UNION ALL SELECT src, tgt, rel_type, '1' FROM new WHERE src IN (SELECT name FROM nodes) AND tgt IN (SELECT name FROM nodes)")
def edge_upsert_guarded(spark, sf_dir):
    """Each new edge comes twice; edges whose ends are not nodes are left out."""
    times = spark.range(40).crossJoin(F.broadcast(spark.range(2).select(F.col("id").alias("ord"))))
    new = times.select(F.concat(F.lit("nation:"), "id").alias("src"), F.concat(F.lit("region:"), F.col("id") % 7).alias("tgt"), F.lit("NEAR").alias("rel_type"), F.create_map(F.lit("ord"), F.col("ord").cast("string")).alias("props"), "ord")
    return business_graph(spark, sf_dir).upsert_edges(new).edges.select(*EDGE, F.try_element_at("props", F.lit("ord")).alias("ord"))


@query(GRAPH + ", s AS (SELECT 'supplier:' || s_suppkey::BIGINT AS name FROM supplier WHERE s_suppkey IN (SELECT vec_id FROM embeddings)) SELECT 'nodes' AS kind, count(*) AS n FROM nodes UNION ALL SELECT 'edges', count(*) FROM edges WHERE rel_type <> 'PART_OF' UNION ALL SELECT 'embeddings', count(*) FROM s UNION ALL SELECT 'duplicates', 0")
def store_roundtrip(spark, sf_dir):
    """A store is made by name, saved, opened, changed and saved over itself, and opened again."""
    path = f"{own_dir(spark)}/store-{uuid.uuid4().hex}"
    vectors = read(spark, sf_dir, "embeddings").select(F.concat(F.lit("supplier:"), "vec_id").alias("name"), "embedding")
    first = open_store(spark, " Folder ", path)
    full = business_graph(spark, sf_dir)
    replace(first, nodes=full.nodes, edges=full.edges).set_embeddings(vectors).save(path)
    now = open_store(spark, "parquet", path)
    now.delete_edges(now.edges.where("rel_type = 'PART_OF'")).save(path)
    last = open_store(spark, None, path)
    parts = {"nodes": last.nodes, "edges": last.edges, "embeddings": last.embeddings, "duplicates": last.duplicates()}
    out = None
    for kind, df in parts.items():
        one = df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(kind).alias("kind"), "n")
        out = one if out is None else out.unionByName(one)
    return out


@query(GRAPH + " SELECT src, tgt, rel_type FROM edges WHERE NOT (rel_type = 'LOCATED_IN' AND tgt = 'nation:3')")
def edge_delete(spark, sf_dir):
    store = business_graph(spark, sf_dir)
    return store.delete_edges(store.edges.where("rel_type = 'LOCATED_IN' and tgt = 'nation:3'")).edges.select(*EDGE)


@query(GRAPH + """, far AS (SELECT 'nation:' || (20 + o_custkey % 20)::BIGINT AS name, max(o_orderkey)::BIGINT AS last FROM orders GROUP BY ALL),
  n AS (SELECT coalesce(nodes.name, far.name) AS name, coalesce(nodes.label, 'country') AS label, last FROM nodes FULL JOIN far ON nodes.name = far.name),
  e AS (SELECT src, tgt, rel_type, NULL::BIGINT AS last FROM edges WHERE NOT (rel_type = 'PLACED_BY' AND split_part(src, ':', 2)::BIGINT % 10 = 0) UNION ALL SELECT 'nation:' || (20 + o_custkey % 20)::BIGINT, 'region:' || (o_custkey % 7)::BIGINT, 'NEAR', max(o_orderkey)::BIGINT FROM orders WHERE o_custkey % 7 < 5 GROUP BY ALL)
  SELECT 'node' AS kind, name, label AS other, last FROM n UNION ALL SELECT 'edge', src, tgt || ' ' || rel_type, last FROM e""")
def graph_changes(spark, sf_dir):
    """A graph that is changed four times without being rewritten, its touched buckets compacted in between: nodes and
    edges made from the orders, edges whose ends are no nodes, and a tenth of the placed orders taken back."""
    full, orders = business_graph(spark, sf_dir), read(spark, sf_dir, "orders")
    made, k = F.concat(F.lit("nation:"), (F.col("o_custkey") % 20 + 20).cast("long")), F.col("o_orderkey").cast("long")
    props = F.create_map(F.lit("last"), k.cast("string"))
    now = ChangeStore.create(spark, f"{own_dir(spark)}/changes-{uuid.uuid4().hex}", full)
    now = now.upsert_nodes(orders.select(made.alias("name"), F.when(F.col("o_custkey") % 20 > 4, F.lit("country")).alias("label"), props.alias("props"), k.alias("ord")))
    now = now.upsert_edges(orders.select(made.alias("src"), F.concat(F.lit("region:"), (F.col("o_custkey") % 7).cast("long")).alias("tgt"), F.lit("NEAR").alias("rel_type"), props.alias("props"), k.alias("ord"))).compact()
    now = now.delete_edges(full.edges.where("rel_type = 'PLACED_BY' and cast(split_part(src, ':', 2) as long) % 10 = 0"))
    now = now.upsert_edges(full.edges.where("rel_type = 'PART_OF'").withColumn("tgt", F.lit("nowhere")))
    g, last = now.graph(), F.try_element_at("props", F.lit("last")).cast("long").alias("last")
    nodes = g.nodes.select(F.lit("node").alias("kind"), "name", F.col("label").alias("other"), last)
    return nodes.unionByName(g.edges.select(F.lit("edge").alias("kind"), F.col("src").alias("name"), F.concat_ws(" ", "tgt", "rel_type").alias("other"), last))


@query()
def word_vectors(spark, sf_dir):
    """Vectors learnt from all documents; by test against a dense decomposition."""
    return learnt.word_vectors(read(spark, sf_dir, "documents")).withColumnRenamed("vector", "embedding")


_PAIR_WORDS = "list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\\p{L}\\p{N}]+'), lambda t: t <> '')"


@query(f"""WITH t AS (SELECT doc_id, unnest(w) AS w, generate_subscripts(w, 1) AS i FROM (SELECT doc_id, {_PAIR_WORDS} AS w FROM documents)),
  p AS (SELECT x.w AS a, y.w AS b FROM t x JOIN t y ON x.doc_id = y.doc_id AND y.i BETWEEN x.i + 1 AND x.i + 4),
  n AS (SELECT a, b, sum(n) AS n FROM (SELECT a, b, count(*) AS n FROM p GROUP BY a, b UNION ALL SELECT b, a, count(*) FROM p WHERE a <> b GROUP BY a, b) GROUP BY a, b),
  m AS (SELECT a, sum(n) AS s FROM n GROUP BY a HAVING sum(n) >= 5), r AS (SELECT n.a, n.b, ln(n.n::DOUBLE * (SELECT sum(s) FROM m) / (x.s::DOUBLE * y.s)) AS w FROM n JOIN m x ON x.a = n.a JOIN m y ON y.a = n.b)
  SELECT a AS word, count(*) AS n, round(sum(w), 4) AS weight, round(max(w), 6) AS greatest FROM r WHERE w > 0 GROUP BY a""")
def word_neighbours(spark, sf_dir):
    """Of each word of the documents: how many words it stands beside more often than by chance, and how much more."""
    sums = learnt.weight_sums(read(spark, sf_dir, "documents"))
    return sums.select("word", "n", F.round("weight", 4).alias("weight"), F.round("greatest", 6).alias("greatest"))


@query("SELECT s_suppkey AS vec_id, embedding[1] AS first FROM supplier JOIN embeddings ON vec_id = s_suppkey")
def embedding_upsert(spark, sf_dir):
    store = business_graph(spark, sf_dir)
    new = read(spark, sf_dir, "embeddings").select(F.concat(F.lit("supplier:"), "vec_id").alias("name"), "embedding")
    out = store.set_embeddings(new).embeddings
    return out.select(F.regexp_extract("name", r":(\d+)", 1).cast("long").alias("vec_id"), F.col("embedding")[0].alias("first"))


# --- vectors

_COS = "round(list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) / (sqrt(list_dot_product(a.embedding::DOUBLE[], a.embedding::DOUBLE[])) * sqrt(list_dot_product(b.embedding::DOUBLE[], b.embedding::DOUBLE[])) + 1e-9), 6)"
_TOP = f"SELECT b.vec_id AS query, a.vec_id, {_COS} AS score FROM embeddings a, embeddings b WHERE b.vec_id % 100 = 0"


@query(f"SELECT query, vec_id, score, n AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, vec_id) AS n FROM ({_TOP})) WHERE n <= 20")
def vector_topk(spark, sf_dir):
    return vector_top_k(read(spark, sf_dir, "embeddings"), _asked_vectors(spark, sf_dir), 20).withColumn("rank", F.col("rank").cast("long"))


def _indexed(spark, sf_dir):
    return VectorIndex.build(read(spark, sf_dir, "embeddings"), f"{own_dir(spark)}/index-{uuid.uuid4().hex}")


def _asked_vectors(spark, sf_dir):
    return read(spark, sf_dir, "embeddings").where("vec_id % 100 = 0").select(F.col("vec_id").alias("query"), "embedding")


@query()
def vector_topk_indexed(spark, sf_dir):
    """vector_topk from inverted lists: nine tenths of its rows and more, from the lists nearest to each query alone."""
    return _indexed(spark, sf_dir).search(_asked_vectors(spark, sf_dir), 20).withColumn("rank", F.col("rank").cast("long"))


@query(f"SELECT query, vec_id, score, n AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, vec_id) AS n FROM ({_TOP})) WHERE n <= 20")
def vector_topk_lists(spark, sf_dir):
    """The same index, every list of it read: exactly the rows of vector_topk."""
    index = _indexed(spark, sf_dir)
    return index.search(_asked_vectors(spark, sf_dir), 20, len(index.centroids)).withColumn("rank", F.col("rank").cast("long"))


@query(f"WITH c AS (SELECT query AS query_id, 'which supplier ' || query % 10 || ' is 1' AS question, 'supplier ' || vec_id % 30 AS name, n AS ord FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, vec_id) AS n FROM ({_TOP})) WHERE n <= 20), s AS (SELECT *, {_score('question', 'name')} AS score FROM c) SELECT query_id, name, ord, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, ord) AS k FROM s) WHERE k <= 2")
def seed_topk_validated(spark, sf_dir):
    top = vector_topk(spark, sf_dir)
    c = top.select(F.col("query").alias("query_id"), F.concat(F.lit("which supplier "), F.col("query") % 10, F.lit(" is 1")).alias("question"), F.concat(F.lit("supplier "), F.col("vec_id") % 30).alias("name"), F.col("rank").alias("ord"))
    return retrieve.seeds(c).select("query_id", "name", "ord", "score")


@query(f"SELECT a.vec_id AS a, b.vec_id AS b, {_COS} AS sim FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id < b.vec_id WHERE {_COS} > 0.3")
def cosine_pairs(spark, sf_dir):
    return ingest.cosine_pairs(read(spark, sf_dir, "embeddings"), "label", 0.3)


# --- algorithms

_OUT = "links AS MATERIALIZED (SELECT src, tgt, count(*) OVER (PARTITION BY src) AS o FROM (SELECT DISTINCT src, tgt FROM edges)), names AS MATERIALIZED (SELECT src AS name FROM links UNION SELECT tgt FROM links), nn AS (SELECT count(*)::DOUBLE AS n FROM names), r0 AS (SELECT name, {r0} AS r FROM names, nn)"


def _steps(mode: str, n: int) -> str:
    out = []
    for i in range(n):
        out.append(f"f{i} AS (SELECT tgt, sum(r / o) AS f FROM links JOIN r{i} ON name = src GROUP BY tgt)")
        if mode == "nx":
            out.append(f"l{i} AS (SELECT coalesce(sum(r), 0) AS l FROM r{i} ANTI JOIN links ON name = src)")
            out.append(f"r{i + 1} AS MATERIALIZED (SELECT name, (1 - 0.85) / n + 0.85 * (coalesce(f, 0) + l / n) AS r FROM names LEFT JOIN f{i} ON name = tgt, nn, l{i})")
        else:
            out.append(f"r{i + 1} AS MATERIALIZED (SELECT name, (1 - 0.85) + 0.85 * coalesce(f, 0) AS r FROM names LEFT JOIN f{i} ON name = tgt)")
    return ", ".join(out)


@query(f"{GRAPH}, {_OUT.format(r0='1.0 / n')}, {_steps('nx', 20)} SELECT name, round(r, 9) AS pagerank FROM r20")
def pagerank_nx(spark, sf_dir):
    return algorithms.pagerank(business_graph(spark, sf_dir).edges).select("name", F.round("pagerank", 9).alias("pagerank"))


@query(f"{GRAPH}, {_OUT.format(r0='1 - 0.85')}, {_steps('gds', 20)} SELECT name, round(r, 9) AS pagerank FROM r20")
def pagerank_gds(spark, sf_dir):
    return algorithms.pagerank(business_graph(spark, sf_dir).edges, mode="gds").select("name", F.round("pagerank", 9).alias("pagerank"))


_BOTH = "both_ways AS MATERIALIZED (SELECT src AS a, tgt AS b FROM edges WHERE src <> tgt UNION SELECT tgt, src FROM edges WHERE src <> tgt)"


def _least_steps(n: int) -> str:
    """Each node takes the least name of itself and its neighbours, n times."""
    out = ["w0 AS (SELECT a AS name, a AS c FROM both_ways GROUP BY a)"]
    out += [f"w{i + 1} AS MATERIALIZED (SELECT w.name, least(w.c, min(v.c)) AS c FROM w{i} w JOIN both_ways ON w.name = a JOIN w{i} v ON v.name = b GROUP BY w.name, w.c)" for i in range(n)]
    return ", ".join(out)


@query(f"{GRAPH}, {_BOTH}, {_least_steps(12)} SELECT name, c AS community FROM w12")
def wcc(spark, sf_dir):
    return algorithms.components(business_graph(spark, sf_dir).edges)


_GONE = "(rel_type = 'LOCATED_IN' AND cast(split_part(src, ':', 2) AS bigint) % 10 = 0 OR rel_type = 'PLACED_BY' AND cast(split_part(tgt, ':', 2) AS bigint) % 10 = 0)"


@query(f"{GRAPH}, more AS (SELECT DISTINCT 'event:' || (event_id % 1000)::BIGINT AS src, 'customer:' || (event_id % 30 * 10)::BIGINT AS tgt FROM events), "
       f"kept AS (SELECT src, tgt FROM edges WHERE NOT {_GONE} UNION SELECT src, tgt FROM more), names AS (SELECT name FROM nodes UNION SELECT src FROM more UNION SELECT tgt FROM more), "
       f"{_BOTH.replace('FROM edges', 'FROM kept')}, {_least_steps(12)} SELECT name, coalesce(c, name) AS community FROM names LEFT JOIN w12 USING (name)")
def wcc_kept(spark, sf_dir):
    """Components that follow a graph through changes: a tenth of the customers lose their orders and nations, suppliers
    theirs, then events join customers."""
    full, at = business_graph(spark, sf_dir), f"{own_dir(spark)}/components-{uuid.uuid4().hex}"
    e = F.col("event_id").cast("long")
    more = read(spark, sf_dir, "events").select(F.concat(F.lit("event:"), e % 1000).alias("src"), F.concat(F.lit("customer:"), e % 30 * 10).alias("tgt")).distinct()
    gone = full.edges.where(_GONE)
    store = ChangeStore.create(spark, f"{at}/graph", full)
    now = Components.build(full, f"{at}/labels")
    store = store.delete_edges(gone)
    return now.removed(gone, store).added(more).all()


def _core_steps(n: int) -> str:
    """Each node takes the h-index of its neighbours' numbers, from the degrees on, n times."""
    out = ["k0 AS MATERIALIZED (SELECT a AS name, count(*) AS h FROM both_ways GROUP BY a)"]
    out += [f"k{i + 1} AS MATERIALIZED (SELECT name, max(least(h, n)) AS h FROM (SELECT a AS name, v.h, row_number() OVER (PARTITION BY a ORDER BY v.h DESC) AS n FROM both_ways JOIN k{i} v ON v.name = b) GROUP BY name)" for i in range(n)]
    return ", ".join(out)


@query(f"{GRAPH}, {_BOTH}, {_core_steps(30)} SELECT name, h::INT AS core FROM k30")
def kcore(spark, sf_dir):
    return algorithms.k_core(business_graph(spark, sf_dir).edges)


def _walk_steps(n: int) -> str:
    out = ["h1 AS (SELECT src, count(*) AS n FROM edges GROUP BY src)"]
    out += [f"h{i + 1} AS (SELECT e.src, sum(h.n)::BIGINT AS n FROM edges e JOIN h{i} h ON e.tgt = h.src GROUP BY e.src)" for i in range(1, n)]
    return ", ".join(out)


@query(f"{GRAPH}, {_walk_steps(4)} " + " UNION ALL ".join(f"SELECT {i}::INT AS hop, src, n FROM h{i}" for i in range(1, 5)))
def khop_counts(spark, sf_dir):
    return algorithms.walks(business_graph(spark, sf_dir).edges, 4)


@query(f"{GRAPH} SELECT e.src, count(*) AS n FROM edges e JOIN edges f ON e.tgt = f.src GROUP BY e.src")
def khop2_counts(spark, sf_dir):
    return algorithms.walks(business_graph(spark, sf_dir).edges, 2).where("hop = 2").select("src", "n")


@query(f"{GRAPH} SELECT e.src AS seed, count(*) AS n, min(e.src || '>' || e.tgt || '>' || f.tgt) AS first, max(e.src || '>' || e.tgt || '>' || f.tgt) AS last FROM edges e JOIN edges f ON e.tgt = f.src GROUP BY e.src")
def khop_paths(spark, sf_dir):
    """Each node's own steps are summed up before anything meets, so no walk of two is ever a row."""
    e = business_graph(spark, sf_dir).edges.select("src", "tgt")
    step = e.groupBy(F.col("src").alias("via")).agg(F.count(F.lit(1)).alias("k"), F.min("tgt").alias("low"), F.max("tgt").alias("high"))
    two = e.select(F.col("src").alias("seed"), F.col("tgt").alias("via")).join(step, "via")
    way = lambda far: F.concat_ws(">", "seed", "via", far)
    return two.groupBy("seed").agg(F.sum("k").alias("n"), F.min(way("low")).alias("first"), F.max(way("high")).alias("last"))


@query(f"{GRAPH}, f AS (SELECT src, min(tgt) AS tgt FROM edges GROUP BY src), " + ", ".join(["n1 AS (SELECT s.name AS src, f.tgt AS node FROM nodes s JOIN f ON f.src = s.name)"] + [f"n{i + 1} AS (SELECT n.src, f.tgt AS node FROM n{i} n JOIN f ON f.src = n.node)" for i in range(1, 4)]) + " " + " UNION ALL ".join(f"SELECT {i}::INT AS hop, src, node FROM n{i}" for i in range(1, 5)))
def hop_walk(spark, sf_dir):
    store = graph_by_source(spark, sf_dir)
    return measure.follow(store, store.nodes.select(F.col("name").alias("src")))


# --- ingestion

_SENT = rf"list_filter(list_transform(string_split(regexp_replace(text, '([.!?]){WHITE}+', E'\\1\x01', 'g'), E'\x01'), lambda s: regexp_replace(s, '{ENDS}', '', 'g')), lambda s: s <> '')"


@query(f"SELECT doc_id, len({_SENT}) AS n, array_to_string({_SENT}, '|') AS joined FROM documents")
def sentences(spark, sf_dir):
    s = ingest.sentences(F.col("text"))
    return read(spark, sf_dir, "documents").select("doc_id", F.size(s).cast("long").alias("n"), F.array_join(s, "|").alias("joined"))


def _chunk_sql(least: int) -> str:
    return f"""WITH RECURSIVE s AS (SELECT doc_id, text, {_SENT} AS s FROM documents),
    e AS (SELECT doc_id, i, s[i] AS sent, CASE WHEN i > 1 AND 1 - {_overlap('s[i - 1]', 's[i]')} >= 0.85 THEN 1 ELSE 0 END AS border FROM (SELECT doc_id, s, unnest(range(1, len(s) + 1)) AS i FROM s WHERE len(s) > {least})),
    f AS (SELECT doc_id, i, sent, 0 AS k, 1 AS size FROM e WHERE i = 1 UNION ALL
          SELECT e.doc_id, e.i, e.sent, CASE WHEN border = 1 AND size >= {least} THEN k + 1 ELSE k END, CASE WHEN border = 1 AND size >= {least} THEN 1 ELSE size + 1 END FROM f JOIN e ON e.doc_id = f.doc_id AND e.i = f.i + 1)
    SELECT doc_id, k AS chunk_idx, string_agg(sent, ' ' ORDER BY i) AS chunk FROM f GROUP BY doc_id, k
    UNION ALL SELECT doc_id, 0, text FROM s WHERE len(s) <= {least}"""


@query(_chunk_sql(1))
def chunks_min1(spark, sf_dir):
    return ingest.chunks(read(spark, sf_dir, "documents"), least=1)


@query(_chunk_sql(2))
def chunks_fold(spark, sf_dir):
    return ingest.chunks(read(spark, sf_dir, "documents"))


_NAMES = "regexp_extract_all(text, '[A-Z][a-z]+(?: [A-Z][a-z]+)+')"
_ORDERED = "array_to_string(list_filter({x}, lambda t, i: list_position({x}, t) = i), '|')"


@query(f"SELECT doc_id, {_ORDERED.format(x=_NAMES)} AS names FROM documents")
def ner_regex(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", F.array_join(ingest.capitalised(F.col("text")), "|").alias("names"))


_FOUND_NAMES = f"list_filter({_NAMES}, lambda t, i: list_position({_NAMES}, t) = i)"


@query(f"WITH d AS (SELECT doc_id, doc_id % 4 AS kind, {_FOUND_NAMES} AS n FROM documents) SELECT doc_id, CASE kind WHEN 0 THEN list_concat(n, ['0', 'false', 'x']) WHEN 1 THEN n WHEN 2 THEN list_concat(['True', '1.5'], n) ELSE []::VARCHAR[] END AS names FROM d WHERE n IS NOT NULL")
def ner_parse(spark, sf_dir):
    """Answers as a model gives them, made of each document's names: a list of strings with some that look false, parts
    between commas with white space, a list of other values, and an object."""
    docs = read(spark, sf_dir, "documents").select("doc_id", ingest.capitalised(F.col("text")).alias("n")).where("n is not null")
    quoted = F.concat_ws(", ", F.transform("n", lambda x: F.concat(F.lit('" '), x, F.lit('\\n"'))), F.lit('"0", "false", "", null, "x\\t"'))
    mixed = F.concat_ws(",", F.lit("true, false, 0, 1.5, [], {}"), F.transform("n", lambda x: F.concat(F.lit('"'), x, F.lit('"'))))
    kind = F.col("doc_id") % 4
    raw = F.when(kind == 0, F.concat(F.lit("["), quoted, F.lit("]"))).when(kind == 1, F.concat(F.lit("[, "), F.array_join("n", "\u00a0,\n\t"), F.lit(" ]")))
    raw = raw.when(kind == 2, F.concat(F.lit("["), mixed, F.lit("]"))).otherwise(F.to_json(F.struct("n")))
    return docs.select("doc_id", ingest.parse_names(raw).alias("names"))


_WORDS = "regexp_extract_all(text, '[A-Z][a-z]+')"


@query(f"SELECT doc_id, {_ORDERED.format(x=_WORDS)} AS names FROM documents")
def entity_dedup(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", F.array_join(F.array_distinct(F.regexp_extract_all("text", F.lit("[A-Z][a-z]+"), 0)), "|").alias("names"))


def _merging(spark, sf_dir):
    p = ingest.cosine_pairs(read(spark, sf_dir, "embeddings"), "label", 0.3, keep_group=True)
    return p.select("label", (F.col("a") * 1_000_000_000 + F.col("b")).alias("ord"), F.concat(F.lit("v"), "a").alias("a"), F.concat(F.lit("v"), "b").alias("b"), F.col("sim").alias("score"))


@query()
def entity_merge_fold(spark, sf_dir):
    return ingest.merge_names(_merging(spark, sf_dir), "label")


@query(f"WITH RECURSIVE p AS (SELECT 'v' || a.vec_id AS a, 'v' || b.vec_id AS b FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id <> b.vec_id WHERE {_COS} > 0.3), r AS (SELECT a AS name, b AS other FROM p UNION SELECT r.name, p.b FROM r JOIN p ON r.other = p.a) SELECT name, (min(struct_pack(n := -length(other), t := other)))['t'] AS canonical FROM r GROUP BY name")
def entity_merge_cc(spark, sf_dir):
    return ingest.merge_components(_merging(spark, sf_dir))


@query(f"{GRAPH}, s AS (SELECT src, tgt, rel_type, {_score(repr(ASKED), EDGE_TEXT)} AS score FROM edges) SELECT src, tgt, rel_type, score, score >= 0.3 AS kept FROM s")
def edge_verify(spark, sf_dir):
    return ingest.verify(business_graph(spark, sf_dir).edges.select(*EDGE), F.lit(ASKED)).select("src", "tgt", "rel_type", "score", "kept")


@query(f"{GRAPH}, s AS (SELECT {_score(repr(ASKED), EDGE_TEXT)} AS score FROM edges) SELECT count(*) AS total_checked, count(*) FILTER (score < 0.3) AS pruned, count(*) FILTER (score >= 0.3) AS kept FROM s")
def edge_verify_stats(spark, sf_dir):
    return ingest.verification_stats(edge_verify(spark, sf_dir))


@query(f"{GRAPH}, s AS (SELECT src, tgt, rel_type, {_score(repr(ASKED), EDGE_TEXT)} AS score FROM edges) SELECT src, tgt, rel_type, score < 0.3 AS pruned, CASE WHEN score < 0.3 THEN score END AS score FROM s")
def edge_prune(spark, sf_dir):
    """The edges that a pruned store still has, and those that it lost with their scores."""
    left, gone, _ = ingest.prune(business_graph(spark, sf_dir), F.lit(ASKED))
    kept = left.edges.select(*EDGE, F.lit(False).alias("pruned"), F.lit(None).cast("double").alias("score"))
    return kept.unionByName(gone.select(*EDGE, F.lit(True).alias("pruned"), "score"))


_ONTO = ", ".join(f"('{k}', {i}, '{t}')" for i, (k, t) in enumerate(ingest.ONTOLOGY))


def _align_sql(key: str, context: str) -> str:
    return f"""o(k, ord, descr) AS (VALUES {_ONTO}), s AS (SELECT {key}, k, ord, {_score(context, "concat_ws(' ', '', descr)")} AS sc FROM r, o),
  b AS (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY sc DESC, ord) AS n, sum(sc) OVER (PARTITION BY {key}) AS t FROM s),
  f AS (SELECT {key}, CASE WHEN round(sc / CASE WHEN t = 0 THEN 1 ELSE t END, 6) < 0.25 THEN 'RELATED_TO' ELSE k END AS key, round(sc / CASE WHEN t = 0 THEN 1 ELSE t END, 6) AS confidence FROM b WHERE n = 1)"""


_RAW_WORDS = "lower(translate(raw, '_-', '  '))"


@query(f"{GRAPH}, r AS (SELECT DISTINCT rel_type AS raw FROM edges UNION SELECT event_type FROM events), {_align_sql('raw', _RAW_WORDS)} SELECT * FROM f")
def ontology_align(spark, sf_dir):
    raw = business_graph(spark, sf_dir).edges.select(F.col("rel_type").alias("raw")).union(read(spark, sf_dir, "events").select("event_type"))
    return ingest.align(raw)


@query(f"{GRAPH}, r AS (SELECT DISTINCT rel_type AS raw, src, tgt FROM edges), {_align_sql('raw, src, tgt', f'concat_ws({chr(39)} {chr(39)}, {_RAW_WORDS}, src, tgt)')} SELECT src, tgt, key AS rel_type, length(src) AS width FROM f")
def align_edges(spark, sf_dir):
    edges = business_graph(spark, sf_dir).edges.select("src", "tgt", "rel_type", F.length("src").cast("long").alias("width"))
    return ingest.align_edges(edges)


# --- primitives

_PAIRS = "SELECT b.item_id, b.text AS instruction, a.text AS context FROM benchmark b JOIN benchmark a ON b.item_id = a.item_id + 1"


def _prompts(spark, sf_dir):
    b = read(spark, sf_dir, "benchmark")
    before = b.select((F.col("item_id") + 1).alias("item_id"), F.col("text").alias("context"))
    return b.select(F.col("item_id").alias("id"), F.col("text").alias("instruction")).join(before.withColumnRenamed("item_id", "id"), "id")


@query(f"SELECT item_id AS id, {_score('context', 'instruction')} AS score FROM ({_PAIRS}) WHERE context IS NOT NULL")
def score_col(spark, sf_dir):
    return _prompts(spark, sf_dir).select("id", F.round(d.score(d.probabilities(d.lexical(F.col("context"), F.col("instruction")))), 6).alias("score"))


@query(f"SELECT item_id AS id, round({_overlap('context', 'instruction')} * {_overlap('context', 'instruction')}, 6) AS p FROM ({_PAIRS}) WHERE context IS NOT NULL")
def noul_col(spark, sf_dir):
    return _prompts(spark, sf_dir).select("id", F.round(d.noul(d.probabilities(d.lexical(F.col("context"), F.col("instruction")))), 6).alias("p"))


_PICK = [("same", "the same words"), ("other", "other things entirely"), ("none", "nothing at all")]
_PICKS = ", ".join(f"('{k}', {i}, '{t}')" for i, (k, t) in enumerate(_PICK))


def _options(spark):
    return spark.createDataFrame([(k, i, t) for i, (k, t) in enumerate(_PICK)], "option string, ord int, description string")


def _choice_sql(score: str) -> str:
    """id, k, s, confidence of the best option of each prompt of pr."""
    return f"SELECT id, k, s, s / CASE WHEN t = 0 THEN 1 ELSE t END AS confidence FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY s DESC, ord) AS n, sum(s) OVER (PARTITION BY id) AS t FROM (SELECT id, k, ord, {score} AS s FROM pr, o)) WHERE n = 1"


_PR = f"pr AS (SELECT item_id AS id, context, instruction FROM ({_PAIRS}) WHERE context IS NOT NULL), o(k, ord, descr) AS (VALUES {_PICKS})"
_WITH_OPTION = "concat_ws(' ', instruction, descr)"
_LEXICAL_CHOICE = _choice_sql(_of(_overlap("context", _WITH_OPTION)))


@query(f"WITH {_PR} SELECT id, k AS option, round(s, 6) AS best, round(confidence, 6) AS confidence FROM ({_LEXICAL_CHOICE})")
def choice_argmax(spark, sf_dir):
    found = d.choose(_prompts(spark, sf_dir), "id", _options(spark), F.col("context"), F.col("instruction"))
    return found.select("id", "option", F.round("best", 6).alias("best"), F.round("confidence", 6).alias("confidence"))


@query(f"WITH {_PR}, c AS ({_LEXICAL_CHOICE}) SELECT id, CASE id % 3 WHEN 0 THEN {_score('context', 'instruction')} WHEN 1 THEN round({_overlap('context', 'instruction')} * {_overlap('context', 'instruction')}, 6) END AS answer, CASE WHEN id % 3 = 2 THEN k END AS selected FROM pr JOIN c USING (id)")
def ask_batch(spark, sf_dir):
    kind = F.element_at(F.array(F.lit("score"), F.lit("noul"), F.lit("choice")), (F.col("id") % 3 + 1).cast("int"))
    chosen = d.choose(_prompts(spark, sf_dir), "id", _options(spark), F.col("context"), F.col("instruction"))
    asked = chosen.withColumn("_a", d.ask(kind, d.probabilities(d.lexical(F.col("context"), F.col("instruction"))), F.col("option")))
    return asked.select("id", F.round("_a.answer", 6).alias("answer"), "_a.selected")


@query(f"WITH {_PR}, p AS (SELECT id, {_overlap('context', 'instruction')} AS x FROM pr) SELECT id, round(x * x, 6) AS score, round(greatest(x * x, 2 * x * (1 - x), (1 - x) * (1 - x)), 6) AS confidence, round(2 * x * (1 - x), 4) AS tangential, 'lexical' AS backend, 'noul' AS primitive FROM p")
def score_detailed(spark, sf_dir):
    found = _prompts(spark, sf_dir).withColumn("_d", d.decide(F.col("context"), F.col("instruction"), "lexical", "noul"))
    return found.select("id", F.round("_d.score", 6).alias("score"), F.round("_d.confidence", 6).alias("confidence"), F.col("_d.raw_probs")["tangential"].alias("tangential"), "_d.backend", "_d.primitive")


_LOGITS = "(SELECT l_orderkey, l_linenumber, exp(l_discount * 10 - m) AS a, exp(l_tax * 10 - m) AS b, exp(l_quantity / 20 - m) AS c FROM (SELECT *, greatest(l_discount * 10, l_tax * 10, l_quantity / 20) AS m FROM lineitem))"


@query(f"SELECT l_orderkey, l_linenumber, round((c + 0.5 * b) / (a + b + c), 6) AS score, round(c / (a + b + c), 6) AS p, round(greatest(a, b, c) / (a + b + c), 6) AS confidence FROM {_LOGITS}")
def softmax_scores(spark, sf_dir):
    logits = F.array(F.col("l_discount") * 10, F.col("l_tax") * 10, F.col("l_quantity") / 20)
    found = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", d.labelled(logits, ["irrelevant", "tangential", "critical"]).alias("_p"))
    return found.select("l_orderkey", "l_linenumber", F.round(d.label_score(F.col("_p")), 6).alias("score"), F.round(d.label_noul(F.col("_p")), 6).alias("p"), F.round(F.array_max(F.map_values("_p")), 6).alias("confidence"))


@query("SELECT * FROM (VALUES (0, 0.666667::DOUBLE, 0.5::DOUBLE, 'x'), (1, 1.0, 0.5, 'b'), (2, 0.5, 0.8, 'x'), (3, 0.5, 0.5, 'x')) t(id, score, p, choice)")
def cloud_decode(spark, sf_dir):
    a = spark.createDataFrame([(0, '{"score": 2}'), (1, '{"score": 9, "selected": "b"}'), (2, '{"probability": 0.8}'), (3, "oops")], "id int, answer string")
    return a.select("id", F.round(d.cloud_score(F.col("answer")), 6).alias("score"), d.cloud_noul(F.col("answer")).alias("p"), d.cloud_choice(F.col("answer"), ["x", "b"]).alias("choice"))


_CLOUD = "SELECT conv_id * 1000 + turn AS id, CASE WHEN turn % 3 = 1 THEN 'oops' ELSE '{\"questions\": {\"far\": {\"score\": ' || turn || ', \"confidence\": 0.25}, \"is\": {\"probability\": 0.75}, \"which\": {\"selected\": \"b\", \"probabilities\": {\"a\": 0.125, \"b\": 0.625}}}}' END AS body FROM conversations"


@query(f"""WITH c AS ({_CLOUD}), q(question, primitive) AS (VALUES ('far', 'score'), ('is', 'noul'), ('which', 'choice'), ('left', 'noul'))
  SELECT id, question, CASE WHEN body = 'oops' OR question = 'left' THEN 0.5 WHEN question = 'far' THEN round(least((id % 1000) / 3.0, 1.0), 6) WHEN question = 'is' THEN 0.75 ELSE 0.625 END::DOUBLE AS score,
  CASE WHEN body = 'oops' THEN 0.0 WHEN question = 'far' THEN 0.25 WHEN question = 'is' THEN 0.75 WHEN question = 'left' THEN 0.5 ELSE 0.625 END::DOUBLE AS confidence,
  CASE WHEN body = 'oops' THEN 0.0 ELSE 7.5 END::DOUBLE AS latency_ms, CASE WHEN question = 'which' THEN CASE WHEN body = 'oops' THEN 'a' ELSE 'b' END END AS selected, primitive FROM c, q""")
def cloud_batch(spark, sf_dir):
    """One remote answer for four questions of each turn, and a fifth of an unknown kind, which is dropped."""
    turn = F.col("turn").cast("string")
    body = F.when(F.col("turn") % 3 == 1, "oops").otherwise(F.concat(F.lit('{"questions": {"far": {"score": '), turn, F.lit(', "confidence": 0.25}, "is": {"probability": 0.75}, "which": {"selected": "b", "probabilities": {"a": 0.125, "b": 0.625}}}}')))
    asked = [("far", "score", None), ("is", "noul", None), ("which", "choice", "a"), ("left", "noul", None), ("odd", "essay", None)]
    questions = F.array(*[F.struct(F.lit(n).alias("name"), F.lit(k).alias("kind"), F.lit(o).cast("string").alias("first")) for n, k, o in asked])
    turns = read(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), body.alias("body"), questions.alias("questions"), F.lit(7.5).alias("latency_ms"))
    return d.cloud_batch(turns).select("id", "question", F.round("score", 6).alias("score"), "confidence", "latency_ms", "selected", "primitive")


# --- retrieval

_ROUTES = ", ".join(f"('{k}', {i}, '{t}')" for i, (k, t) in enumerate(retrieve.ROUTES))
_ASKED_ROUTES = "SELECT query_id, CASE query_id % 3 WHEN 0 THEN 'facts about one thing' WHEN 1 THEN 'how things connect ' || text ELSE text END AS text FROM questions"


@query(f"WITH {QUESTIONS}, q AS ({_ASKED_ROUTES}), o(k, ord, descr) AS (VALUES {_ROUTES}), s AS (SELECT query_id, k, row_number() OVER (PARTITION BY query_id ORDER BY {_score('text', 'descr')} DESC, ord) AS n FROM q, o) SELECT query_id, k AS route FROM s WHERE n = 1")
def route_intent(spark, sf_dir):
    q = _questions(spark, sf_dir)
    text = F.when(F.col("query_id") % 3 == 0, "facts about one thing").when(F.col("query_id") % 3 == 1, F.concat(F.lit("how things connect "), "text")).otherwise(F.col("text"))
    return retrieve.route(q.select("query_id", text.alias("text")))


_turned_of: dict[tuple[str, str], GraphStore] = {}


def _turned(spark, sf_dir):
    """The business graph with every edge turned round, laid out by source once an application."""
    key = spark.sparkContext.applicationId, sf_dir
    if key not in _turned_of:
        store = business_graph(spark, sf_dir)
        _turned_of[key] = replace(store, edges=store.edges.select(F.col("tgt").alias("src"), F.col("src").alias("tgt"), "rel_type"), adjacency=None).laid_out()
    return _turned_of[key]


def _suppliers(spark, sf_dir):
    """A question for each supplier, and the supplier as its seed."""
    k = F.col("s_suppkey").cast("long")
    return read(spark, sf_dir, "supplier").select(k.alias("query_id"), F.concat(F.lit("which part and orders go back to supplier "), k).alias("question"), F.concat(F.lit("supplier:"), k).alias("seed"))


_TREE = f"{GRAPH}, tree AS MATERIALIZED (SELECT tgt AS src, src AS tgt, rel_type, coalesce(pagerank, 0.0) AS pagerank FROM edges JOIN nodes ON name = src), top AS (SELECT s_suppkey::BIGINT AS query_id, 'which part and orders go back to supplier ' || s_suppkey::BIGINT AS question, 'supplier:' || s_suppkey::BIGINT AS seed FROM supplier)"


def _starts(spark, sf_dir):
    """A question for each order, and the order as its seed."""
    k = F.col("o_orderkey").cast("long")
    return read(spark, sf_dir, "orders").select(k.alias("query_id"), F.concat(F.lit("which part and customer belong to orders "), k).alias("question"), F.concat(F.lit("orders:"), k).alias("seed"))


_SE = f"{GRAPH}, st AS (SELECT o_orderkey::BIGINT AS query_id, 'which part and customer belong to orders ' || o_orderkey::BIGINT AS question, 'orders:' || o_orderkey::BIGINT AS seed FROM orders), se AS MATERIALIZED (SELECT query_id, question, seed, src, tgt, rel_type, coalesce(pagerank, 0.0) AS pagerank, {_score('question', EDGE_TEXT)} AS score FROM st JOIN edges ON src = seed JOIN nodes ON name = tgt)"


def _first_edges(spark, sf_dir):
    """Dealt by question once, for all that follows, in tasks that grow in number with the edges."""
    store = business_graph(spark, sf_dir)
    return retrieve.scored_edges(store, _starts(spark, sf_dir).withColumnRenamed("seed", "src"), most=True).repartition(store.tasks(), "query_id")


@query(f"{_SE} SELECT query_id, src, tgt, rel_type, pagerank, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, src, tgt, rel_type)::INT AS edge_ord FROM se WHERE score >= 0.6")
def bfs_gated(spark, sf_dir):
    return retrieve.bfs(business_graph(spark, sf_dir), _starts(spark, sf_dir).withColumnRenamed("seed", "src"), most=True)


@query(f"{GRAPH}, e AS (SELECT edges.*, coalesce(pagerank, 0.0) AS pagerank, {_score(repr(ASKED), EDGE_TEXT)} AS score FROM edges JOIN nodes ON name = tgt) SELECT src, tgt, round(0.65 * score + 0.25 * least(pagerank / 10.0, 1.0) - 0.1 * 2, 6) AS f FROM e")
def fscore(spark, sf_dir):
    store = graph_by_source(spark, sf_dir)
    front = store.nodes.select(F.lit(0).cast("long").alias("query_id"), F.lit(ASKED).alias("question"), F.col("name").alias("src"))
    return retrieve.scored_edges(store, front).select("src", "tgt", F.round(retrieve.f_score(F.col("score"), F.col("pagerank"), F.lit(2)), 6).alias("f"))


@query(f"{_TREE}, w AS (SELECT query_id, question, [seed] AS path, seed AS here, 0 AS depth, 1.0::DOUBLE AS f FROM top UNION ALL SELECT query_id, question, list_append(path, tgt), tgt, depth + 1, 0.65 * {_score('question', EDGE_TEXT)} + 0.25 * least(pagerank / 10.0, 1.0) - 0.1 * (depth + 1) FROM w JOIN tree ON src = here WHERE depth < 2) SELECT query_id, array_to_string(path, '>') AS path, round(f, 6) AS score, depth FROM w WHERE depth = 2 OR here NOT IN (SELECT src FROM tree)")
def bestfirst_tree(spark, sf_dir):
    """All paths of two steps against the edges, of every kind, from each supplier: each supplier is a search of its own."""
    return retrieve.two_steps(_turned(spark, sf_dir), _suppliers(spark, sf_dir)).select("query_id", F.array_join("path", ">").alias("path"), "score", "depth")


def _asked_orders(spark, sf_dir):
    """Every order as a seed of one question."""
    return _starts(spark, sf_dir).withColumn("question", F.lit(ASKED))


@query()
def bestfirst_general(spark, sf_dir):
    return retrieve.traverse(graph_by_source(spark, sf_dir), _asked_orders(spark, sf_dir))


def _beam_sql(depth: int) -> str:
    out, front = [], "(SELECT query_id, question, seed AS node, 1 AS n FROM top)"
    for i in range(1, depth + 1):
        out.append(f"b{i} AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY f DESC, node) AS n FROM (SELECT query_id, question, tgt AS node, max(round(0.65 * {_score('question', EDGE_TEXT)} + 0.25 * least(pagerank / 10.0, 1.0) - 0.1 * {i}, 6)) AS f FROM {front} x JOIN tree ON src = node WHERE n <= 3 GROUP BY query_id, question, tgt))")
        front = f"b{i}"
    return ", ".join(out) + " " + " UNION ALL ".join(f"SELECT query_id, {i} AS depth, node, f FROM b{i} WHERE n <= 3" for i in range(1, depth + 1))


@query(f"{_TREE}, {_beam_sql(2)}")
def beam_level(spark, sf_dir):
    return retrieve.beam(_turned(spark, sf_dir), _suppliers(spark, sf_dir), 2, 3)


@query()
def greedy(spark, sf_dir):
    return retrieve.walk_greedily(graph_by_source(spark, sf_dir), _asked_orders(spark, sf_dir), "region:3").select("query_id", "seed", "path")


@query()
def greedy_vs_best(spark, sf_dir):
    return retrieve.expansions(graph_by_source(spark, sf_dir), _asked_orders(spark, sf_dir), "region:3")


@query(f"{_SE}, p AS (SELECT query_id, seed || ' → ' || tgt AS way, 'order ' || query_id || ' of orders part ' || tgt AS question FROM se) SELECT query_id, way, round({_overlap('question', 'way')} * {_overlap('question', 'way')}, 6) AS p, {_overlap('question', 'way')} * {_overlap('question', 'way')} > 0.95 AS stops FROM p")
def early_exit(spark, sf_dir):
    way = F.array_join(F.array("src", "tgt"), " → ")
    question = F.concat(F.lit("order "), F.col("query_id"), F.lit(" of orders part "), F.col("tgt"))
    p = d.noul(d.probabilities(d.lexical(question, way)))
    return _first_edges(spark, sf_dir).select("query_id", way.alias("way"), F.round(p, 6).alias("p"), (p > 0.95).alias("stops"))


# --- after the traversal


@query(f"{_SE}, p AS (SELECT query_id, seed, row_number() OVER (PARTITION BY query_id ORDER BY tgt) - 1 AS po, [seed, tgt] AS path, score FROM se), e AS (SELECT query_id, seed, po, score, unnest([0, 1]) AS pos, unnest(path) AS name FROM p), f AS (SELECT *, row_number() OVER (PARTITION BY query_id, name ORDER BY seed, po, pos) AS n FROM e) SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY seed, po, pos) - 1 AS ord, name, round(score * pow(0.9, pos), 6) AS score FROM f WHERE n = 1")
def paths_to_nodes(spark, sf_dir):
    p = d.ranked(_first_edges(spark, sf_dir), ["query_id"], F.col("tgt")).select("query_id", F.col("src").alias("seed"), (F.col("rank") - 1).alias("path_ord"), F.array("src", "tgt").alias("path"), "score")
    return post.paths_to_nodes(p).select("query_id", F.col("ord").cast("long").alias("ord"), "name", "score")


_NODES = f"{_SE}, ed AS (SELECT query_id, question, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, tgt) AS eo, src, tgt, score FROM se), e AS (SELECT query_id, question, eo, score, unnest([0, 1]) AS pos, unnest([src, tgt]) AS name FROM ed), f AS (SELECT *, row_number() OVER (PARTITION BY query_id, name ORDER BY eo, pos) AS n FROM e), no AS (SELECT query_id, question, row_number() OVER (PARTITION BY query_id ORDER BY eo, pos) - 1 AS ord, name, score FROM f WHERE n = 1)"
_RANKED = f"{_NODES}, sc AS (SELECT query_id, ord, name, {_score('question', 'name')} AS score, count(*) OVER (PARTITION BY query_id) AS n FROM no), rr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, ord) AS k FROM sc), kept AS (SELECT * FROM rr WHERE k <= greatest(1, floor(n * 0.8 + 1e-9)))"


def _context_nodes(spark, sf_dir):
    return post.edges_to_nodes(d.ranked(_first_edges(spark, sf_dir), ["query_id"], F.desc("score"), F.col("tgt")).withColumnRenamed("rank", "edge_ord"))


def _reranked(spark, sf_dir):
    asked = _starts(spark, sf_dir).select("query_id", d.lexical.prepare(F.col("question")).alias("asked"))
    return post.rerank(_context_nodes(spark, sf_dir).join(asked, "query_id"), F.col("asked"), ready=True)


@query(f"{_NODES} SELECT query_id, ord, name, score FROM no")
def edges_to_nodes(spark, sf_dir):
    return _context_nodes(spark, sf_dir).select("query_id", F.col("ord").cast("long").alias("ord"), "name", "score")


@query(f"{_RANKED} SELECT query_id, k AS rank, name, score FROM kept")
def rerank(spark, sf_dir):
    return _reranked(spark, sf_dir).select("query_id", F.col("rank").cast("long").alias("rank"), "name", "score")


@query(f"{_RANKED} SELECT query_id, string_agg(name || ': ' || name, ' | ' ORDER BY k) AS context FROM kept WHERE k <= 10 GROUP BY query_id")
def format_context(spark, sf_dir):
    return post.context(_reranked(spark, sf_dir), dense=True)


@query(f"{_RANKED}, b AS (SELECT query_id, string_agg('- ' || name || ': ' || name, chr(10) ORDER BY k) AS text FROM kept GROUP BY query_id) SELECT query_id, coalesce(text, '(none found)') AS text FROM (SELECT query_id FROM st UNION SELECT -1) LEFT JOIN b USING (query_id)")
def format_bullets(spark, sf_dir):
    asked = _starts(spark, sf_dir).select("query_id").union(spark.createDataFrame([(-1,)], "query_id long"))
    return post.bullets(_reranked(spark, sf_dir), asked)


_CTX = f"{_RANKED}, c AS (SELECT query_id, string_agg(name || ': ' || name, ' | ' ORDER BY k) AS context FROM kept WHERE k <= 10 GROUP BY query_id), g AS (SELECT query_id, round({_overlap('context', 'claim')} * {_overlap('context', 'claim')}, 6) AS p FROM (SELECT *, 'orders ' || query_id || ' part customer' AS claim FROM c))"


def _claim():
    return F.concat(F.lit("orders "), "query_id", F.lit(" part customer"))


@query(f"{_CTX} SELECT query_id, p, p >= 0.5 AS passed FROM g")
def gate(spark, sf_dir):
    return post.check(format_context(spark, sf_dir), _claim(), 0.5).select("query_id", "p", "passed")


@query(f"{_CTX} SELECT query_id, p, p >= 0.9 AS passed FROM g")
def citations(spark, sf_dir):
    return post.check(post.context(_reranked(spark, sf_dir), post.CITED, dense=True), _claim(), 0.9).select("query_id", "p", "passed")


@query(f"{_CTX}, w AS (SELECT query_id, string_agg('- ' || name || ': ' || name, chr(10) ORDER BY k) AS whole FROM kept GROUP BY query_id) SELECT query_id, CASE WHEN p < 0.5 THEN 'not enough evidence' ELSE CASE WHEN p >= 0.9 THEN '' ELSE '[UNVERIFIED] ' END || whole END AS answer FROM g JOIN w USING (query_id)")
def answer_local(spark, sf_dir):
    """The gate reads the first ten nodes, the answer is made of all that are kept.  The nodes lie in buckets of their
    question, as they are dealt, so nothing that follows deals them again."""
    asked, tasks = _starts(spark, sf_dir), business_graph(spark, sf_dir).tasks()
    nodes = spark.table(bucketed(_reranked(spark, sf_dir), "query_id", tasks))
    kept = post.settled(nodes, asked)
    c = post.check(post.context(kept, dense=True), _claim(), 0.5).join(post.bullets(kept, asked), "query_id")
    return c.select("query_id", F.when(~F.col("passed"), F.lit("not enough evidence")).otherwise(F.concat(F.when(F.col("p") >= 0.9, F.lit("")).otherwise(F.lit("[UNVERIFIED] ")), F.col("text"))).alias("answer"))


_TWO = "n AS (SELECT 0::BIGINT AS query_id, source || ' ' || lang AS name, doc_id AS ord, text FROM documents), t AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY ord, text) AS k FROM n), p AS (SELECT query_id, name, max(text) FILTER (k = 1) AS a, max(text) FILTER (k = 2) AS b FROM t WHERE k <= 2 GROUP BY ALL HAVING count(*) = 2)"
_WHAT = "the of and was der und"


def _two(spark, sf_dir):
    name = F.concat_ws(" ", "source", "lang")
    docs = read(spark, sf_dir, "documents").where("source is not null and lang is not null")
    return post.conflicts(docs.select(F.lit(0).cast("long").alias("query_id"), name.alias("name"), F.col("doc_id").alias("ord"), "text"))


@query(f"WITH {_TWO} SELECT * FROM p")
def conflicts(spark, sf_dir):
    return _two(spark, sf_dir)


def _fit(own: str, other: str) -> str:
    return _score(f"concat_ws(' ', '{_WHAT}', substr({other}, 1, 300))", f"substr({own}, 1, 100)")


_FITS = f"f AS (SELECT *, {_fit('a', 'b')} AS x, {_fit('b', 'a')} AS y FROM p)"


@query(f"WITH {_TWO}, {_FITS} SELECT query_id, name, CASE WHEN x >= y THEN a ELSE b END AS winner FROM f")
def resolve_conflicts(spark, sf_dir):
    return post.resolve(_two(spark, sf_dir), F.lit(_WHAT))


@query(f"WITH {_TWO}, {_FITS} SELECT query_id, name, CASE WHEN x >= y THEN 'a' ELSE 'b' END AS selected, round(greatest(x, y) / CASE WHEN x + y = 0 THEN 1.0 ELSE x + y END, 6) AS confidence FROM f")
def conflict_log(spark, sf_dir):
    return post.conflict_log(_two(spark, sf_dir), F.lit(_WHAT)).select("query_id", "name", "selected", "confidence")


# --- comparison of scorers


def _tri(x: str) -> str:
    return f"list_distinct(list_transform(range(1, greatest(length({x}) - 1, 1)), lambda i: substr(lower({x}), i, 3)))"


def _jaccard(x: str, y: str) -> str:
    return f"(len(list_intersect({_tri(x)}, {_tri(y)}))::DOUBLE / len(list_distinct(list_concat({_tri(x)}, {_tri(y)}))))"


_AB = f"SELECT id, a, b, round(abs(a - b), 4) AS delta FROM (SELECT item_id AS id, {_score('context', 'instruction')} AS a, round({_of(_jaccard('context', 'instruction'))}, 6) AS b FROM ({_PAIRS}) WHERE context IS NOT NULL)"


@query(_AB)
def ablation_compare(spark, sf_dir):
    return post.compare(_prompts(spark, sf_dir)).select("id", "a", "b", "delta")


@query(f"SELECT count(*) AS n, round(avg(delta), 4) AS mean_delta, round(max(delta), 4) AS max_delta, round(avg((delta < 0.05)::INT::DOUBLE), 3) AS agreement, round(avg(id % 7), 1) AS ms_a, round(avg(id % 5), 1) AS ms_b, NULL::VARCHAR AS error FROM ({_AB})")
def ablation_log_stats(spark, sf_dir):
    """The log is written as JSON lines, read again and summed up."""
    path = f"{own_dir(spark)}/log-{uuid.uuid4().hex}"
    timed = _prompts(spark, sf_dir).withColumns({"latency_a": (F.col("id") % 7).cast("double"), "latency_b": (F.col("id") % 5).cast("double")})
    post.write_log(post.harness(timed), path)
    return post.comparison_stats(post.read_log(spark, path))


@query(f"SELECT id, a AS score, greatest(id % 7, id % 5)::DOUBLE AS latency_ms FROM ({_AB})")
def ablation_primary(spark, sf_dir):
    timed = _prompts(spark, sf_dir).withColumns({"latency_a": (F.col("id") % 7).cast("double"), "latency_b": (F.col("id") % 5).cast("double")})
    return post.primary(post.harness(timed)).select("id", "score", "latency_ms")


_TRIGRAM_CHOICE = _choice_sql(_of(_jaccard("context", _WITH_OPTION)))


@query(f"""WITH {_PR}, x AS (SELECT id, {_overlap('context', 'instruction')} AS p, {_jaccard('context', 'instruction')} AS q FROM pr), c AS ({_LEXICAL_CHOICE}), t AS ({_TRIGRAM_CHOICE}),
  r AS (SELECT id, 'score' AS primitive, round({_of('p')}, 6) AS a, round({_of('q')}, 6) AS b, NULL::VARCHAR AS selected_a, NULL::VARCHAR AS selected_b FROM x UNION ALL SELECT id, 'noul', round(p * p, 6), round(q * q, 6), NULL, NULL FROM x
    UNION ALL SELECT id, 'choice', round(c.s, 6), round(t.s, 6), c.k, t.k FROM c JOIN t USING (id))
  SELECT id, primitive, a, b, round(abs(a - b), 4) AS delta, selected_a, selected_b FROM r""")
def ab_prompts(spark, sf_dir):
    out = None
    for primitive in ("score", "noul", "choice"):
        one = post.harness(_prompts(spark, sf_dir), primitive, _PICK if primitive == "choice" else None)
        one = one.select("id", "primitive", "a", "b", "delta", F.col("detail_a.selected").alias("selected_a"), F.col("detail_b.selected").alias("selected_b"))
        out = one if out is None else out.unionByName(one)
    return out


@query("WITH e AS (SELECT event_type, count(*) AS n, round(avg(value), 6) AS mean FROM events GROUP BY event_type) SELECT * FROM e")
def log_by_kind(spark, sf_dir):
    return read(spark, sf_dir, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("value"), 6).alias("mean"))


# --- whole ways


@query()
def communities(spark, sf_dir):
    return algorithms.communities(business_graph(spark, sf_dir).edges)


@query()
def ingest_graph(spark, sf_dir):
    nodes = engine.build(read(spark, sf_dir, "documents")).nodes
    return nodes.select("name", "label", F.col("props")["chunks"].cast("long").alias("chunks"), F.round("pagerank", 9).alias("pagerank"), "community_id")


@query()
def answer_routed(spark, sf_dir):
    s = read(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("long").alias("query_id"), F.concat(F.lit("supplier "), "s_suppkey", F.lit(" nation "), "s_nationkey").alias("about"))
    how = F.when(F.col("query_id") % 3 == 0, F.lit("")).when(F.col("query_id") % 3 == 1, F.lit("how things connect ")).otherwise(F.lit("a summary "))
    # Word overlap supports little of a question, so the gate is lower than a model's.
    return engine.answer(graph_by_source(spark, sf_dir), s.select("query_id", F.concat(how, "about").alias("text")), config=EngineConfig(gate=0.2))
