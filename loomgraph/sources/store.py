"""Property graphs as DataFrames: scans, upserts, deletes, vector search."""

from __future__ import annotations

import uuid
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .adjacency import NAMED, Adjacency

EDGE = ["src", "tgt", "rel_type"]
NODES_SCHEMA = "name string, label string, props map<string,string>, pagerank double, community_id bigint"
EDGES_SCHEMA = "src string, tgt string, rel_type string, props map<string,string>"
EMBEDDINGS_SCHEMA = "name string, embedding array<double>"
_VERSIONS = "_versions"


def merged(old: Column, new: Column) -> Column:
    """Old properties with new ones over them."""
    none = F.create_map().cast("map<string,string>")
    old, new = F.coalesce(old, none), F.coalesce(new, none)
    return F.map_concat(F.map_filter(old, lambda k, _: ~F.map_contains_key(new, k)), new)


def _order(new: DataFrame) -> Column:
    return F.col("ord") if "ord" in new.columns else F.lit(0)


def latest(new: DataFrame, keys: list[str], *values: str) -> DataFrame:
    """One row a key: of rows with one key the later by `ord` wins, value by value, where it has one; equally late ones
    by the greater value.  Their props are merged likewise, key by key.  Rows without a key are left out.

    Each value and each property is an aggregate of its own, combined before the shuffle: a key that is repeated many
    times never stands in one row.
    """
    known = new.where(" and ".join(f"{k} is not null" for k in keys)).withColumn("_ord", _order(new))
    best = [F.max_by(v, F.when(F.col(v).isNotNull(), F.struct("_ord", v))).alias(v) for v in values]
    heads = known.groupBy(*keys).agg(*(best or [F.count(F.lit(1)).alias("_n")]))
    if "props" not in new.columns:
        return heads.select(*keys, *values)
    each = known.select(*keys, "_ord", F.explode("props").alias("_k", "_v"))
    one = each.groupBy(*keys, "_k").agg(F.max_by("_v", F.struct("_ord", "_v")).alias("_v"))
    props = one.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("_k", "_v"))).alias("props"))
    return heads.join(props, keys, "left").select(*keys, *values, "props")


@dataclass(frozen=True)
class GraphStore:
    """nodes(name, label, props, pagerank, community_id), edges(src, tgt, rel_type, props), embeddings(name, embedding).
    Names are unique among nodes and embeddings, (src, tgt, rel_type) among edges.  Changes return a new store."""

    nodes: DataFrame
    edges: DataFrame
    embeddings: DataFrame | None = None
    #: The edges by source, where they were laid out; a store that changes its edges or ranks goes on without.
    adjacency: Adjacency | None = None

    def laid_out(self) -> GraphStore:
        """The same store with its edges laid out by source, for many fetches."""
        return replace(self, adjacency=Adjacency.build(self.nodes, self.edges))

    @classmethod
    def empty(cls, spark: SparkSession) -> GraphStore:
        return cls(*(spark.createDataFrame([], x) for x in (NODES_SCHEMA, EDGES_SCHEMA, EMBEDDINGS_SCHEMA)))

    @classmethod
    def create(cls, spark: SparkSession, path: str) -> GraphStore:
        """The store at `path`; an empty one is written there if there is none."""
        if not _listed(spark, path):
            cls.empty(spark).save(path)
        return cls.open(spark, path)

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> GraphStore:
        """The newest whole version at `path`."""
        names = _listed(spark, path)
        if not names:
            raise FileNotFoundError(f"no graph at {path}")
        at = f"{path}/{names[-1]}"
        return cls(*(spark.read.schema(k).parquet(f"{at}/{t}") for t, k in (("nodes", NODES_SCHEMA), ("edges", EDGES_SCHEMA), ("embeddings", EMBEDDINGS_SCHEMA))))

    def save(self, path: str) -> None:
        """Write a version of its own beside the older ones, which open plans may still read; it counts once it is
        whole.  vacuum() removes the older ones."""
        spark = self.nodes.sparkSession
        known = _listed(spark, path)
        name = f"v{int(known[-1][1:11]) + 1 if known else 0:010d}-{uuid.uuid4().hex[:8]}"
        vectors = self.embeddings if self.embeddings is not None else spark.createDataFrame([], EMBEDDINGS_SCHEMA)
        for t, df, kind in (("nodes", self.nodes, NODES_SCHEMA), ("edges", self.edges, EDGES_SCHEMA), ("embeddings", vectors, EMBEDDINGS_SCHEMA)):
            columns = spark.createDataFrame([], kind).schema
            df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in columns]).write.parquet(f"{path}/{name}/{t}")
        fs, mark = _files(spark, f"{path}/{_VERSIONS}/{name}")
        fs.create(mark, True).close()

    def duplicates(self) -> DataFrame:
        """kind, key, n: keys that stand in more than one row."""
        nodes = self.nodes.groupBy("name").count().where("count > 1").select(F.lit("node").alias("kind"), F.col("name").alias("key"), F.col("count").alias("n"))
        edges = self.edges.groupBy(*EDGE).count().where("count > 1").select(F.lit("edge").alias("kind"), F.concat_ws(" ", *EDGE).alias("key"), F.col("count").alias("n"))
        return nodes.unionByName(edges)

    def upsert_nodes(self, new: DataFrame) -> GraphStore:
        """new(name, label, props[, ord]): a known name keeps what the new rows lack; of repeated names see latest()."""
        a, b = self.nodes.alias("a"), latest(new, ["name"], "label").alias("b")
        out = a.join(b, "name", "full_outer").select(
            "name", F.coalesce("b.label", "a.label").alias("label"), merged(F.col("a.props"), F.col("b.props")).alias("props"), "a.pagerank", "a.community_id")
        return replace(self, nodes=out, adjacency=None)

    def upsert_edges(self, new: DataFrame) -> GraphStore:
        """new(src, tgt, rel_type, props[, ord]): edges whose ends are not both nodes are left out; of repeated keys see
        latest()."""
        names = self.nodes.select("name")
        one = latest(new, EDGE)
        held = one.join(names.withColumnRenamed("name", "src"), "src", "left_semi").join(names.withColumnRenamed("name", "tgt"), "tgt", "left_semi")
        a, b = self.edges.alias("a"), held.alias("b")
        return replace(self, edges=a.join(b, EDGE, "full_outer").select(*EDGE, merged(F.col("a.props"), F.col("b.props")).alias("props")), adjacency=None)

    def delete_edges(self, gone: DataFrame) -> GraphStore:
        return replace(self, edges=self.edges.join(gone.select(*EDGE), EDGE, "left_anti"), adjacency=None)

    def set_embeddings(self, new: DataFrame) -> GraphStore:
        """new(name, embedding[, ord]): for names that are nodes; of repeated names see latest()."""
        known = latest(new, ["name"], "embedding").join(self.nodes.select("name"), "name", "left_semi").where("embedding is not null")
        if self.embeddings is None:
            return replace(self, embeddings=known)
        out = self.embeddings.alias("a").join(known.alias("b"), "name", "full_outer").select("name", F.coalesce("b.embedding", "a.embedding").alias("embedding"))
        return replace(self, embeddings=out)

    def neighbors(self, frontier: DataFrame) -> DataFrame:
        """Outgoing edges of frontier(src): target, type, and the target's PageRank (0 if none)."""
        return self.edges_of(frontier.select("src").distinct()).select("src", "tgt", "rel_type", "pagerank")

    def tasks(self) -> int:
        """In how many tasks all edges are dealt, so that none of them grows with the graph."""
        if self.adjacency is not None:
            return self.adjacency.buckets
        return max(int(self.edges.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-self.edges.count() // NAMED))

    def edges_of_most(self, frontier: DataFrame) -> DataFrame:
        """edges_of() for a frontier of a large part of all nodes that is fetched once: no layout is made for it, and the
        edges meet the ranks before they meet the frontier, whose rows are wider."""
        tasks = self.tasks()
        # Ranks that are dealt into so many tasks bring the edges into as many, unless they are few enough to broadcast.
        ranks = self.nodes.select(F.col("name").alias("tgt"), F.coalesce("pagerank", F.lit(0.0)).alias("pagerank")).repartition(tasks, "tgt")
        known = self.edges.where("src is not null").select("src", "tgt", "rel_type").join(ranks, "tgt").repartition(tasks, "src")
        return frontier.join(known, "src").select(*frontier.columns, "tgt", "rel_type", "pagerank")

    def edges_of(self, frontier: DataFrame) -> DataFrame:
        """Outgoing edges of frontier(src, ...) with all its columns: tgt, rel_type, pagerank (0 if none)."""
        if self.adjacency is not None:
            return self.adjacency.edges_of(frontier)
        ranks = self.nodes.select(F.col("name").alias("tgt"), F.coalesce("pagerank", F.lit(0.0)).alias("pagerank"))
        return frontier.join(self.edges.select("src", "tgt", "rel_type"), "src").join(ranks, "tgt").select(*frontier.columns, "tgt", "rel_type", "pagerank")

    def edge_scan(self, limit: int) -> DataFrame:
        return self.edges.select(*EDGE).orderBy(*EDGE).limit(limit)

    def digraph(self) -> DataFrame:
        return self.edges.select("src", "tgt").distinct()


def _files(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def _listed(spark: SparkSession, path: str) -> list[str]:
    """The whole versions at a path, oldest first."""
    fs, p = _files(spark, f"{path}/{_VERSIONS}")
    return sorted(x.getPath().getName() for x in fs.listStatus(p)) if fs.exists(p) else []


def vacuum(spark: SparkSession, path: str, keep: int = 1) -> None:
    """Remove all but the newest `keep` versions, for when no plan reads the others any more, and what a save that did
    not end has left."""
    names = _listed(spark, path)
    for name in names[:-keep]:
        fs, mark = _files(spark, f"{path}/{_VERSIONS}/{name}")
        fs.delete(mark, False)
    fs, top = _files(spark, path)
    for x in fs.listStatus(top) if names else []:
        if x.getPath().getName() not in (_VERSIONS, *names[-keep:]):
            fs.delete(x.getPath(), True)
