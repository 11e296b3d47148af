"""Edges laid out by their source in bucketed tables, so that a step over a graph never shuffles edges.

Buckets are by a hash of the source, as Spark shuffles the other side of a join, and sorted; a fetch for a few nodes
reads their buckets alone.  A bucket is one task, so the edges of hubs, which have more than a bucket's share of all
edges, lie apart and spread evenly: there are never more hubs than buckets.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.tables import forget, own_dir, written

#: Edges that a node has at least if it is to be a hub; names of a frontier that are few enough to choose buckets by.
HUB, FEW = 4096, 1000
#: Edges of a bucket, by name and by number: a task's memory doesn't grow with the graph.
NAMED, NUMBERED = 500_000, 2_000_000


def bucketed(rows: DataFrame, key: str, buckets: int) -> str:
    """Write rows in buckets of `key`, one file each; the table's name.  Its files lie in the shared folder.  Rows that
    are already dealt by the key into as many partitions are not shuffled again."""
    spark, name = rows.sparkSession, f"loomgraph_{uuid.uuid4().hex}"
    rows.sortWithinPartitions(key).write.bucketBy(buckets, key).sortBy(key).option("path", f"{own_dir(spark)}/{name}").saveAsTable(name)
    return name


def dealt(edges: DataFrame, key: str, buckets: int | None, least: int, most: int) -> tuple[int, list]:
    """How many buckets the edges need, where it is not given, so that none holds many more than `most`; and the sources
    of more than a bucket's share of all edges, so no more of them than buckets."""
    sizes = written(edges.groupBy(key).agg(F.count(F.lit(1)).alias("n")))
    total = sizes.agg(F.sum("n")).first()[0] or 0
    buckets = buckets or max(int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // most))
    found = [r[key] for r in sizes.where(F.col("n") > max(total / buckets, least)).select(key).collect()]
    forget(sizes)
    return buckets, found


_dealt = dealt  # the name it had when test_scale.py was written


@dataclass(frozen=True)
class Adjacency:
    """Outgoing edges by name: src, tgt, rel_type, pagerank; pagerank is the target's, 0 if it has none.  Edges whose
    target is no node are left out.  What was built stays as it is when the store changes."""

    spark: SparkSession
    table: str
    buckets: int
    hubs: tuple[str, ...]
    hub_edges: DataFrame

    @classmethod
    def build(cls, nodes: DataFrame, edges: DataFrame, buckets: int | None = None, least: int = HUB) -> Adjacency:
        spark = edges.sparkSession
        ranks = nodes.select(F.col("name").alias("tgt"), F.coalesce("pagerank", F.lit(0.0)).alias("pagerank"))
        known = edges.where("src is not null").select("src", "tgt", "rel_type")
        buckets, hubs = dealt(known, "src", buckets, least, NAMED)
        whole = known.join(ranks.repartition(buckets, "tgt"), "tgt").select("src", "tgt", "rel_type", "pagerank")
        apart = written(whole.where(F.col("src").isin(hubs)))
        return cls(spark, bucketed(whole.where(~F.col("src").isin(hubs)).repartition(buckets, "src"), "src", buckets), buckets, tuple(hubs), apart)

    def rows(self) -> DataFrame:
        return self.spark.table(self.table)

    def edges_of(self, frontier: DataFrame) -> DataFrame:
        """Outgoing edges of frontier(src, ...), with all its columns: tgt, rel_type, pagerank.

        The frontier goes to the edges' buckets; the edges stay where they are.  Of a few names only their buckets are
        read.  Whether they are few its first rows tell, so that a large frontier is not made twice."""
        first = frontier.select("src").limit(10 * FEW).collect()
        names = {r["src"] for r in first}
        rows = self.rows()
        if len(first) < 10 * FEW and len(names) <= FEW:
            rows = rows.where(F.col("src").isin([n for n in names if n is not None]))
        columns = [*frontier.columns, "tgt", "rel_type", "pagerank"]
        found = frontier.join(rows, "src").select(*columns)
        if not self.hubs:
            return found
        return found.unionByName(frontier.where(F.col("src").isin(list(self.hubs))).join(self.hub_edges, "src").select(*columns))

    def drop(self) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.table}")
        forget(self.hub_edges)


@dataclass(frozen=True)
class Links:
    """Distinct edges between numbered nodes: nodes(id, name) in a step table, and edges (id, to) in buckets of id.  Edges
    with a null end are left out; `both` lists each edge at both ends, and no loops.

    A number is a hash of the name, so edges are numbered without a join; should two names have one hash, all are
    numbered anew by another hash.
    """

    spark: SparkSession
    nodes: DataFrame
    table: str
    hubs: tuple[int, ...]
    hub_edges: DataFrame
    buckets: int

    @classmethod
    def build(cls, edges: DataFrame, both: bool = False, buckets: int | None = None, least: int = HUB, number=F.xxhash64) -> Links:
        spark = edges.sparkSession
        pairs = edges.select(F.col("src").alias("a"), F.col("tgt").alias("b")).where("a is not null and b is not null")
        ends, salt = written(pairs.select(F.explode(F.array("a", "b")).alias("name")).distinct()), 0
        while not ends.groupBy(number("name", F.lit(salt))).count().where("count > 1").isEmpty():
            salt += 1
        nodes = written(ends.select(number("name", F.lit(salt)).alias("id"), "name"))
        forget(ends)
        known = pairs.select(number("a", F.lit(salt)).alias("id"), number("b", F.lit(salt)).alias("to"))
        if both:
            known = known.where("id <> to").select(F.inline(F.array(F.struct("id", "to"), F.struct(F.col("to").alias("id"), F.col("id").alias("to")))))
        buckets, hubs = dealt(known, "id", buckets, least, NUMBERED)
        apart = written(known.where(F.col("id").isin(hubs)).distinct())
        # Dealt by id alone, repeated edges meet where they stay.
        return cls(spark, nodes, bucketed(known.where(~F.col("id").isin(hubs)).repartition(buckets, "id").distinct(), "id", buckets), tuple(hubs), apart, buckets)

    def rows(self) -> DataFrame:
        return self.spark.table(self.table).unionByName(self.hub_edges) if self.hubs else self.spark.table(self.table)

    def outgoing(self) -> DataFrame:
        """id, out: how many edges each node has that has any."""
        of = lambda rows: rows.groupBy("id").agg(F.count(F.lit(1)).alias("out"))
        return of(self.spark.table(self.table)).unionByName(of(self.hub_edges)) if self.hubs else of(self.spark.table(self.table))

    def sent(self, values: DataFrame, *what: Column) -> DataFrame:
        """to, and columns `what` made of those of values(id, ...): what each node sends along its edges.  The values are
        brought to the buckets; those of the hubs, no more than there are buckets, to wherever their edges are."""
        found = self.spark.table(self.table).join(values.hint("shuffle_hash"), "id").select("to", *what)
        if not self.hubs:
            return found
        few = F.broadcast(values.where(F.col("id").isin(list(self.hubs))))
        return found.unionByName(self.hub_edges.join(few, "id").select("to", *what))

    def drop(self) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.table}")
        forget(self.nodes, self.hub_edges)
