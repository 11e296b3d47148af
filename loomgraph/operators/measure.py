"""Measurements: walks by hop, expanded nodes of two searches, memory while a query runs."""

from __future__ import annotations

import threading
import time
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.sources.store import GraphStore
from loomgraph.tables import written


def follow(store: GraphStore, seeds: DataFrame, hops: int = 4) -> DataFrame:
    """hop, src, node: from each of seeds(src) the first target by name, and so on, as long as there is one."""
    first = store.edges.groupBy("src").agg(F.min("tgt").alias("tgt"))
    now, out = seeds.select("src", F.col("src").alias("node")), None
    for hop in range(1, hops + 1):
        now = written(now.join(first.select(F.col("src").alias("node"), "tgt"), "node").select("src", F.col("tgt").alias("node")))
        step = now.select(F.lit(hop).alias("hop"), "src", "node")
        out = step if out is None else out.unionByName(step)
    return out


def hop_latency(store: GraphStore, seeds: DataFrame, hops: int = 4, repeats: int = 10) -> DataFrame:
    """hop, walks, mean_ms: the mean wall time of `repeats` walks of that many hops, for all seeds together, and how many
    of them get that far."""
    rows = []
    for hop in range(1, hops + 1):
        took = []
        for _ in range(repeats):
            began = time.perf_counter()
            walks = follow(store, seeds, hop).where(F.col("hop") == hop).count()
            took.append(1000 * (time.perf_counter() - began))
        rows.append((hop, walks, round(sum(took) / len(took), 3)))
    return store.edges.sparkSession.createDataFrame(rows, "hop int, walks long, mean_ms double")


def speedup(a: DataFrame, b: DataFrame) -> DataFrame:
    """hop, a_ms, b_ms, speedup = b / a of two measurements; infinite where a took no time."""
    both = a.select("hop", F.col("mean_ms").alias("a_ms")).join(b.select("hop", F.col("mean_ms").alias("b_ms")), "hop")
    return both.withColumn("speedup", F.when(F.col("a_ms") == 0, F.lit(float("inf"))).otherwise(F.col("b_ms") / F.col("a_ms")))


@dataclass
class MemoryWatch:
    """with MemoryWatch(spark, ceiling_mb) as w: the storage memory that executors use, every half second.

    peak_mb, mean_mb, and whether the ceiling was passed, are known at the end."""

    spark: SparkSession
    ceiling_mb: float
    every: float = 0.5
    seen: list[float] = field(default_factory=list)

    def _used_mb(self) -> float:
        status = self.spark._jsc.sc().getExecutorMemoryStatus()
        total, it = 0, status.valuesIterator()
        while it.hasNext():
            both = it.next()
            total += both._1() - both._2()
        return total / 1e6

    def _run(self) -> None:
        while not self._over.wait(self.every):
            self.seen.append(self._used_mb())

    def __enter__(self) -> MemoryWatch:
        self._over = threading.Event()
        self.seen.append(self._used_mb())
        self._thread = threading.Thread(target=self._run, daemon=True)
        self._thread.start()
        return self

    def __exit__(self, *_) -> None:
        self._over.set()
        self._thread.join()
        self.seen.append(self._used_mb())

    @property
    def peak_mb(self) -> float:
        return max(self.seen)

    @property
    def mean_mb(self) -> float:
        return sum(self.seen) / len(self.seen)

    @property
    def breached(self) -> bool:
        return self.peak_mb > self.ceiling_mb
