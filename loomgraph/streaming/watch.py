"""Streams: verification of edges as they arrive, and windowed statistics of a comparison log."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.operators.ingest import verify


def verified_stream(spark: SparkSession, path: str, schema: str, question: str, below: float = 0.3) -> DataFrame:
    """Edges of files that come into `path`, with score and whether they are kept."""
    return verify(spark.readStream.schema(schema).parquet(path), F.lit(question), below)


def windowed_stats(log: DataFrame, at: str = "ts", width: str = "10 minutes", late: str = "1 hour") -> DataFrame:
    """Count and mean of `value` by event time; rows later than `late` are left out."""
    return log.withWatermark(at, late).groupBy(F.window(at, width)).agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean")).select(F.col("window.start").alias("start"), "n", "mean")
