"""Step tables in the shared folder: they cut lineage, so lost executors cost nothing that was computed before."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_swept_at_exit: set[str] = set()


def shared_dir(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names.  Where the session names none a local master gets a temporary one;
    on a cluster, whose executors would not see it, that is an error."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        named = tempfile.mkdtemp(prefix="loomgraph-")
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


def own_dir(spark: SparkSession) -> str:
    """One folder for an application's step tables, removed when the driver's Python ends."""
    path = f"{shared_dir(spark)}/loomgraph-{spark.sparkContext.applicationId}"
    if path not in _swept_at_exit:
        _swept_at_exit.add(path)
        atexit.register(_sweep_quietly, spark, path)
    return path


def _sweep_quietly(spark: SparkSession, path: str) -> None:
    try:
        drop(spark, path)
    except Exception:  # the JVM may be gone; whoever owns the shared folder clears it then
        pass


def cut(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """Write df as a step table and read it again.  Returns the table and its path, for drop()."""
    spark = df.sparkSession
    path = f"{own_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def drop(spark: SparkSession, *paths: str | None) -> None:
    """Remove step tables that no plan reads any more."""
    for path in paths:
        if path is not None:
            p = spark._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def written(df: DataFrame, name: str = "step") -> DataFrame:
    """cut() for tables that forget() removes."""
    out, path = cut(df, name)
    out.written_to = path
    return out


def forget(*tables: DataFrame | None) -> None:
    """Remove tables of written() that no plan reads any more."""
    for t in tables:
        if t is not None:
            drop(t.sparkSession, t.written_to)
