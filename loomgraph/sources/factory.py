"""Stores by name: where a graph lives is configuration."""

from __future__ import annotations

from pyspark.sql import SparkSession

from .store import GraphStore

DEFAULT_KIND = "parquet"
#: Other names of the kinds.
ALIASES = {"folder": "parquet", "tables": "views", "empty": "memory"}


def resolve(kind: str | None, fallback: str | None = None) -> str:
    """The kind that a setting names: blank means the fallback, and that the default; spelling and case don't count."""
    named = (kind or "").strip().lower() or (fallback or "").strip().lower() or DEFAULT_KIND
    return ALIASES.get(named, named)


def open_store(spark: SparkSession, kind: str | None = None, where: str = "", fallback: str | None = None) -> GraphStore:
    """A new handle each time.  parquet: the folder `where`, made if it is not there; views: the tables or views
    `where`_nodes, `where`_edges and, if there is one, `where`_embeddings; memory: an empty store."""
    found = resolve(kind, fallback)
    if found == "parquet":
        if not where:
            raise ValueError("a parquet store needs a folder")
        return GraphStore.create(spark, where)
    if found == "views":
        vectors = f"{where}_embeddings"
        return GraphStore(spark.table(f"{where}_nodes"), spark.table(f"{where}_edges"), spark.table(vectors) if spark.catalog.tableExists(vectors) else None)
    if found == "memory":
        return GraphStore.empty(spark)
    raise ValueError(f"unknown kind of store: {kind!r}")
