"""python -m loomgraph ingest < text: its chunks.
python -m loomgraph ask GRAPH QUESTION [--max-depth N]: an answer over the graph saved in a folder.
python -m loomgraph query NAME DIR: a registered query's rows."""

import argparse
import sys

from pyspark.sql import SparkSession


def ask(spark: SparkSession, graph: str, question: str, max_depth: int = 4) -> str:
    """The answer to one question over a saved graph."""
    from dataclasses import replace

    from loomgraph.config import DEFAULT
    from loomgraph.operators import engine
    from loomgraph.sources.factory import open_store

    asked = spark.createDataFrame([(0, question)], "query_id long, text string")
    return engine.answer(open_store(spark, "parquet", graph), asked, config=replace(DEFAULT, max_depth=max_depth)).first().answer


def main(args: list[str]) -> int:
    top = argparse.ArgumentParser(prog="python -m loomgraph", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    ways = top.add_subparsers(dest="way", required=True)
    ways.add_parser("ingest")
    one = ways.add_parser("ask")
    one.add_argument("graph")
    one.add_argument("question")
    one.add_argument("--max-depth", type=int, default=4)
    registered = ways.add_parser("query")
    registered.add_argument("name")
    registered.add_argument("dir")
    given = top.parse_args(args)
    spark = SparkSession.builder.getOrCreate()
    if given.way == "ingest":
        from loomgraph.operators.ingest import chunks

        docs = spark.createDataFrame([(0, sys.stdin.read())], "doc_id long, text string")
        for r in chunks(docs).orderBy("chunk_idx").toLocalIterator():
            print(f"[{r.chunk_idx}] {r.chunk}")
    elif given.way == "ask":
        print(ask(spark, given.graph, given.question, given.max_depth))
    else:
        from loomgraph.plans.queries import QUERIES

        QUERIES[given.name](spark, given.dir).show(50, truncate=False)
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
