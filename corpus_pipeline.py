"""A corpus from raw documents to packed sequences, in five stages.

Each stage reads what the one before wrote.  SQL can't express the classifier of the first one: tests hold every stage
against a brute-force version instead.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from loomgraph.llm import decontaminate, line_dedup, packing, simhash, toxicity
from loomgraph.llm.common import cut, drop, table

ORACLE_SQL = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is 0.3 or more go.  Null and empty texts are judged by the score of no words, and
    repeated rows alike; without labels nothing goes; columns of any name stay; an empty table stays empty."""
    return toxicity.without_toxic(docs, toxicity.from_labels(docs, table(spark, sf_dir, "labels")))


def drop_recurring_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of recurring templates go, but for the document with the smallest id; n_chars follows the text.  Every row
    stays; null texts stay null; rows of one id are one document; columns of any name stay; an empty table stays empty."""
    return line_dedup.without_recurring(docs, "n_chars" if "n_chars" in docs.columns else None)


def one_near_duplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document with the smallest id stays.  Texts without a word are one group; of
    repeated rows one stays; columns of any name stay; an empty table stays empty."""
    return simhash.one_of_each(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which a window of a benchmark item occurs go.  Null and empty texts stay; repeated rows are judged
    alike; without a benchmark nothing goes; columns of any name stay; an empty table stays empty."""
    return decontaminate.without_contaminated(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What is left is packed into sequences of 1024 tokens.  Null and empty texts are the token that ends a document;
    repeated rows are packed once each; other columns end here; an empty table gives no pieces."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_recurring_lines),
    ("simhash", one_near_duplicate),
    ("decontaminate", drop_contaminated),
    ("packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other over all documents, each but the last written and read again."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        docs, path = cut(stage(spark, docs, sf_dir), f"stage-{name}")
        drop(spark, before)
        before = path
    return STAGES[-1][1](spark, docs, sf_dir)
