"""URL filtering by host-suffix and path-prefix rules (operator 2), in DataFrame functions alone."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower, narrowed, table

#: Rules up to this many are broadcast; more of them are joined by a shuffle, salted.
MOST_BROADCAST = 50_000
SALTS = 16

#: The rules of the registered query.
RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]


def host(url: Column) -> Column:
    return ascii_lower(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")))


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def _digest(expression: Column) -> Column:
    return F.sha2(expression, 256)


def _expression(h: Column, p: Column) -> Column:
    """Host and path in one string; no host holds a slash, so a NUL after it keeps them apart."""
    return F.concat(h, F.lit("\0"), p)


def judge(pages: DataFrame, rules: Sequence[tuple[str, str, str]], prefix: int = 8, default: str = "allow") -> DataFrame:
    """Columns page_id, host, path, rule, verdict, for each row of `pages` (page_id, url).

    Each host is expanded into its suffixes at label borders, up to as many labels as the longest rule host has, and
    each path into its prefixes of the lengths that rules have, so no url has more expressions than the rules allow.  The expressions meet the rules on the first `prefix` hex digits of their SHA-256; the whole digest confirms.
    The longest rule wins; of rules equally long the one with the longer host, then a block before an allow.  A url
    that is null, empty or without :// has an empty host and path, which no rule with a path fits: `default`.  A null
    page_id stays null; repeated rows are each returned; other columns are ignored; without rules all get `default`.
    """
    spark = pages.sparkSession
    # Rules in the order in which they win: the later one of those that fit.
    ordered = sorted({(len(h) + len(p), len(h), v == "block", h, p, v) for h, p, v in rules})
    own = spark.createDataFrame([(k, *r[3:]) for k, r in enumerate(ordered)], "rank int, rule_host string, rule_path string, rule_verdict string")
    lengths = sorted({len(p) for _, p, _ in rules}) or [0]
    most_labels = max((h.count(".") + 1 for h, _, _ in rules), default=1)
    digest = _digest(_expression(F.col("rule_host"), F.col("rule_path")))
    own = own.select(digest.substr(1, prefix).alias("short"), digest.alias("whole"), "rank", F.concat("rule_host", "rule_path").alias("rule"), F.col("rule_verdict").alias("verdict"))
    found = own.select("short", "whole", "rank")

    # Repeated rows become one row with a count, and so does whatever is equal before the shuffle.
    base = narrowed(pages, "page_id", "url").select("page_id", host(F.col("url")).alias("host"), path(F.col("url")).alias("path"))
    base = base.groupBy("page_id", "host", "path").agg(F.count(F.lit(1)).alias("copies"))
    labels = F.split("host", r"\.", -1)
    suffixes = F.transform(F.sequence(F.greatest(F.lit(1), F.size(labels) - most_labels + 1), F.size(labels)), lambda k: F.array_join(F.slice(labels, k, F.size(labels)), "."))
    fitting = F.filter(F.array(*[F.lit(n) for n in lengths]), lambda n: n <= F.length("path"))
    both = F.flatten(F.transform(suffixes, lambda h: F.transform(fitting, lambda n: _expression(h, F.substring(F.col("path"), F.lit(1), n)))))
    each = base.select("*", F.explode_outer(both).alias("expression")).withColumn("digest", _digest(F.col("expression"))).withColumn("short", F.substring("digest", 1, prefix))
    few = len(rules) <= MOST_BROADCAST
    if few:
        met = each.join(F.broadcast(found), "short", "left")
    else:  # a frequent host's expression is dealt over several tasks
        salted = found.withColumn("salt", F.explode(F.array(*[F.lit(i) for i in range(SALTS)])))
        met = each.withColumn("salt", F.pmod(F.xxhash64("page_id", "path"), F.lit(SALTS)).cast("int")).join(salted, ["short", "salt"], "left")
    best = met.groupBy("page_id", "host", "path", "copies").agg(F.max(F.when(F.col("whole") == F.col("digest"), F.col("rank"))).alias("rank"))
    named = own.select("rank", "rule", "verdict")
    return best.join(F.broadcast(named) if few else named, "rank", "left").select(
        "page_id", "host", "path", "rule", F.coalesce("verdict", F.lit(default)).alias("verdict"),
        F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("_copy"),
    ).drop("_copy")


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """judge() of every row of `pages` by the five fixed rules; null, empty, repeated and extra input as there."""
    return judge(table(spark, sf_dir, "pages"), RULES)


ORACLE = r"""
WITH u AS (SELECT page_id, CASE WHEN url IS NULL OR position('://' IN url) = 0 THEN '' ELSE substr(url, position('://' IN url) + 3) END AS rest FROM pages),
h AS (SELECT page_id, regexp_extract(rest, '^[^/?#]*') AS raw, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
b AS (SELECT row_number() OVER () AS k, page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, path FROM h),
r(rh, rp, v) AS (VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
m AS (SELECT b.*, rh || rp AS rule, v, row_number() OVER (PARTITION BY k ORDER BY length(rh || rp) DESC NULLS LAST, length(rh) DESC NULLS LAST) AS n
      FROM b LEFT JOIN r ON (b.host = rh OR ends_with(b.host, '.' || rh)) AND starts_with(b.path, rp))
SELECT page_id, host, path, rule, coalesce(v, 'allow') AS verdict FROM m WHERE n = 1
"""
