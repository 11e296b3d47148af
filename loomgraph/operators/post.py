"""From paths and edges to a checked context; side-by-side comparison of scorers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomgraph.config import DEFAULT
from loomgraph.functions import decision as d
from loomgraph.functions.text import strip
from loomgraph.tables import written


def paths_to_nodes(paths: DataFrame, decay: float = 0.9) -> DataFrame:
    """query_id, ord, name, text, score: each name at its first place; a path's score falls by hop.

    A question's seeds come in the order that they were selected in, seed_ord, where the paths have it, else by name."""
    at = ["seed_ord", "seed", "path_ord", "pos"] if "seed_ord" in paths.columns else ["seed", "path_ord", "pos"]
    each = paths.select("query_id", *at[:-1], F.col("score").alias("s"), F.posexplode("path").alias("pos", "name"))
    first = d.ranked(each, ["query_id", "name"], *[F.col(c) for c in at]).where("rank = 1")
    order = Window.partitionBy("query_id").orderBy(*at)
    return first.select("query_id", (F.row_number().over(order) - 1).alias("ord"), "name", F.col("name").alias("text"), F.round(F.col("s") * F.pow(F.lit(decay), F.col("pos")), 6).alias("score"))


def edges_to_nodes(edges: DataFrame) -> DataFrame:
    """Source, then target, of each edge (query_id, edge_ord, src, tgt, score), each name once, no empty ones."""
    each = edges.select("query_id", "edge_ord", "score", F.posexplode(F.array("src", "tgt")).alias("pos", "name")).where("name <> ''")
    at = F.col("edge_ord").cast("long") * 2 + F.col("pos")
    first = each.withColumn("_at", at).groupBy("query_id", "name").agg(F.min("_at").alias("_at"), F.min_by("score", "_at").alias("score"))
    order = Window.partitionBy("query_id").orderBy("_at")
    return first.select("query_id", (F.row_number().over(order) - 1).alias("ord"), "name", F.col("name").alias("text"), "score")


def rerank(nodes: DataFrame, question: Column, drop: float = 0.2, scorer: d.Scorer = d.lexical, ready: bool = False) -> DataFrame:
    """Scores nodes anew and keeps the best max(1, floor(n * (1 - drop))) of each query.  ready: the question is prepared
    by the scorer already, once for all of its nodes."""
    s = F.round(d.score(d.probabilities(F.col("_o"))), 6)
    new = d.ranked(d.overlapped(nodes, question, F.col("text"), scorer, ready).withColumn("score", s), ["query_id"], F.desc("score"), F.col("ord")).withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("query_id")))
    return new.where(F.col("rank") <= F.greatest(F.lit(1), F.floor(F.col("n") * F.lit(1 - drop) + F.lit(1e-9)))).select("query_id", F.col("rank").cast("int").alias("rank"), "name", "text", "score")


def conflicts(nodes: DataFrame) -> DataFrame:
    """Per query and name with several nodes: the texts of the first two by ord (or rank), of equal ones by text."""
    order = "ord" if "ord" in nodes.columns else "rank"
    two = d.ranked(nodes.select("query_id", "name", "text", F.col(order).alias("_at")), ["query_id", "name"], F.col("_at"), F.col("text")).where("rank <= 2")
    text = lambda n: F.max(F.when(F.col("rank") == n, F.col("text")))
    return two.groupBy("query_id", "name").agg(text(1).alias("a"), text(2).alias("b"), F.count(F.lit(1)).alias("n")).where("n = 2").drop("n")


#: Characters read of a text: by the gate and as an option, by the check of citations, and beside an option.
WIDTH, CITED, AROUND = 100, 80, 300


def conflict_log(pairs: DataFrame, question: Column, scorer: d.Scorer = d.lexical) -> DataFrame:
    """query_id, name, a, b, selected, confidence, winner: which text of conflicts() is borne out better by the question
    and the other text, the first of equals."""
    fit = lambda own, other: F.round(d.score(d.probabilities(scorer(F.concat_ws(" ", question, F.substring(other, 1, AROUND)), F.substring(own, 1, WIDTH)))), 6)
    first, second = fit("a", "b"), fit("b", "a")
    both = pairs.withColumns({"_a": first, "_b": second}).withColumn("selected", F.when(F.col("_a") >= F.col("_b"), "a").otherwise("b"))
    total = F.col("_a") + F.col("_b")
    sure = F.round(F.greatest("_a", "_b") / F.when(total == 0, F.lit(1.0)).otherwise(total), 6)
    return both.select("query_id", "name", "a", "b", "selected", sure.alias("confidence"), F.when(F.col("selected") == "a", F.col("a")).otherwise(F.col("b")).alias("winner"))


def resolve(pairs: DataFrame, question: Column, scorer: d.Scorer = d.lexical) -> DataFrame:
    """query_id, name, winner of conflict_log()."""
    return conflict_log(pairs, question, scorer).select("query_id", "name", "winner")


def settled(nodes: DataFrame, asked: DataFrame, scorer: d.Scorer = d.lexical) -> DataFrame:
    """Ranked nodes(query_id, rank, name, text, score) of asked(query_id, question) with one node for each name: of names
    that have several the node with the winning text comes after all others."""
    several = written(nodes.groupBy("query_id", "name").agg(F.count(F.lit(1)).alias("n")).where("n > 1").drop("n"))
    if several.isEmpty():  # nothing to settle, so nothing is joined
        return d.ranked(nodes.withColumnRenamed("rank", "_at"), ["query_id"], F.col("_at")).select("query_id", F.col("rank").cast("int").alias("rank"), "name", "text", "score")
    pairs = conflicts(nodes.join(several, ["query_id", "name"], "left_semi"))
    won = conflict_log(pairs.join(asked.select("query_id", "question"), "query_id"), F.col("question"), scorer).select("query_id", "name", "winner")
    same = nodes.join(won, ["query_id", "name"]).where(F.col("text").eqNullSafe(F.col("winner"))).drop("winner")
    winners = d.ranked(same.withColumnRenamed("rank", "_at"), ["query_id", "name"], F.col("_at")).where("rank = 1").drop("rank").withColumn("_late", F.lit(1))
    others = nodes.join(won, ["query_id", "name"], "left_anti").withColumnRenamed("rank", "_at").withColumn("_late", F.lit(0))
    return d.ranked(others.unionByName(winners), ["query_id"], F.col("_late"), F.col("_at")).select("query_id", F.col("rank").cast("int").alias("rank"), "name", "text", "score")


NOTHING = "(none found)"


def bullets(nodes: DataFrame, asked: DataFrame) -> DataFrame:
    """query_id, text: the nodes of each of asked(query_id) as lines in their order; a note where there are none."""
    line = F.concat(F.lit("- "), F.col("name"), F.lit(": "), F.coalesce("text", F.lit("")))
    order = "rank" if "rank" in nodes.columns else "ord"
    listed = nodes.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("at"), line.alias("line")))).alias("_l"))
    return asked.select("query_id").distinct().join(listed, "query_id", "left").select("query_id", F.coalesce(F.array_join(F.transform("_l", lambda x: x["line"]), "\n"), F.lit(NOTHING)).alias("text"))


def context(nodes: DataFrame, width: int = WIDTH, separator: str = " | ", dense: bool = False) -> DataFrame:
    """query_id, context: the first ten nodes, name: text, in order.  dense: their ranks are 1, 2, 3 and so on, as
    rerank() and settled() give them, so nothing is ranked anew.

    A line for each rank is a column of its own: a list would be hashed by question, then sorted once more."""
    ten = (nodes if dense else d.ranked(nodes, ["query_id"], F.col("rank") if "rank" in nodes.columns else F.col("ord"))).where("rank <= 10")
    line = F.concat(F.col("name"), F.lit(": "), F.substring("text", 1, width))
    lines = ten.select("query_id", "rank", line.alias("line")).groupBy("query_id").agg(*[F.max(F.when(F.col("rank") == n, F.col("line"))).alias(f"_{n}") for n in range(1, 11)])
    return lines.select("query_id", F.concat_ws(separator, *[f"_{n}" for n in range(1, 11)]).alias("context"))


def check(contexts: DataFrame, claim: Column, threshold: float, scorer: d.Scorer = d.lexical) -> DataFrame:
    """p, passed: whether the context supports the claim; an empty claim or context never passes."""
    p = F.round(d.noul(d.probabilities(F.col("_o"))), 6)
    empty = (strip(F.coalesce(claim, F.lit(""))) == "") | (F.coalesce(F.col("context"), F.lit("")) == "")
    shares = d.overlapped(contexts, F.col("context"), claim, scorer)
    return shares.withColumn("p", F.when(empty, F.lit(0.0)).otherwise(p)).withColumn("passed", ~empty & (F.col("p") >= threshold)).drop("_o")


LOG = (
    "timestamp string, primitive string, id long, context string, instruction string, a double, b double, delta double, primary string, "
    "detail_a struct<score:double,confidence:double,raw_probs:map<string,double>,latency_ms:double,backend:string,primitive:string,selected:string>, "
    "detail_b struct<score:double,confidence:double,raw_probs:map<string,double>,latency_ms:double,backend:string,primitive:string,selected:string>"
)


def harness(prompts: DataFrame, primitive: str = "score", options: list[tuple[str, str]] | None = None, a: str = "lexical", b: str = "trigram", main: str = "a") -> DataFrame:
    """prompts(id, context, instruction[, latency_a, latency_b]) decided by two scorers side by side, as rows of the log.

    choice needs options (pairs of key and description); an unknown primitive counts as score.  Context and instruction
    are kept to 200 characters; delta is the distance of both scores to 4 digits; of a choice, the score is that of the
    chosen option.
    """
    from pyspark.sql.types import StructType

    if primitive == "choice" and not options:
        raise ValueError("a choice needs options")
    primitive = primitive if primitive in ("noul", "choice") else "score"
    took = lambda side: F.col(f"latency_{side}") if f"latency_{side}" in prompts.columns else None
    found = prompts
    for side, name in (("a", a), ("b", b)):
        if primitive == "choice":
            listed = prompts.sparkSession.createDataFrame([(k, i, t) for i, (k, t) in enumerate(options)], "option string, ord int, description string")
            found = d.choose(found, "id", listed, F.col("context"), F.col("instruction"), d.scorer_named(name))
            detail = d.detailed(F.col("best"), F.col("confidence"), F.col("raw_probs"), name, primitive, F.col("option"), took(side))
            found = found.withColumn(f"detail_{side}", detail).drop("option", "best", "confidence", "raw_probs")
        else:
            p = d.probabilities(d.scorer_named(name)(F.col("context"), F.col("instruction")))
            value = d.score(p) if primitive == "score" else d.noul(p)
            found = found.withColumn(f"detail_{side}", d.detailed(F.round(value, 6), d.confidence(p), d.as_map(p), name, primitive, latency_ms=took(side)))
    score = lambda side: F.round(F.col(f"detail_{side}.score"), 6)
    now = F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSS")
    return found.select(
        now.alias("timestamp"), F.lit(primitive).alias("primitive"), F.col("id").cast("long").alias("id"), F.substring("context", 1, 200).alias("context"), F.substring("instruction", 1, 200).alias("instruction"),
        score("a").alias("a"), score("b").alias("b"), F.round(F.abs(score("a") - score("b")), 4).alias("delta"), F.lit(main).alias("primary"), "detail_a", "detail_b",
    ).to(StructType.fromDDL(LOG))


def compare(prompts: DataFrame) -> DataFrame:
    """id, context, instruction, a, b, delta of harness() for scores."""
    return harness(prompts).select("id", "context", "instruction", "a", "b", "delta")


def primary(log: DataFrame, name: str = "a") -> DataFrame:
    """id, score, selected and latency_ms of the primary scorer; any other name than a means b.  The latency is that of
    the slower of the two, which ran side by side; a choice without a selection has none."""
    side = "detail_a" if name == "a" else "detail_b"
    score = F.col("a") if name == "a" else F.col("b")
    return log.select("id", score.alias("score"), F.col(f"{side}.selected").alias("selected"), F.greatest("detail_a.latency_ms", "detail_b.latency_ms").alias("latency_ms"))


def write_log(log: DataFrame, path: str) -> None:
    """Append rows of harness() to a JSON-lines log; the folder is made if it is not there."""
    log.write.mode("append").json(path)


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """A log with all its variants: fields that a line lacks are null, blank lines are left out; none of a log that is
    not there."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p):
        return spark.createDataFrame([], LOG)
    return spark.read.schema(LOG).json(path).where("delta is not null")


def comparison_stats(log: DataFrame, agree: float = DEFAULT.agreement) -> DataFrame:
    """n, mean_delta, max_delta, agreement (the share below `agree`), ms_a, ms_b (mean latencies), error (of a log
    without rows, else null)."""
    found = log.agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg("delta"), 4).alias("mean_delta"), F.round(F.max("delta"), 4).alias("max_delta"), F.round(F.avg((F.col("delta") < agree).cast("double")), 3).alias("agreement"),
        F.round(F.avg("detail_a.latency_ms"), 1).alias("ms_a"), F.round(F.avg("detail_b.latency_ms"), 1).alias("ms_b"))
    return found.withColumn("error", F.when(F.col("n") == 0, F.lit("the log has no rows")))


def read_prompts(spark: SparkSession, path: str) -> DataFrame:
    """Prompts (id, context, instruction) of a JSON-lines file; one without an id gets a hash of its text."""
    rows = spark.read.schema("id long, context string, instruction string").json(path).where("context is not null and instruction is not null")
    return rows.withColumn("id", F.coalesce("id", F.xxhash64("context", "instruction")))


def write_table(df: DataFrame, path: str) -> None:
    """A result as CSV files with a header."""
    df.write.mode("overwrite").option("header", True).csv(path)
