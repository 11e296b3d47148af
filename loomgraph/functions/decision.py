"""Decision primitives as columns: score, yes-probability and choice, by a lexical and a trigram scorer.

A scorer is a function of two string columns that returns a share in [0, 1]; a model can stand in as a pandas UDF of
the same shape.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.config import DEFAULT
from loomgraph.tables import written

Scorer = Callable[[Column, Column], Column]


def words(text: Column) -> Column:
    return F.array_distinct(F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda t: t != ""))


def trigrams(text: Column) -> Column:
    t = F.lower(text)
    at = F.when(F.length(t) >= 3, F.sequence(F.lit(1), F.length(t) - 2)).otherwise(F.array().cast("array<int>"))
    return F.array_distinct(F.transform(at, lambda i: F.substring(t, i, F.lit(3))))


def lexical(context: Column, instruction: Column) -> Column:
    """The share of the instruction's words that the context has; 0 without words."""
    n = F.size(words(instruction))
    return F.coalesce(F.when(n > 0, F.size(F.array_intersect(words(context), words(instruction))) / n), F.lit(0.0))


def _shared(context: Column, instruction: Column) -> Column:
    """lexical() of two word sets that are made already."""
    n = F.size(instruction)
    return F.coalesce(F.when(n > 0, F.size(F.array_intersect(context, instruction)) / n), F.lit(0.0))


#: A scorer with these two is evaluated once per text, then once per pair.
lexical.prepare, lexical.compare = words, _shared


def overlapped(rows: DataFrame, context: Column, instruction: Column, scorer: Scorer, ready: bool = False) -> DataFrame:
    """rows with the scorer's share of each as _o.  ready: the context is prepared already, where the scorer prepares.

    Each step is a column of its own, and the share passes through a generator of one row: no filter or sum that uses it
    is moved to where it would be worked out anew at each use."""
    if getattr(scorer, "prepare", None):
        made = rows.withColumns({"_c": context if ready else scorer.prepare(context), "_i": scorer.prepare(instruction)})
        share = made.select(*[F.col(f"`{c}`") for c in rows.columns if c != "_c"], scorer.compare(F.col("_c"), F.col("_i")).alias("_share"))
    else:
        share = rows.withColumn("_share", scorer(context, instruction))
    return share.select("*", F.explode(F.array("_share")).alias("_o")).drop("_share")


def trigram(context: Column, instruction: Column) -> Column:
    """Jaccard similarity of character trigrams; 0 without any."""
    a, b = trigrams(context), trigrams(instruction)
    n = F.size(F.array_union(a, b))
    return F.coalesce(F.when(n > 0, F.size(F.array_intersect(a, b)) / n), F.lit(0.0))


def probabilities(o: Column) -> Column:
    """Of an overlap: the chances of the three classes."""
    return F.struct((o * o).alias("critical"), (2 * o * (1 - o)).alias("tangential"), ((1 - o) * (1 - o)).alias("irrelevant"))


def score(p: Column) -> Column:
    """Critical counts whole, tangential half."""
    return p["critical"] + 0.5 * p["tangential"]


def noul(p: Column) -> Column:
    """Yes-probability: critical alone."""
    return p["critical"]


def confidence(p: Column) -> Column:
    return F.greatest(p["critical"], p["tangential"], p["irrelevant"])


def choose(asked: DataFrame, key: str, options: DataFrame, context: Column, instruction: Column, scorer: Scorer = lexical) -> DataFrame:
    """The best of a few options (option, ord, description) for each row: option, best, confidence = best / sum, raw_probs
    (each option's score).

    Options are a bounded list, so they become literals of the plan: no join and no shuffle.  The first of equally good
    ones wins; a sum of 0 counts as 1.
    """
    listed = options.orderBy("ord").collect()
    if not listed:
        raise ValueError("a choice needs options")
    prepare, compare = getattr(scorer, "prepare", None), getattr(scorer, "compare", scorer)
    made = prepare or (lambda text: text)
    asked_columns, n = asked.columns, len(listed)
    # Columns, not an array with lambdas, so that all of it is compiled and a scorer is asked once for each option.
    shares = asked.withColumn("_context", made(context)).select(*asked_columns, *[compare(F.col("_context"), made(F.concat_ws(" ", instruction, F.lit(r.description)))).alias(f"_o{i}") for i, r in enumerate(listed)])
    scores = shares.select(*asked_columns, *[score(probabilities(F.col(f"_o{i}"))).alias(f"_s{i}") for i in range(n)])
    s = [F.col(f"_s{i}") for i in range(n)]
    with_sum = scores.withColumns({"_best": F.greatest(*s) if n > 1 else s[0], "_sum": sum(s, F.lit(0.0))})
    option = F.lit(listed[0].option)
    for i in reversed(range(n)):
        option = F.when(s[i] == F.col("_best"), F.lit(listed[i].option)).otherwise(option)
    probs = F.create_map(*[x for i, r in enumerate(listed) for x in (F.lit(r.option), F.round(s[i], 4))])
    return with_sum.select(*asked_columns, probs.alias("raw_probs"), option.alias("option"), F.col("_best").alias("best"), (F.col("_best") / F.when(F.col("_sum") == 0, F.lit(1.0)).otherwise(F.col("_sum"))).alias("confidence"))


def ask(kind: Column, p: Column, selected: Column | None = None) -> Column:
    """One question of a batch as (answer, selected): score and noul give a number, choice the option; any other kind
    stops the query."""
    unknown = F.raise_error(F.concat(F.lit("unknown kind of question: "), F.coalesce(kind, F.lit("null"))))
    choice = kind == "choice"
    return F.struct(
        F.when(kind == "score", score(p)).when(kind == "noul", noul(p)).when(choice, F.lit(None).cast("double")).otherwise(unknown.cast("double")).alias("answer"),
        F.when(choice, selected if selected is not None else F.lit(None).cast("string")).alias("selected"),
    )


# --- details


def label_score(probs: Column) -> Column:
    """Of a map label -> probability: critical, true and yes count whole, tangential half, every other label nothing."""
    weight = lambda k: F.when(k.isin("critical", "true", "yes"), 1.0).when(k == "tangential", 0.5).otherwise(0.0)
    return F.aggregate(F.map_entries(probs), F.lit(0.0), lambda s, e: s + e["value"] * weight(e["key"]))


def label_noul(probs: Column) -> Column:
    """Of a map label -> probability: critical, true and yes count whole, every other label nothing."""
    return F.aggregate(F.map_entries(probs), F.lit(0.0), lambda s, e: s + F.when(e["key"].isin("critical", "true", "yes"), e["value"]).otherwise(0.0))


def softmax(logits: Column) -> Column:
    """Shares of an array of logits; the greatest is taken off first, so none overflows."""
    top = F.array_max(logits)
    return F.transform(logits, lambda x: F.exp(x - top) / F.aggregate(logits, F.lit(0.0), lambda s, y: s + F.exp(y - top)))


def labelled(logits: Column, labels: Sequence[str]) -> Column:
    """A model's logits as a map label -> probability."""
    return F.map_from_arrays(F.array(*[F.lit(x) for x in labels]), softmax(logits))


def as_map(p: Column) -> Column:
    return F.create_map(*[x for k in ("irrelevant", "tangential", "critical") for x in (F.lit(k), p[k])])


def detailed(value: Column, conf: Column, probs: Column, backend: str, primitive: str, selected: Column | None = None, latency_ms: Column | None = None) -> Column:
    """A decision with all that is known of it: score, confidence, raw_probs (4 digits), latency_ms (null for a scorer
    that is a column of the plan), backend, primitive, selected."""
    return F.struct(
        value.cast("double").alias("score"), conf.cast("double").alias("confidence"), F.transform_values(probs, lambda _, v: F.round(v, 4)).alias("raw_probs"),
        (latency_ms if latency_ms is not None else F.lit(None)).cast("double").alias("latency_ms"), F.lit(backend).alias("backend"), F.lit(primitive).alias("primitive"),
        (selected if selected is not None else F.lit(None)).cast("string").alias("selected"),
    )


def decide(context: Column, instruction: Column, backend: str = "lexical", primitive: str = "score") -> Column:
    """score or noul by a named scorer, detailed."""
    p = probabilities(scorer_named(backend)(context, instruction))
    if primitive not in ("score", "noul"):
        raise ValueError(f"not a primitive of one pair: {primitive!r}")
    return detailed(score(p) if primitive == "score" else noul(p), confidence(p), as_map(p), backend, primitive)


# --- scorers by name

_SCORERS: dict[str, Scorer] = {}


def register(name: str, scorer: Scorer) -> None:
    """Make a scorer, such as a model behind a pandas UDF, known by a name."""
    _SCORERS[name] = scorer


def scorer_named(name: str) -> Scorer:
    if name not in _SCORERS:
        raise ValueError(f"unknown scorer: {name!r}")
    return _SCORERS[name]


register("lexical", lexical)
register("trigram", trigram)


# --- answers of a remote service

_RAW = "map<string,double>"


def cloud_score(answer: Column, fallback: float = DEFAULT.fallback_score) -> Column:
    """A rubric answer 0 to 3 in JSON; what is missing or unreadable counts as the fallback."""
    raw = F.get_json_object(answer, "$.score").try_cast("double")
    return F.when(raw.isNull(), F.lit(fallback)).otherwise(F.least(raw / 3, F.lit(1.0)))


def cloud_noul(answer: Column, fallback: float = DEFAULT.fallback_score) -> Column:
    return F.coalesce(F.get_json_object(answer, "$.probability").try_cast("double"), F.lit(fallback))


def cloud_choice(answer: Column, options: Sequence[str]) -> Column:
    return F.coalesce(F.get_json_object(answer, "$.selected"), F.lit(options[0]))


def cloud_detailed(answer: Column, kind: Column, first: Column, fallback: float = DEFAULT.fallback_score, latency_ms: Column | None = None) -> Column:
    """A remote answer in JSON, decoded by the kind of its question; null for a kind that is unknown.

    score: its confidence, or 0.  noul: the probability is the confidence, and yes and no are the raw ones.  choice: the
    selected option, or the first; its confidence, or its probability, or 0, is the score too.  An answer that can't be
    read at all gives the fallback with confidence 0 and no latency; a choice then the first option with 0.
    """
    readable = F.coalesce(F.try_parse_json(answer).isNotNull(), F.lit(False)) & F.ltrim(answer).startswith("{")
    probs = F.coalesce(F.from_json(F.get_json_object(answer, "$.probabilities"), _RAW), F.create_map().cast(_RAW))
    said = F.get_json_object(answer, "$.confidence").try_cast("double")
    p, picked = cloud_noul(answer, fallback), F.coalesce(F.get_json_object(answer, "$.selected"), first)
    chosen = F.coalesce(said, F.try_element_at(probs, picked), F.lit(0.0))
    none = F.create_map().cast(_RAW)
    value = F.when(kind == "score", cloud_score(answer, fallback)).when(kind == "noul", p).when(readable, chosen).otherwise(F.lit(0.0))
    conf = F.when(~readable, F.lit(0.0)).when(kind == "score", F.coalesce(said, F.lit(0.0))).when(kind == "noul", p).otherwise(chosen)
    raw = F.when(~readable, none).when(kind == "noul", F.create_map(F.lit("yes"), p, F.lit("no"), 1 - p)).otherwise(probs)
    took = F.when(readable, latency_ms if latency_ms is not None else F.lit(None).cast("double")).otherwise(F.lit(0.0))
    out = F.struct(
        value.alias("score"), conf.alias("confidence"), F.transform_values(raw, lambda _, v: F.round(v, 4)).alias("raw_probs"), took.alias("latency_ms"), F.lit("cloud").alias("backend"),
        kind.alias("primitive"), F.when(kind == "choice", F.when(readable, picked).otherwise(first)).alias("selected"))
    return F.when(kind.isin("score", "noul", "choice"), out)


def cloud_batch(answers: DataFrame, fallback: float = DEFAULT.fallback_score) -> DataFrame:
    """id, question, and the decision: one row for each question of answers(id, body, questions, latency_ms), where
    questions is an array of (name, kind, first option) and body is one JSON answer for all of them, by name.

    Questions of unknown kinds are dropped; a question without an answer counts as an empty one; a body that can't be
    read gives each question the fallback, and a choice its first option.
    """
    each = answers.select("id", "body", "latency_ms", F.inline("questions").alias("question", "kind", "first"))
    readable = F.coalesce(F.try_parse_json("body").isNotNull(), F.lit(False)) & F.ltrim("body").startswith("{")
    of = F.from_json(F.get_json_object("body", "$.questions"), "map<string,string>")
    one = F.when(readable, F.coalesce(F.try_element_at(of, F.col("question")), F.lit("{}")))
    found = each.withColumn("_d", cloud_detailed(one, F.col("kind"), F.col("first"), fallback, F.col("latency_ms"))).where("_d is not null")
    # A whole batch that failed has the fallback as the score of choices too.
    value = F.when(readable, F.col("_d.score")).otherwise(F.lit(fallback))
    return found.select("id", "question", value.alias("score"), "_d.confidence", "_d.raw_probs", "_d.latency_ms", "_d.backend", "_d.primitive", "_d.selected")


class Cloud:
    """A remote decision service behind a transport: a function from a list of requests to a list of JSON answers, which
    runs in the workers.  Without a key there is no service."""

    def __init__(self, key: str | None, transport: Callable[[str, list[dict]], list[str]]):
        if not (key or "").strip():
            raise ValueError("the remote service needs a key")
        self.key, self.transport = key, transport

    def ask(self, asked: DataFrame) -> DataFrame:
        """asked(id, state, questions: array of (name, kind, first)) with body and latency_ms; a request that fails has a
        null body, which decodes as the fallback.  Rows are told apart by their request, not by their id: equal requests
        are sent once, and each row, repeated ids too, has its answer."""
        import time

        import pandas as pd

        key, transport = self.key, self.transport

        def run(frames):
            for f in frames:
                bodies, took = [], []
                for state, questions in zip(f["state"], f["questions"], strict=True):
                    began = time.perf_counter()
                    try:
                        body = transport(key, [{"state": state, "questions": [dict(q) if isinstance(q, dict) else q.asDict() for q in questions]}])[0]
                    except Exception:
                        body = None
                    bodies.append(body)
                    took.append(round(1000 * (time.perf_counter() - began), 2))
                yield pd.DataFrame({"request": f["request"], "body": bodies, "latency_ms": took})

        request = F.sha2(F.to_json(F.struct("state", "questions"), {"ignoreNullFields": "false"}), 256)
        keyed = asked.select("id", "questions", "state", request.alias("request"))
        distinct = keyed.groupBy("request").agg(F.first("state").alias("state"), F.first("questions").alias("questions"))
        # Written, so that no answer is asked for again when what follows is computed twice.
        answered = written(distinct.mapInPandas(run, "request string, body string, latency_ms double"))
        return keyed.select("id", "questions", "request").join(answered, "request").drop("request")


def ranked(df: DataFrame, partition: Sequence[str], *order: Column) -> DataFrame:
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*partition).orderBy(*order)))
