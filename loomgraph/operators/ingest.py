"""Documents to sentences, chunks, entities; edges to verified and normalised edges."""

from __future__ import annotations

import json
from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.functions import decision as d
from loomgraph.functions.text import WHITE, strip
from loomgraph.sources.store import EDGE, GraphStore
from loomgraph.sources.vectors import finite
from loomgraph.tables import written

#: Pairs of names (group, _part, a, b) to the same rows with a score.
Judge = Callable[[DataFrame], DataFrame]

# The keys of the relation ontology, in the order that settles ties; the last is the fallback.
ONTOLOGY_KEYS = [
    "EMPLOYED_BY", "FOUNDED", "MEMBER_OF", "LEADS", "DISCOVERED", "INVENTED", "PUBLISHED", "CONTRIBUTED_TO", "CAUSES", "PREVENTS", "INFLUENCES",
    "CORRELATES_WITH", "LOCATED_IN", "ORIGINATED_IN", "IS_A", "PART_OF", "RELATED_TO",
]
FALLBACK = "RELATED_TO"


def describe(key: str) -> str:
    """A key's words; a schema may bring descriptions of its own instead."""
    return key.lower().replace("_", " ")


ONTOLOGY = [(k, describe(k)) for k in ONTOLOGY_KEYS]


def sentences(text: Column) -> Column:
    """Cut after . ! ? and white space; stripped, without empty ones."""
    return F.filter(F.transform(F.split(text, rf"(?<=[.!?]){WHITE}+"), strip), lambda s: s != "")


def chunks(docs: DataFrame, threshold: float = 0.85, least: int = 2, scorer: d.Scorer = d.lexical) -> DataFrame:
    """doc_id, chunk_idx, chunk.  Between neighbours stands a border if they have little in common (1 - overlap >=
    threshold) and the chunk has `least` sentences; a text of at most `least` sentences stays one raw chunk; null text
    gives none.

    Everything happens inside one row, without a shuffle: neighbours are compared first, each sentence prepared once;
    the fold then only keeps the places of cuts.
    """
    s = docs.where("text is not null").select("doc_id", "text", sentences(F.col("text")).alias("s"))
    prepare, compare = getattr(scorer, "prepare", None), getattr(scorer, "compare", scorer)
    each = F.transform("s", prepare) if prepare else F.col("s")
    s = s.withColumn("n", F.size("s")).withColumn("w", each)
    before, after = F.slice("w", F.lit(1), F.greatest(F.col("n") - 1, F.lit(0))), F.slice("w", F.lit(2), F.greatest(F.col("n") - 1, F.lit(0)))
    apart = F.zip_with(before, after, lambda x, y: (1 - compare(x, y)) >= threshold)
    places = F.filter(F.transform(apart, lambda x, i: F.when(x, i + 1)), lambda i: i.isNotNull())
    start = F.struct(F.array(F.lit(0)).alias("cuts"), F.lit(0).alias("last"))
    fold = F.aggregate(places, start, lambda acc, i: F.when(i - acc["last"] >= least, F.struct(F.concat(acc["cuts"], F.array(i)).alias("cuts"), i.alias("last"))).otherwise(acc), lambda acc: acc["cuts"])
    s = s.withColumn("cuts", fold)
    ends = F.concat(F.slice("cuts", F.lit(2), F.size("cuts")), F.array("n"))
    spans = F.arrays_zip(F.col("cuts").alias("a"), ends.alias("b"))
    whole = F.when(F.col("n") <= least, F.array("text")).otherwise(F.transform(spans, lambda x: F.array_join(F.slice("s", x["a"] + 1, x["b"] - x["a"]), " ")))
    return s.select("doc_id", F.posexplode(whole).alias("chunk_idx", "chunk"))


def parse_names(raw: Column) -> Column:
    """The names in a model's answer: what a JSON list holds, as text, but for values that count as false (null, false, 0,
    empty ones); nothing of other JSON; else the parts between commas, quotes kept.  Null for no answer."""

    @F.pandas_udf("array<string>")
    def parse(answers: pd.Series) -> pd.Series:
        return answers.map(_names, na_action="ignore")

    return parse(raw)


def _names(answer: str) -> list[str]:
    try:
        found = json.loads(answer)
    except ValueError:
        return [x.strip() for x in answer.strip("[]").split(",") if x.strip()]
    return [str(x).strip() for x in found if x] if isinstance(found, list) else []


def capitalised(text: Column) -> Column:
    """Names without a model: runs of capitalised words, each once, in order."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit("[A-Z][a-z]+(?: [A-Z][a-z]+)+"), 0))


def cosine_pairs(vectors: DataFrame, group: str, threshold: float, keep_group: bool = False, slice_: int = 4096) -> DataFrame:
    """a < b of one group whose cosine exceeds the threshold, never across groups.

    Vectors travel in slices of about `slice_`, dealt by a hash of their id; slices of a group meet once, as matrix
    products, so a hot group is many tasks of bounded memory, and pairs below the threshold are never rows.  Vectors
    that are empty, or hold null or non-finite components, are like nothing; only those of one length are compared.
    """
    known = vectors.where(finite(F.col("embedding")) & F.col(group).isNotNull() & F.col("vec_id").isNotNull())
    sizes = known.groupBy(group).agg(F.ceil(F.count(F.lit(1)) / slice_).alias("_slices"))
    dealt = known.join(sizes, group).select(group, "_slices", F.pmod(F.xxhash64("vec_id"), F.col("_slices")).alias("_slice"), F.struct(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("v")).alias("row"))
    slices = written(dealt.groupBy(group, "_slices", "_slice").agg(F.collect_list("row").alias("rows")))
    left = slices.select(group, F.col("_slice").alias("s"), F.col("rows").alias("a"), F.explode(F.sequence(F.col("_slice"), F.col("_slices") - 1)).alias("t"))
    both = left.join(slices.select(group, F.col("_slice").alias("t"), F.col("rows").alias("b")), [group, "t"])
    kind = dict(vectors.dtypes)[group]

    def matrices(rows: pa.ListScalar) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
        flat = rows.values
        ids, v = flat.field("id").to_numpy(zero_copy_only=False), flat.field("v")
        lengths = v.value_lengths().to_numpy(zero_copy_only=False)
        out = {}
        for n in np.unique(lengths).tolist():
            own = np.flatnonzero(lengths == n)
            m = v.take(pa.array(own)).flatten().to_numpy(zero_copy_only=False).reshape(-1, n)
            out[n] = ids[own], m, np.sqrt((m * m).sum(axis=1))
        return out

    def compare(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                one, two, same = matrices(batch.column(2)[i]), matrices(batch.column(3)[i]), batch.column(1)[i].as_py()
                for n in one.keys() & two.keys():
                    (ids_a, a, len_a), (ids_b, b, len_b) = one[n], two[n]
                    for at in range(0, len(a), 512):  # no larger product than this at a time
                        sim = np.round(a[at : at + 512] @ b.T / (np.outer(len_a[at : at + 512], len_b) + 1e-9), 6)
                        x, y = np.nonzero(sim > threshold)
                        p, q = ids_a[at + x], ids_b[y]
                        if same:  # each pair stands on both sides of the diagonal
                            once = p < q
                            x, y, p, q = x[once], y[once], p[once], q[once]
                        yield pa.RecordBatch.from_arrays([pa.array([batch.column(0)[i].as_py()] * len(x), batch.schema.field(0).type), pa.array(np.minimum(p, q), pa.int64()), pa.array(np.maximum(p, q), pa.int64()), pa.array(sim[x, y])], names=[group, "a", "b", "sim"])

    found = both.select(group, (F.col("s") == F.col("t")).alias("same"), "a", "b").mapInArrow(compare, f"{group} {kind}, a long, b long, sim double")
    return found if keep_group else found.drop(group)


def should_merge(a: Column, b: Column, context: Column, scorer: d.Scorer = d.lexical) -> Column:
    """The yes-probability that two names of a context mean the same: whether the other name, and the first 300
    characters of the context with the name itself taken out, bear out the first."""
    around = F.replace(F.substring(F.coalesce(context, F.lit("")), 1, 300), a, F.lit(" "))
    return d.noul(d.probabilities(scorer(F.concat_ws(" ", b, around), a)))


#: Candidate pairs that one task folds at a time.
PART = 200_000


class Roots:
    """What names are called, as trees: a merge is one link, and looking up shortens the way."""

    def __init__(self) -> None:
        self.up: dict[str, str] = {}

    def of(self, name: str) -> str:
        top = name
        while (above := self.up.get(top, top)) != top:
            top = above
        while name != top:
            self.up[name], name = top, self.up[name]
        return top

    def join(self, loser: str, winner: str) -> None:
        self.up.setdefault(winner, winner)
        self.up[loser] = winner


def _fold(frame: pd.DataFrame, score: dict[tuple[str, str], float], least: float | None) -> list[tuple]:
    """(kind, a, b, score) of one block: kind 0 a merge of loser a into winner b, in order; 1 a name and what it is called
    at the end; 2 two names whose score is missing.

    A missing score is taken as too small, only to see which others will be asked for; with one the rest is not final.
    """
    roots, log, asked = Roots(), [], {}
    for r in frame.sort_values(["ord", "first", "second"]).itertuples():
        a, b = roots.of(r.a), roots.of(r.b)
        if a == b:
            continue
        if least is not None and (a, b) not in score:
            asked[a, b] = None
            continue
        p = r.score if least is None else score[a, b]
        if least is not None and not p >= least:  # a score that is null or no number merges nothing
            continue
        winner, loser = (a, b) if len(a) >= len(b) else (b, a)
        roots.join(loser, winner)
        log.append((0, loser, winner, p))
    if asked:
        return [(2, a, b, None) for a, b in asked]
    return log + [(1, name, roots.of(name), None) for name in list(roots.up)]


def _forest(pairs: DataFrame, group: str, most: int) -> DataFrame:
    """`pairs` without those whose names earlier ones connect anyway, where all candidates merge; no merge is lost.

    A pair that closes a ring with earlier ones never merges, in whatever part of the group the ring is found, so pairs
    are dealt over tasks, each keeps its own forest, and what is left is dealt again while that at least halves it.
    """

    def keep(frame: pd.DataFrame) -> pd.DataFrame:
        roots, kept = Roots(), []
        frame = frame.sort_values(["ord", "a", "b"], ignore_index=True)
        for i, (a, b) in enumerate(zip(frame["a"], frame["b"], strict=True)):
            a, b = roots.of(a), roots.of(b)
            if a != b:
                roots.join(a, b)
                kept.append(i)
        return frame.loc[kept, columns]

    columns, form = pairs.columns, pairs.schema
    sizes = lambda t: t.groupBy(group).agg(F.ceil(F.count(F.lit(1)) / most).alias("_deals")).where("_deals > 1")
    while True:
        large = written(sizes(pairs))
        before = large.agg(F.sum("_deals")).first()[0]
        if not before:
            return pairs
        dealt = pairs.join(large, group).withColumn("_deal", F.pmod(F.xxhash64("a", "b"), F.col("_deals")))
        fewer = dealt.groupBy(group, "_deal").applyInPandas(keep, form)
        pairs = written(pairs.join(large, group, "left_anti").select(*pairs.columns).unionByName(fewer))
        if 2 * (sizes(pairs).agg(F.sum("_deals")).first()[0] or 0) > before:
            return pairs


def _blocks(pairs: DataFrame, group: str, most: int) -> DataFrame:
    """`pairs` with _part and _turn: a group of more than `most` pairs is split into the parts that its pairs connect, and
    pairs of a part are cut by their order into blocks, which take turns.  A block is about `most` pairs at most."""
    sizes = written(pairs.groupBy(group).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > most))
    whole = pairs.join(sizes, group, "left_anti").withColumn("_part", F.lit("")).withColumn("_turn", F.lit(0))
    total = sizes.agg(F.sum("n")).first()[0]
    if not total:
        return whole
    from .algorithms import components

    node = lambda c: F.to_json(F.struct(group, c), {"ignoreNullFields": "false"})
    large = written(pairs.join(sizes, group, "left_semi").withColumn("_a", node(F.col("a").alias("name"))).withColumn("_b", node(F.col("b").alias("name"))))
    of = components(large.select(F.col("_a").alias("src"), F.col("_b").alias("tgt"))).select(F.col("name").alias("_a"), F.col("community").alias("_part"))
    ranged = large.join(of, "_a").drop("_a", "_b").repartitionByRange(int(-(-total // most)), "_part", "ord", "a", "b")
    blocks = written(ranged.withColumn("_block", F.spark_partition_id()))
    turns = blocks.select("_part", "_block").distinct()
    turns = turns.withColumn("_turn", F.row_number().over(Window.partitionBy("_part").orderBy("_block")) - 1)
    return whole.unionByName(blocks.join(turns, ["_part", "_block"]).drop("_block"))


def _settled(block: DataFrame, group: str, judge: Judge | None, least: float | None) -> DataFrame:
    """The rows of _fold() of one turn's blocks.  Scores are asked for as the fold comes to need them; blocks that need no
    more are done."""
    spark, key = block.sparkSession, [group, "_part"]
    kinds = dict(block.dtypes)
    form = f"{group} {kinds[group]}, _part string, kind int, a string, b string, score double"

    def fold(of: tuple, frame: pd.DataFrame, told: pd.DataFrame | None = None) -> pd.DataFrame:
        score = {} if told is None else dict(zip(zip(told["a"], told["b"], strict=True), told["score"], strict=True))
        return pd.DataFrame([(*of, *x) for x in _fold(frame, score, least)], columns=[*key, "kind", "a", "b", "score"])

    if judge is None:
        return written(block.groupBy(*key).applyInPandas(lambda of, frame: fold(of, frame), form))
    block = written(block)

    def scored(asked: DataFrame) -> DataFrame:
        asked = written(asked.distinct())
        return written(asked.join(judge(asked).select(*key, "a", "b", "score").dropDuplicates([*key, "a", "b"]), [*key, "a", "b"], "left"))

    known, done = scored(block.where("a <> b").select(*key, "a", "b")), spark.createDataFrame([], form)
    while True:
        out = written(block.groupBy(*key).cogroup(known.groupBy(*key)).applyInPandas(fold, form))
        done, asked = done.unionByName(out.where("kind < 2")), out.where("kind = 2").select(*key, "a", "b")
        if asked.isEmpty():
            return done
        still = written(asked.select(*key).distinct())
        block, known = block.join(still, key, "left_semi"), known.join(still, key, "left_semi").unionByName(scored(asked))


def merged(pairs: DataFrame, group: str, least: float | None = None, judge: Judge | None = None, most: int = PART) -> tuple[DataFrame, DataFrame]:
    """The greedy fold over each group's candidate pairs (ord, a, b, perhaps score), in order of ord, a and b: the merges
    (group, loser, winner, score), and (group, name, canonical), what each name of a merge is called after all of them.

    The longer canonical name wins, of equally long ones that of a.  Without a judge every candidate merges, under its
    own score.  With one a pair merges if the names that both are called by then score at least `least`: judge takes
    (group, _part, a, b) and returns its rows with a score; what it leaves out or scores as null does not merge, and no
    pair is judged that the fold does not come to.  Pairs with a null in group, ord, a or b are left out;
    ord is a number, a string or a time.

    The result is that of the sequential fold, but no task holds more than about `most` pairs: pairs that can't merge
    go first (_forest), a large group is split where no pair connects it, and a larger part takes turns in order.
    """
    if "score" not in pairs.columns:
        pairs = pairs.withColumn("score", F.lit(None).cast("double"))
    pairs = written(pairs.select(group, "ord", "a", "b", F.col("score").cast("double").alias("score")).dropna(subset=[group, "ord", "a", "b"]))
    key = [group, "_part"]
    blocks = written(_blocks(pairs if judge else _forest(pairs, group, most), group, most).withColumn("first", F.col("a")).withColumn("second", F.col("b")))
    logs, on = [], None
    for turn in range((blocks.agg(F.max("_turn")).first()[0] or 0) + 1):
        block = blocks.where(F.col("_turn") == turn).drop("_turn")
        if on is not None:
            for end in ("a", "b"):
                called = on.select(*key, F.col("name").alias(end), F.col("canonical").alias("_now"))
                block = block.join(called, [*key, end], "left").withColumn(end, F.coalesce("_now", end)).drop("_now")
        out = _settled(block, group, judge, least)
        logs.append(out.where("kind = 0"))
        step = out.where("kind = 1").select(*key, F.col("a").alias("name"), F.col("b").alias("canonical"))
        if on is not None:
            then = step.select(*key, F.col("name").alias("canonical"), F.col("canonical").alias("_now"))
            step = step.join(on, [*key, "name"], "left_anti").unionByName(on.join(then, [*key, "canonical"], "left").select(*key, "name", F.coalesce("_now", "canonical").alias("canonical")))
        on = written(step)
    log = logs[0]
    for more in logs[1:]:
        log = log.unionByName(more)
    return log.select(group, F.col("a").alias("loser"), F.col("b").alias("winner"), "score"), on.select(group, "name", "canonical")


def _table_judge(pairs: DataFrame, group: str, least: float | None) -> Judge | None:
    """A judge that knows the scores that stand in `pairs`, with an ord or without."""
    scores = pairs.select(group, "a", "b", "score").dropDuplicates([group, "a", "b"])
    return None if least is None else lambda asked: asked.join(scores, [group, "a", "b"])


def merge_names(pairs: DataFrame, group: str, least: float | None = None, most: int = PART) -> DataFrame:
    """group, loser, winner, score: the merges of merged() over pairs (ord, a, b, score); with `least`, rows without an
    ord give scores of pairs that the fold may meet."""
    return merged(pairs, group, least, _table_judge(pairs, group, least), most)[0]


def canonical_names(pairs: DataFrame, group: str, least: float | None = None, most: int = PART) -> DataFrame:
    """group, name, canonical: what each merged name is called after the same fold."""
    return merged(pairs, group, least, _table_judge(pairs, group, least), most)[1]


def merge_components(pairs: DataFrame) -> DataFrame:
    """name, canonical: the set form, for groups of any size: all names that merging pairs (a, b) connect are called by
    the longest of them, of equally long ones by the first.  It differs from the fold where only raw names are alike,
    not what they are called by then."""
    from .algorithms import components

    of = components(pairs.select(F.col("a").alias("src"), F.col("b").alias("tgt")))
    best = of.groupBy("community").agg(F.min_by("name", F.struct(-F.length("name"), "name")).alias("canonical"))
    return of.join(best, "community").select("name", "canonical")


def edge_text(src: Column, rel: Column, tgt: Column) -> Column:
    return F.concat_ws(" ", src, rel, tgt)


def verify(edges: DataFrame, context: Column, below: float = 0.3, scorer: d.Scorer = d.lexical) -> DataFrame:
    """Edges with their score and whether they are kept (score >= below)."""
    s = F.round(d.score(d.probabilities(scorer(context, edge_text(F.col("src"), F.col("rel_type"), F.col("tgt"))))), 6)
    return edges.withColumn("score", s).withColumn("kept", F.col("score") >= below)


def verification_stats(verified: DataFrame) -> DataFrame:
    return verified.agg(F.count(F.lit(1)).alias("total_checked"), F.count_if(~F.col("kept")).alias("pruned"), F.count_if("kept").alias("kept"))


def prune(store: GraphStore, context: Column, below: float = 0.3, limit: int | None = None, scorer: d.Scorer = d.lexical) -> tuple[GraphStore, DataFrame, DataFrame]:
    """The store without the edges that score less than `below`, those edges (src, tgt, rel_type, score), and the
    statistics of the run.  A limit checks the first so many edges by src, tgt and rel_type; the others stay."""
    checked = store.edge_scan(limit) if limit else store.edges.select(*EDGE)
    verified = written(verify(checked, context, below, scorer))
    pruned = verified.where(~F.col("kept")).select(*EDGE, "score")
    return store.delete_edges(pruned), pruned, verification_stats(verified)


def _aligned(relations: DataFrame, context: Column, least: float, ontology: list[tuple[str, str]], fallback: str, scorer: d.Scorer) -> DataFrame:
    spark = relations.sparkSession
    options = spark.createDataFrame([(k, i, t) for i, (k, t) in enumerate(ontology)], "option string, ord int, description string")
    best = d.choose(relations, relations.columns[0], options, context, F.lit(""), scorer)
    sure = F.round("confidence", 6)
    return best.select(*relations.columns, F.when(sure < least, F.lit(fallback)).otherwise(F.col("option")).alias("key"), sure.alias("confidence"))


def align(relations: DataFrame, least: float = 0.25, ontology: list[tuple[str, str]] = ONTOLOGY, fallback: str = FALLBACK, scorer: d.Scorer = d.lexical) -> DataFrame:
    """raw, key, confidence: the key of the ontology (pairs of key and description) that describes a raw relation best;
    the fallback below the least confidence.  Each distinct relation is scored once."""
    return _aligned(relations.select("raw").distinct(), F.lower(F.translate("raw", "_-", "  ")), least, ontology, fallback, scorer)


def align_edges(edges: DataFrame, least: float = 0.25, ontology: list[tuple[str, str]] = ONTOLOGY, fallback: str = FALLBACK, scorer: d.Scorer = d.lexical) -> DataFrame:
    """`edges` with all their columns, rel_type brought to the ontology.  The ends of an edge, where it has them, are
    read beside its relation; each edge is scored where it stands, so nothing is shuffled."""
    part = lambda c: F.nullif(F.trim(F.col(c)), F.lit(""))
    raw = F.lower(F.translate(F.coalesce("rel_type", F.lit("")), "_-", "  "))
    whole = edges.select(F.struct(*[F.col(f"`{c}`") for c in edges.columns]).alias("row"), "rel_type", "src", "tgt")
    found = _aligned(whole, F.concat_ws(" ", raw, part("src"), part("tgt")), least, ontology, fallback, scorer)
    return found.select(*[F.coalesce("key", F.lit(fallback)).alias(c) if c == "rel_type" else F.col("row")[c].alias(c) for c in edges.columns])
