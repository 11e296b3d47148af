"""Routes, seeds and traversals, for many questions at once."""

from __future__ import annotations

import heapq
import pickle
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.config import DEFAULT, EngineConfig
from loomgraph.functions import decision as d
from loomgraph.sources.store import GraphStore
from loomgraph.tables import forget, written

from .ingest import edge_text

ROUTES = [("local", "facts about one named thing"), ("multi_hop", "how things connect over several steps"), ("global", "a summary of the whole collection")]
PATHS = "query_id long, seed string, path_ord int, path array<string>, score double, depth int, early_terminated boolean"


def route(questions: DataFrame, scorer: d.Scorer = d.lexical) -> DataFrame:
    """query_id, route for questions(query_id, text)."""
    options = questions.sparkSession.createDataFrame([(k, i, t) for i, (k, t) in enumerate(ROUTES)], "option string, ord int, description string")
    return d.choose(questions.select("query_id", "text"), "query_id", options, F.coalesce("text", F.lit("")), F.lit(""), scorer).select("query_id", F.coalesce("option", F.lit("multi_hop")).alias("route"))


def seeds(candidates: DataFrame, keep: int = 2, scorer: d.Scorer = d.lexical) -> DataFrame:
    """The best `keep` of candidates(query_id, question, name, ord) by their score against the question."""
    s = F.round(d.score(d.probabilities(scorer(F.col("question"), F.col("name")))), 6)
    return d.ranked(candidates.withColumn("score", s), ["query_id"], F.desc("score"), F.col("ord")).where(F.col("rank") <= keep).drop("rank")


def _scored(store: GraphStore, frontier: DataFrame, scorer: d.Scorer, most: bool = False) -> DataFrame:
    """Outgoing edges of frontier(question, src, ...) with all its columns and their score.  A question is taken apart
    once for all edges of a node."""
    prepare, text = getattr(scorer, "prepare", None), edge_text(F.col("src"), F.col("rel_type"), F.col("tgt"))
    near = (store.edges_of_most if most else store.edges_of)(frontier.withColumn("_c", prepare(F.col("question"))) if prepare else frontier)
    shares = d.overlapped(near, F.col("_c" if prepare else "question"), text, scorer, ready=prepare is not None)
    return shares.select(*[c for c in near.columns if c != "_c"], F.round(d.score(d.probabilities(F.col("_o"))), 6).alias("score"))


def scored_edges(store: GraphStore, frontier: DataFrame, scorer: d.Scorer = d.lexical, most: bool = False) -> DataFrame:
    """Outgoing edges of frontier(query_id, question, src) with their score.  most: the frontier is a large part of all
    nodes, see GraphStore.edges_of_most()."""
    return _scored(store, frontier.select("query_id", "question", "src"), scorer, most).select("query_id", "question", "src", "tgt", "rel_type", "pagerank", "score")


def bfs(store: GraphStore, frontier: DataFrame, keep: float = 0.6, scorer: d.Scorer = d.lexical, most: bool = False) -> DataFrame:
    """One hop: edges with a score of at least `keep`; edge_ord is their order for each question, the best first."""
    kept = scored_edges(store, frontier, scorer, most).where(F.col("score") >= keep).drop("question")
    if most or store.adjacency is not None:  # in tasks that don't grow with the graph
        kept = kept.repartition(store.tasks(), "query_id")
    return d.ranked(kept, ["query_id"], F.desc("score"), F.col("src"), F.col("tgt"), F.col("rel_type")).withColumnRenamed("rank", "edge_ord")


def f_score(s: Column, pagerank: Column, depth: Column, config: EngineConfig = DEFAULT) -> Column:
    return config.alpha * s + config.beta * F.least(F.coalesce(pagerank, F.lit(0.0)) / config.max_pagerank, F.lit(1.0)) - config.gamma * depth


Edges = dict[str, list[tuple[str, float, float]]]
#: What a step of a search may ask for next: (node whose edges it lacks or None, path that must be judged or None).
Want = tuple[str | None, list[str] | None]


class _Paged:
    """What a search knows of nodes' edges, which may come in pages, the best edges first.

    known: first pages of nodes that are not expanded yet, in order or whole; more: of nodes whose last page was not the
    last, where the next one begins; at: the depth by which such a first page is ordered; rest: later pages that came;
    asked: depth and place of the pages that a run() asked for.  Where the next page begins, an entry of the frontier
    without a node stands for all that is left.
    """

    FIELDS = ("heap", "visited", "known", "more", "at", "rest", "asked", "expanded")

    def __init__(self, start: str):
        self.heap: list[tuple] = [(-1.0, 0, 0, start, 0, (start,))]
        self.visited: dict[str, int] = {}
        self.known: Edges = {}
        self.more: dict[str, int] = {}
        self.at: dict[str, int] = {}
        self.rest: Edges = {}
        self.asked: dict[str, tuple[int, int]] = {}
        self.expanded = 0

    def learn(self, edges: Edges, judged: dict[tuple, bool]) -> None:
        """Whole lists of edges."""
        self.known.update((n, e) for n, e in edges.items() if n not in self.visited)

    def learn_page(self, node: str, edges: list[tuple], more: bool) -> None:
        """What came of a page that was asked for."""
        depth, start = self.asked[node]
        if start:
            self.rest[node] = edges
        else:
            self.known[node], self.at[node] = edges, depth
        if more:
            self.more[node] = start + len(edges)
        else:
            self.more.pop(node, None)

    def state(self) -> bytes:
        return pickle.dumps([getattr(self, f) for f in self.FIELDS], pickle.HIGHEST_PROTOCOL)

    def restore(self, state: bytes) -> None:
        self.__dict__.update(zip(self.FIELDS, pickle.loads(state), strict=True))

    def ready(self, node: str, depth: int) -> bool:
        """Whether a node's edges are at hand in the order that they have at this depth."""
        return node in self.known and (node not in self.more or self.at[node] == depth)

    def ask(self, node: str, depth: int) -> None:
        self.asked[node] = (depth, self.more[node] if node in self.visited else 0)


class BestFirst(_Paged):
    """A best-first search that can be put aside whenever it lacks something, and taken up again.

    known: edges of fetched nodes that are not expanded yet; judged: whether a path ends, of those that were asked for.
    Both only hold what the search still needs, so its state grows with the frontier, not with what it has seen.
    """

    FIELDS = (*_Paged.FIELDS, "out", "judged")

    def __init__(self, start: str, max_depth: int, max_paths: int, config: EngineConfig, judges: bool):
        super().__init__(start)
        self.max_depth, self.max_paths, self.config, self.judges = max_depth, max_paths, config, judges
        self.out: list[tuple] = []
        self.judged: dict[tuple, bool] = {}

    def learn(self, edges: Edges, judged: dict[tuple, bool]) -> None:
        super().learn(edges, judged)
        self.judged.update(judged)

    def lacks(self, node: str | None, depth: int, way: tuple) -> Want | None:
        if node is None:
            return None if way[-1] in self.rest else (way[-1], None)
        lack = (None if self.ready(node, depth) else node, list(way) if depth and self.judges and way not in self.judged else None)
        return lack if any(lack) else None

    def _step(self, guess: bool = False) -> None:
        """Take the first path off the frontier.  A guess takes it as if an unjudged path went on and an unfetched node
        added nothing, to see what would come next."""
        neg, _, _, node, depth, way = heapq.heappop(self.heap)
        if node is None:
            if not guess or way[-1] in self.rest:
                self._push(self.rest.pop(way[-1]), depth, way)
            return
        if depth >= self.max_depth:
            self.out.append((list(way), -neg, depth, False))
            return
        if node in self.visited or guess and not self.ready(node, depth):
            return
        self.visited[node] = len(self.visited)
        if depth and self.judges and self.judged.pop(way, False):
            self.out.append((list(way), -neg, depth, True))
            if not guess:
                self.known.pop(node, None)
            return
        near = self.known.pop(node) if not guess else self.known[node]
        if not near:
            self.out.append((list(way), -neg, depth, False))
            return
        self.expanded += 1
        self._push(near, depth, way)

    def _push(self, near: list[tuple], depth: int, way: tuple) -> None:
        """Put edges of the path's last node on the frontier.  What counts is which targets were visited when it was
        expanded, whenever its pages come.  Of equal priorities those of nodes that were expanded earlier come first."""
        c, time, f = self.config, self.visited[way[-1]], 0.0
        for i, (tgt, s, rank, *place) in enumerate(near):
            f = c.alpha * s + c.beta * min((rank or 0.0) / c.max_pagerank, 1.0) - c.gamma * (depth + 1)
            if self.visited.get(tgt, time + 1) > time:
                heapq.heappush(self.heap, (-f, time, place[0] if place else i, tgt, depth + 1, (*way, tgt)))
        if way[-1] in self.more:
            heapq.heappush(self.heap, (-f, time, (*near[-1][3], ""), None, depth, way))

    def run(self, ahead: int) -> list[Want]:
        """Go on as far as what is known allows; what to ask for then, nothing if the search is done."""
        self.asked = {}
        while self.heap and len(self.out) < self.max_paths:
            _, _, _, node, depth, way = self.heap[0]
            if depth < self.max_depth and node not in self.visited and self.lacks(node, depth, way):
                return self._wanted(ahead)
            self._step()
        return []

    def _wanted(self, ahead: int) -> list[Want]:
        """What the search lacks now, and would lack next if it went on by guesses; `ahead` of it at most.  Paths at the
        depth bound are certain results, so nothing that comes after as many of them as are still missing is fetched."""
        left = self.max_paths - len(self.out)
        certain = heapq.nsmallest(left, (e[0] for e in self.heap if e[4] >= self.max_depth)) if left <= len(self.heap) else []
        bound = certain[-1] if len(certain) == left else float("inf")
        self_ = object.__new__(BestFirst)
        self_.__dict__ = {**self.__dict__, "heap": self.heap[:], "visited": dict(self.visited), "rest": dict(self.rest), "out": self.out[:], "judged": dict(self.judged)}
        wanted: list[Want] = []
        while self_.heap and self_.heap[0][0] <= bound and len(wanted) < ahead:
            _, _, _, node, depth, way = self_.heap[0]
            if depth < self_.max_depth and node not in self_.visited and (lack := self_.lacks(node, depth, way)):
                # Of two depths that a node may be expanded at, the first to come is asked for; a page after one that is
                # only guessed to be used up is not.
                known = lack[0] in self.asked or node is None and (lack[0] not in self.visited or lack[0] in self.rest)
                if lack[0] is not None and not known:
                    self.ask(lack[0], depth)
                if lack[1] is not None or not known:
                    wanted.append(lack)
            self_._step(guess=True)
        return wanted


class _All(dict):
    """Every node's edges are known; a node that is not listed has none."""

    def __contains__(self, node) -> bool:
        return True

    def __missing__(self, node) -> list:
        return []

    def pop(self, node, *_) -> list:
        return self[node]


class _Judged(dict):
    """Every path is judged, by a function of its nodes."""

    def __init__(self, stop: Callable[[list[str]], bool]):
        super().__init__()
        self.stop = stop

    def __contains__(self, way) -> bool:
        return True

    def pop(self, way, *_) -> bool:
        return self.stop(list(way))


def best_first(edges: Edges, start: str, max_depth: int, max_paths: int, stop: Callable[[list[str]], bool] = lambda p: False, config: EngineConfig = DEFAULT) -> list[tuple[list[str], float, int, bool]]:
    """Paths in the order they come off the frontier.

    A path at the depth bound ends before its node counts as visited; a node is expanded once; a node without edges
    ends its path; one whose targets are all visited ends nothing.  Of equal priorities the earlier pushed comes first.
    """
    search = BestFirst(start, max_depth, max_paths, config, judges=False)
    search.judges, search.judged, search.known = True, _Judged(stop), _All(edges)
    search.run(1)
    return search.out


class Greedy(_Paged):
    """The greedy walk, put aside and taken up again like BestFirst."""

    FIELDS = (*_Paged.FIELDS, "way")

    def __init__(self, start: str, target: str, max_depth: int):
        super().__init__(start)
        self.target, self.max_depth, self.way = target, max_depth, []

    def _unknown(self, e: tuple) -> bool:
        if e[3] is None:
            return e[5][-1] not in self.rest
        return e[3] not in self.visited and e[3] != self.target and e[4] < self.max_depth and e[3] not in self.known

    def run(self, ahead: int) -> list[Want]:
        self.asked = {}
        while self.heap:
            if self._unknown(self.heap[0]):
                for e in heapq.nsmallest(ahead, self.heap):
                    if self._unknown(e):
                        self.ask(e[3] if e[3] is not None else e[5][-1], 0)
                return [(node, None) for node in self.asked]
            _, _, _, node, depth, way = heapq.heappop(self.heap)
            if node is None:
                self._push(self.rest.pop(way[-1]), depth, way)
                continue
            if node in self.visited:
                continue
            self.visited[node] = len(self.visited)
            if node == self.target or depth >= self.max_depth:
                self.way = list(way)
                return []
            self.expanded += 1
            self._push(self.known.pop(node), depth, way)
        return []

    def _push(self, near: list[tuple], depth: int, way: tuple) -> None:
        time = self.visited[way[-1]]
        for i, (tgt, s, _, *place) in enumerate(near):
            heapq.heappush(self.heap, (-s, time, place[0] if place else i, tgt, depth + 1, (*way, tgt)))
        if way[-1] in self.more:
            heapq.heappush(self.heap, (-near[-1][1], time, (*near[-1][3], ""), None, depth, way))


def greedy(edges: Edges, start: str, target: str, max_depth: int) -> list[str]:
    """By edge score alone; ends at the target or at the first node that comes off at the depth bound."""
    walk = Greedy(start, target, max_depth)
    walk.known = _All(edges)
    walk.run(1)
    return walk.way


def path_text(way: list[str]) -> str:
    return " → ".join(way)


#: Nodes that a search asks for at a time, at first and at most; what the searches of one lot ask for together, about.
AHEAD, MOST_AHEAD, WANTED = 8, 4096, 1 << 16
#: Searches of a lot, which share the pages that they ask for; edges of a first page.  A later page is as long as all
#: before it, so a node of any size is read in few rounds.
LOT, PAGE = 1000, 8
_FOUND = "kind string, lot int, query_id long, seed string, question string, path_ord int, path array<string>, score double, depth int, early_terminated boolean, node string, start int, way array<string>, expanded long, state binary"
_FOUND_ARROW = pa.schema([("kind", pa.string()), ("lot", pa.int32()), ("query_id", pa.int64()), ("seed", pa.string()), ("question", pa.string()), ("path_ord", pa.int32()), ("path", pa.list_(pa.string())), ("score", pa.float64()), ("depth", pa.int32()),
                         ("early_terminated", pa.bool_()), ("node", pa.string()), ("start", pa.int32()), ("way", pa.list_(pa.string())), ("expanded", pa.int64()), ("state", pa.binary())])
_GIVEN = "lot int, kind int, query_id long, seed string, question string, node string, depth int, start int, tgt array<string>, rel_type array<string>, score array<double>, pagerank array<double>, way array<string>, p double, state binary"
#: Rows, and bytes of states, that a task holds before it hands them on.
_HELD = 4096, 1 << 23


def _resumed(begin: Callable, rows: Callable, stops: Callable, ahead: int, page: int) -> Callable:
    """One round of the searches of _searched() in a task, lot by lot: first the pages that a lot asked for, then one search
    after the other, its judged paths before its state."""

    def run(batches):
        out, size, lot, pages, wanted, judged = [], 0, None, {}, {}, {}
        none = [None] * 5

        def asked():
            return [("want", lot, None, None, question, *none[:3], depth, None, node, start, None, None, None) for question, node, depth, start in wanted]

        each = (row for b in batches for row in zip(*(c.to_pylist() for c in b.columns), strict=True))
        for of, kind, query_id, seed, question, node, depth, start, tgts, rels, scores, ranks, way, p, state in each:
            if of != lot:
                out += asked()
                lot, pages, wanted, judged = of, {}, {}, {}
            if kind == 0:
                edges, n = list(zip(tgts, scores, ranks, zip(tgts, rels, strict=True), strict=True)), max(page, start)
                pages[question, node, depth, start] = (edges[:n], len(edges) > n)
                continue
            if kind == 1:
                judged[tuple(way)] = stops(p)
                continue
            search = begin(seed)
            if state is not None:
                search.restore(state)
            else:
                search.ask(seed, 0)
            for name, (depth, start) in search.asked.items():
                search.learn_page(name, *pages.get((question, name, depth, start), ([], False)))
            search.learn({}, judged)
            judged, key = {}, (lot, query_id, seed, question)
            wants = search.run(ahead)
            if wants:
                wanted.update(((question, name, depth, start), None) for name, (depth, start) in search.asked.items())
                out += [("way", *key, *none, None, None, way, None, None) for _, way in wants if way is not None]
                kept = search.state()
                out.append(("state", *key, *none, None, None, None, search.expanded, kept))
                size += len(kept)
            else:
                out += [("path", *key, i, *row, None, None, None, search.expanded, None) for i, row in enumerate(rows(search))]
            if len(out) > _HELD[0] or size > _HELD[1]:
                yield _batch(out)
                out, size = [], 0
        out += asked()
        if out:
            yield _batch(out)

    return run


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), _FOUND_ARROW.types, strict=True)], schema=_FOUND_ARROW)


def _given(rows: DataFrame, kind: int) -> DataFrame:
    """Rows with the columns of _GIVEN, null where they have none."""
    at = [c.split() for c in _GIVEN.split(", ")]
    return rows.select(*[F.lit(kind).alias(c) if c == "kind" else F.col(c) if c in rows.columns else F.lit(None).cast(t).alias(c) for c, t in at])


def _pages(store: GraphStore, wants: DataFrame, value: Callable, scorer: d.Scorer) -> DataFrame:
    """The pages of wants(lot, question, node, depth, start): each is made once, whoever asks for it, of the node's edges
    in the order of value(score, pagerank, depth), and goes to each lot once.  An edge more than a page tells that there
    are more."""
    key = ["question", "src", "depth", "start"]
    near = _scored(store, wants.withColumnRenamed("node", "src").select(*key).distinct(), scorer)
    ordered = d.ranked(near, key, F.desc(value(F.col("score"), F.col("pagerank"), F.col("depth") + 1)), F.col("tgt"), F.col("rel_type"))
    ours = ordered.where((F.col("rank") > F.col("start")) & (F.col("rank") <= F.col("start") + F.greatest(F.lit(PAGE), "start") + 1))
    packed = ours.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("rank", "tgt", "rel_type", "score", "pagerank"))).alias("_l"))
    pages = packed.select(*[F.col(c).alias(f"_{c}") for c in key], *[F.col(f"_l.{c}").alias(c) for c in ("tgt", "rel_type", "score", "pagerank")])
    same = F.col("question").eqNullSafe(F.col("_question")) & (F.col("node") == F.col("_src")) & (F.col("depth") == F.col("_depth")) & (F.col("start") == F.col("_start"))
    return wants.join(pages, same)


def _searched(store: GraphStore, starts: DataFrame, begin: Callable, rows: Callable, early: float | None, value: Callable, ahead: int, scorer: d.Scorer) -> DataFrame:
    """The rows of finished searches, one search for each of starts(query_id, question, seed).

    begin(seed) makes a search, rows(search) its results once it is done.  In each round the searches that are not done
    say which nodes they would expand next, and which paths must be judged; those nodes' edges are fetched, scored as one
    column, and sent in pages, the best first, so a search is told few edges more than it takes.  Neighbouring searches
    are a lot, and a page that several of them ask for is sent once.  A search's frontier travels as its state from round
    to round, so a round costs what is new in it, and a plan has the same few joins however deep it goes.
    """
    spark = starts.sparkSession
    active = written(starts.where("seed is not null").groupBy("query_id", "seed").agg(F.min("question").alias("question")))
    # Few searches are much work, so they are dealt over all tasks however few they are.
    n, tasks = active.count(), max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    lots = max(1, min(n, tasks), -(-n // LOT))
    tasks = min(lots, max(tasks, -(-n // (50 * LOT))))
    states = written(active.repartitionByRange(lots, "query_id", "seed").select(F.spark_partition_id().alias("lot"), "query_id", "seed", "question", F.lit(None).cast("binary").alias("state")))
    forget(active)
    wants = states.select("lot", "question", F.col("seed").alias("node"), F.lit(0).alias("depth"), F.lit(0).alias("start")).distinct()
    ways, done = None, None
    stops = (lambda p: p > early) if early is not None else (lambda p: False)
    while True:
        here = _given(_pages(store, wants, value, scorer), 0).unionByName(_given(states, 2))
        if ways is not None:
            p = d.noul(d.probabilities(scorer(F.col("question"), F.array_join("way", " → "))))
            here = here.unionByName(_given(ways.withColumn("p", p), 1))
        dealt = here.repartition(tasks, "lot").sortWithinPartitions("lot", F.col("kind") > 0, "query_id", "seed", "kind")
        found = written(dealt.mapInArrow(_resumed(begin, rows, stops, ahead, PAGE), _FOUND))
        paths = found.where("kind = 'path'")
        done = paths if done is None else done.unionByName(paths)
        states = found.where("kind = 'state'").select("lot", "query_id", "seed", "question", "state")
        wants = found.where("kind = 'want'").select("lot", "question", "node", "depth", "start")
        ways = found.where("kind = 'way'").select("lot", "query_id", "seed", "question", "way") if early is not None else None
        most = states.groupBy("lot").count().agg(F.max("count")).first()[0]
        if most is None:
            return done
        ahead = max(1, min(2 * ahead, MOST_AHEAD, WANTED // most))


def _paths(store: GraphStore, starts: DataFrame, max_depth: int, max_paths: int, early: float | None, config: EngineConfig, scorer: d.Scorer) -> DataFrame:
    begin = lambda seed: BestFirst(seed, max_depth, max_paths, config, early is not None)
    value = lambda s, pagerank, depth: f_score(s, pagerank, depth, config)
    return _searched(store, starts, begin, lambda search: [(p, round(s, 6), n, e) for p, s, n, e in search.out], early, value, max(1, min(AHEAD, 2 * max_paths)), scorer)


def traverse(store: GraphStore, starts: DataFrame, max_depth: int = 4, max_paths: int = 5, early: float | None = 0.95, config: EngineConfig = DEFAULT, scorer: d.Scorer = d.lexical) -> DataFrame:
    """Best-first paths of starts(query_id, question, seed), by the rules of best_first(): edges are scored, and paths
    judged for an early end, by the caller's scorer.  A seed without edges is a path of its own; a null seed none."""
    return _paths(store, starts, max_depth, max_paths, early, config, scorer).select(*[c.split()[0] for c in PATHS.split(", ")])


def two_steps(store: GraphStore, starts: DataFrame, config: EngineConfig = DEFAULT, scorer: d.Scorer = d.lexical) -> DataFrame:
    """query_id, seed, path, score, depth: what traverse() gives of starts(query_id, question, seed) for a depth of 2 where
    all paths are wanted and none ends early, by joins alone; no search has a state and no path passes through Python.

    The nodes at the first step are expanded in the order of their priority, the best of parallel edges, then of their
    name; one leads to no node that was expanded before it in the same search.  That is looked up only for edges between
    nodes that some search meets at its first step.  Words of edges and questions are made before they meet.
    """
    made, compare = getattr(scorer, "prepare", None) or (lambda text: text), getattr(scorer, "compare", scorer)
    active = written(starts.where("seed is not null").groupBy("query_id", "seed").agg(F.min("question").alias("question")))
    first = _scored(store, active.withColumnRenamed("seed", "src"), scorer).withColumn("f", f_score(F.col("score"), F.col("pagerank"), F.lit(1), config))
    near = written(first.groupBy("query_id", F.col("src").alias("seed"), "question", F.col("tgt").alias("here")).agg(F.max("f").alias("f")))
    met = near.where("here <> seed")
    nodes = written(met.select("here").distinct())
    edges = store.edges_of(nodes.withColumnRenamed("here", "src")).join(nodes.select(F.col("here").alias("tgt"), F.lit(True).alias("_met")), "tgt", "left")
    known = written(edges.where("src <> tgt").select(F.col("src").alias("here"), "tgt", "pagerank", "_met", made(edge_text(F.col("src"), F.col("rel_type"), F.col("tgt"))).alias("_i")))
    ends = active.join(near.select("seed").distinct(), "seed", "left_anti").select("query_id", "seed", F.array("seed").alias("path"), F.lit(1.0).alias("score"), F.lit(0).alias("depth"))
    loops = store.edges_of(nodes.withColumnRenamed("here", "src")).select(F.col("src").alias("here")).distinct()
    ends = ends.unionByName(met.join(loops, "here", "left_anti").select("query_id", "seed", F.array("seed", "here").alias("path"), F.round("f", 6).alias("score"), F.lit(1).alias("depth")))
    asked = met.withColumn("_c", made(F.col("question"))).drop("question")

    def paths(rows: DataFrame) -> DataFrame:
        s = F.round(d.score(d.probabilities(compare(F.col("_c"), F.col("_i")))), 6)
        scored = rows.select("query_id", "seed", F.array("seed", "here", "tgt").alias("path"), "pagerank", s.alias("s"))
        return scored.select("query_id", "seed", "path", F.round(f_score(F.col("s"), F.col("pagerank"), F.lit(2), config), 6).alias("score"), F.lit(2).alias("depth"))

    out = ends.unionByName(paths(asked.join(known.where("_met is null"), "here").where("tgt <> seed")))
    between = known.where("_met")
    if between.isEmpty():
        return out
    before = near.select(F.col("query_id").alias("_q"), F.col("seed").alias("_seed"), F.col("here").alias("_here"), F.col("f").alias("_f"))
    same = F.col("query_id").eqNullSafe(F.col("_q")) & (F.col("seed") == F.col("_seed")) & (F.col("tgt") == F.col("_here"))
    sooner = (F.col("_f") > F.col("f")) | ((F.col("_f") == F.col("f")) & (F.col("_here") < F.col("here")))
    return out.unionByName(paths(asked.join(between, "here").where("tgt <> seed").join(before, same & sooner, "left_anti")))


def expansions(store: GraphStore, starts: DataFrame, target: str, max_depth: int = 4, config: EngineConfig = DEFAULT, scorer: d.Scorer = d.lexical) -> DataFrame:
    """query_id, seed, and how many nodes the greedy walk to the target and the best-first search for one path expand."""
    each = [walk_greedily(store, starts, target, max_depth, scorer).select("query_id", "seed", F.col("expanded").alias("greedy")),
            _paths(store, starts, max_depth, 1, None, config, scorer).groupBy("query_id", "seed").agg(F.max("expanded").alias("best_first"))]
    return each[0].join(each[1], ["query_id", "seed"], "left")


def beam(store: GraphStore, starts: DataFrame, depth: int, width: int, config: EngineConfig = DEFAULT, scorer: d.Scorer = d.lexical) -> DataFrame:
    """query_id, depth, node, f: level by level the `width` best nodes of each question; each level is written."""
    front = starts.select("query_id", "question", F.col("seed").alias("src"))
    out = None
    for level in range(1, depth + 1):
        s = scored_edges(store, front, scorer).withColumn("f", F.round(f_score(F.col("score"), F.col("pagerank"), F.lit(level), config), 6))
        best = s.groupBy("query_id", "question", "tgt").agg(F.max("f").alias("f"))
        kept = written(d.ranked(best, ["query_id"], F.desc("f"), F.col("tgt")).where(F.col("rank") <= width))
        step = kept.select("query_id", F.lit(level).alias("depth"), F.col("tgt").alias("node"), "f")
        out = step if out is None else out.unionByName(step)
        front = kept.select("query_id", "question", F.col("tgt").alias("src"))
    return out


def walk_greedily(store: GraphStore, starts: DataFrame, target: str, max_depth: int = 4, scorer: d.Scorer = d.lexical) -> DataFrame:
    """query_id, seed, path, expanded: the greedy walk of each start; without edges it ends where it begins, empty."""
    found = _searched(store, starts, lambda seed: Greedy(seed, target, max_depth), lambda walk: [(walk.way, None, None, None)], None, lambda s, pagerank, depth: s, 1, scorer)
    return found.select("query_id", "seed", "path", "expanded")
