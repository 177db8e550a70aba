"""Strongly connected components by rounds of joins whose number doesn't follow the diameter.

Elimination first: a vertex of few ways through (in times out degree no more than their sum) goes, and each way u -> v -> w through it becomes an edge u -> w, so the
rest's components stay what they were. An independent set goes at once (vertices whose hash is below their neighbours'), a fixed share of any chain, ring or
tree: their rounds grow with the logarithm of the size. Vertices that nothing leads to, or that lead nowhere, go as well. On the way back, in reverse order, a vertex
belongs to the component that both one of its predecessors and one of its successors are in, else to none but its own.

What is left of a graph is dense, so it has short ways. There the published multistep scheme (Slota et al. 2014) goes on: one forward-backward search takes the giant component (Fleischer et al. 2000),
and is given up if it takes more than a few rounds; elimination with more ways through, as long as edges don't grow much; then colouring (Orzan 2004), with elimination after each round.

No join is planned as a broadcast: tables just below its limit, one after another, would pass through the driver. Every round is a join on the edges' key with partial aggregates, its result is written to the shared folder, and only counts reach the driver. Once few
edges are left, by their count, one task solves them (local_graph; 0: never). A limit of rounds ends in an error, never in labels that have not settled.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.scratch import Rounds
from . import local_graph
from .cycles import by_number

#: Rounds after which a search for the giant component is given up.
SEARCH_ROUNDS = 24
#: An elimination round that takes a smaller share of the vertices than this is the last of its kind.
LEAST_SHARE = 0.05
#: Ways through a vertex, by the sum of its degrees, that the kinds of elimination allow.
FACTORS = (1, 2, 4, 8)
#: Edges may grow to this multiple of what a kind of elimination began with.
GROWTH = 1.5


def strong_components(pairs: DataFrame, vertices: DataFrame | None = None, max_rounds: int = 500, local_edges: int = local_graph.LOCAL_EDGES) -> DataFrame:
    """(account_id, component): component is its least account. pairs: (src, dst), self-loops allowed; rows with a null end are ignored.
    Vertices without a partner are components of their own; without `vertices`, those are the ends of the pairs."""
    rounds = Rounds(pairs.sparkSession, "scc")
    graph = rounds.keep(pairs.select("src", "dst").where("src is not null and dst is not null").distinct())
    # Rounds work on numbers in the order of the names.
    names, numbers = by_number(graph, rounds)
    if vertices is None:
        vertices = graph.select(F.col("src").alias("account_id")).union(graph.select("dst")).distinct()
    run = _Run(rounds, numbers.where("src != dst"), local_edges, max_rounds)
    labels = run.labels()
    if labels is None:
        return vertices.select("account_id", F.col("account_id").alias("component"))
    # A component's name so far is one of its vertices, which may have no row itself.
    least = labels.groupBy("component").agg(F.least(F.min("v"), F.col("component")).alias("m"))
    every = labels.select("v", "component").union(labels.select(F.col("component").alias("v"), "component")).distinct()
    own = every.join(least.hint("merge"), "component").where("v != m").select("v", "m")
    own = own.join(names.toDF("account_id", "v").hint("merge"), "v").join(names.toDF("component", "m").hint("merge"), "m").select("account_id", "component")
    return vertices.join(own.hint("merge"), "account_id", "left").select("account_id", F.coalesce("component", "account_id").alias("component"))


class _Run:
    """What is left of a graph, the components that were found, and the way back to the vertices that went."""

    def __init__(self, rounds: Rounds, edges: DataFrame, local_edges: int, max_rounds: int):
        self.rounds, self.local_edges, self.max_rounds = rounds, local_edges, max_rounds
        self.edges, self.n = edges, edges.count()
        self.found: list[DataFrame] = []
        self.back: list[DataFrame] = []

    def labels(self) -> DataFrame | None:
        """(v, component) of all vertices that are not known to be alone."""
        self._shrink()
        if self.local_edges and self.n:
            self.found.append(self.rounds.keep(local_graph.solve(self.edges, local_graph.strong, "v", "component")))
        if not self.found and not self.back:
            return None
        kind = dict(self.edges.dtypes)["src"]
        labels = self.edges.sparkSession.createDataFrame([], f"v {kind}, component {kind}")
        for more in self.found:
            labels = labels.union(more.select("v", "component"))
        labels = self.rounds.keep(labels)
        for ways in reversed(self.back):
            named = labels.select(F.col("v").alias("_v"), "component")
            ends = [ways.where(F.col("kind") == k).select(F.col(a).alias("_v"), F.col(b).alias("v")).join(named.hint("merge"), "_v", "left").select("v", F.coalesce("component", "_v").alias("component")).distinct() for k, a, b in ((1, "src", "dst"), (2, "dst", "src"))]
            before, labels = labels, self.rounds.keep(labels.union(ends[0].join(ends[1].hint("merge"), ["v", "component"])))
            self.rounds.drop(before), self.rounds.drop(ways)
        return labels

    @property
    def _few(self) -> bool:
        return self.n <= self.local_edges

    def _shrink(self) -> None:
        """Take vertices and components away until few edges are left."""
        self._eliminate(FACTORS[0])
        if not self._few:
            self._giant()
        for _ in range(self.max_rounds):
            for factor in FACTORS:
                self._eliminate(factor)
            if self._few:
                return
            done = _colour_round(self.edges, self.rounds, self.max_rounds)
            self.found.append(done)
            self._replace(_without(self.edges, done))
        raise RuntimeError(f"no end after {self.max_rounds} rounds")

    def _replace(self, edges: DataFrame) -> None:
        before, self.edges = self.edges, self.rounds.keep(edges)
        self.rounds.drop(before)
        self.n = self.edges.count()

    def _eliminate(self, factor: int) -> None:
        """Rounds of elimination while they take a fair share of the vertices."""
        begun = self.n
        for _ in range(self.max_rounds):
            if self._few or self.n > GROWTH * begun:
                return
            before, after = self._eliminate_once(factor)
            if after > (1 - LEAST_SHARE) * before:
                return
        raise RuntimeError(f"no end after {self.max_rounds} rounds")

    def _eliminate_once(self, factor: int) -> tuple[int, int]:
        """The numbers of vertices before and after."""
        rounds, edges = self.rounds, self.edges
        ends = edges.select(F.col("src").alias("v"), F.lit(1).alias("o"), F.lit(0).alias("i")).union(edges.select("dst", F.lit(0), F.lit(1)))
        degrees = ends.groupBy("v").agg(F.sum("o").alias("o"), F.sum("i").alias("i"))
        ways, h = F.col("o") * F.col("i"), F.xxhash64(F.lit(len(self.back)), "v")
        vertices = rounds.keep(degrees.select("v", (ways == 0).alias("loose"), (ways <= factor * (F.col("o") + F.col("i"))).alias("cheap"), h.alias("h")))
        a, b = (vertices.toDF(end, f"{end}_loose", f"{end}_cheap", f"{end}_h") for end in ("src", "dst"))
        first = (F.col("src_h") < F.col("dst_h")) | ((F.col("src_h") == F.col("dst_h")) & (F.col("src") < F.col("dst")))
        # Of two neighbours that could go, the one of the greater hash stays.
        stays = F.when(F.col("src_cheap") & F.col("dst_cheap"), F.when(first, F.col("dst")).otherwise(F.col("src")))
        live = rounds.keep(edges.join(a.hint("merge"), "src").join(b.hint("merge"), "dst").where("not src_loose and not dst_loose").select("src", "dst", stays.alias("stays")))
        go = vertices.where("cheap and not loose").join(live.select(F.col("stays").alias("v")).where("v is not null").distinct().hint("merge"), "v", "left_anti").select("v", F.lit(True).alias("goes"))
        go = rounds.keep(go)
        marked = live.select("src", "dst").join(go.toDF("src", "_s").hint("merge"), "src", "left").join(go.toDF("dst", "_d").hint("merge"), "dst", "left")
        marked = rounds.keep(marked.select("src", "dst", F.when(F.col("_d"), 1).when(F.col("_s"), 2).otherwise(0).alias("kind")))
        into, out = marked.where("kind = 1").select(F.col("src").alias("u"), F.col("dst").alias("v")), marked.where("kind = 2").select(F.col("src").alias("v"), F.col("dst").alias("w"))
        through = into.join(out.hint("merge"), "v").where("u != w").select(F.col("u").alias("src"), F.col("w").alias("dst"))
        total, left = vertices.count(), vertices.where("not loose").count() - go.count()
        self._replace(marked.where("kind = 0").select("src", "dst").union(through).distinct())
        self.back.append(marked)
        for df in (vertices, live, go):
            rounds.drop(df)
        return total, left

    def _giant(self) -> None:
        """Take the component of the vertex of the largest in times out degree, if a few rounds find it."""
        pivot = _pivot(self.edges)
        if pivot is None:
            return
        ahead = _reach(self.edges, pivot, self.rounds, SEARCH_ROUNDS)
        behind = ahead and _reach(self.edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")), pivot, self.rounds, SEARCH_ROUNDS)
        if ahead is None or behind is None:
            return
        giant = ahead.join(behind, "v", "left_semi").select("v", F.lit(pivot).cast(dict(self.edges.dtypes)["src"]).alias("component"))
        giant = self.rounds.keep(giant)
        self.found.append(giant)
        self._replace(_without(self.edges, giant))


def _without(edges: DataFrame, gone: DataFrame) -> DataFrame:
    v = gone.select("v")
    return edges.join(v.withColumnRenamed("v", "src"), "src", "left_anti").join(v.withColumnRenamed("v", "dst"), "dst", "left_anti").select("src", "dst")


def _pivot(edges: DataFrame):
    out_degree = edges.groupBy(F.col("src").alias("v")).agg(F.count("*").alias("o"))
    in_degree = edges.groupBy(F.col("dst").alias("v")).agg(F.count("*").alias("i"))
    top = out_degree.join(in_degree, "v").orderBy(F.desc(F.col("o") * F.col("i")), "v").limit(1).collect()
    return top[0]["v"] if top else None


def _reach(edges: DataFrame, start, rounds: Rounds, most: int) -> DataFrame | None:
    """(v): what can be reached from start; none if that takes more rounds."""
    kind = dict(edges.dtypes)["src"]
    seen = rounds.keep(edges.sparkSession.createDataFrame([(start,)], f"v {kind}"))
    front = seen
    for _ in range(most):
        step = edges.join(front, edges["src"] == front["v"]).select(F.col("dst").alias("v")).distinct()
        front = rounds.keep(step.join(seen, "v", "left_anti"))
        if front.isEmpty():
            return seen
        before, seen = seen, rounds.keep(seen.union(front))
        rounds.drop(before)
    return None


def _colour_round(edges: DataFrame, rounds: Rounds, max_rounds: int) -> DataFrame:
    """(v, component) of the components that hold their colour's root, the least vertex that leads to all of the colour."""
    vertices = edges.select(F.col("src").alias("v")).union(edges.select("dst")).distinct()
    colours = rounds.keep(vertices.withColumn("c", F.col("v")))
    for _ in range(max_rounds):
        sent = edges.join(colours.select(F.col("v").alias("src"), "c"), "src").groupBy(F.col("dst").alias("v")).agg(F.min("c").alias("m"))
        step = rounds.keep(colours.select("v", "c").join(sent, "v", "left").select("v", F.least("c", F.coalesce("m", "c")).alias("c"), (F.col("m") < F.col("c")).alias("moved")))
        moved = not step.where("moved").isEmpty()
        rounds.drop(colours)
        colours = step
        if not moved:
            break
    else:
        raise RuntimeError(f"colours have not settled after {max_rounds} rounds")
    colours = colours.select("v", "c")
    same = edges.join(colours.toDF("src", "c"), "src").join(colours.toDF("dst", "d"), "dst").where("c = d").select("src", "dst", "c")
    same = rounds.keep(same)
    front = seen = rounds.keep(colours.where("v = c").select("v", F.col("c").alias("component")))
    for _ in range(max_rounds):
        back = same.join(front, (same["dst"] == front["v"]) & (same["c"] == front["component"])).select(F.col("src").alias("v"), "component").distinct()
        front = rounds.keep(back.join(seen, ["v", "component"], "left_anti"))
        if front.isEmpty():
            return seen
        seen = rounds.keep(seen.union(front))
    raise RuntimeError(f"no end after {max_rounds} rounds")


def grouped(labels: DataFrame, min_size: int = 3, max_size: int = 12) -> DataFrame:
    """(component_id, participants, participant_count) of components in the size band. Sizes are counted first, so larger components never become lists."""
    fit = labels.groupBy("component").agg(F.count("*").alias("n")).where(F.col("n").between(min_size, max_size)).select("component")
    own = labels.join(fit, "component", "left_semi").groupBy("component").agg(F.array_sort(F.collect_list("account_id")).alias("participants"))
    return own.select(F.col("component").alias("component_id"), "participants", F.size("participants").alias("participant_count"))


def ordered(groups: DataFrame, limit: int = 0) -> DataFrame:
    """By size, then by the least account."""
    out = groups.orderBy(F.desc("participant_count"), "component_id")
    return out.limit(limit) if limit > 0 else out


def inner_edges(edges: DataFrame, labels: DataFrame, min_size: int = 3, max_size: int = 12) -> DataFrame:
    """Edges inside one component of the size band: all that bounded cycles can use."""
    fit = labels.groupBy("component").agg(F.count("*").alias("n")).where(F.col("n").between(min_size, max_size)).select("component")
    own = labels.join(fit, "component", "left_semi").select("account_id", "component")
    ends = edges.join(own.toDF("src", "_c"), "src").join(own.toDF("dst", "_d"), "dst")
    return ends.where("_c = _d").drop("_c", "_d")
