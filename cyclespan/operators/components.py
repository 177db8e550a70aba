"""Connected components of an undirected graph, as rounds of joins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.scratch import Rounds
from . import local_graph


def connected_components(
    edges: DataFrame,
    keep: Callable[[DataFrame], DataFrame] | None = None,
    drop: Callable[[DataFrame], None] = lambda df: None,
    max_rounds: int = 60,
    local_edges: int = 0,
) -> DataFrame:
    """(node, component): component is the least node that is reachable over `edges` (src, dst).

    Alternating large-star and small-star rounds (Kiveris et al. 2014): the number of rounds grows with the
    logarithm of the longest path, and a round shuffles the edges twice. A node of very many edges is met by
    aggregates with partial sums and by joins that adaptive execution can split, never by a list of its neighbours.
    `keep` writes a round's edges out, which cuts the lineage, and `drop` frees them; by default as Parquet in the shared folder.
    Once no more than `local_edges` edges are left, by their count, one task ends the work (0: never).
    Null ends and self-loops are dropped; a node without other edges gets no row.
    """
    if keep is None:
        rounds = Rounds(edges.sparkSession, "components")
        keep, drop = rounds.keep, rounds.drop
    pairs = edges.select("src", "dst").where("src is not null and dst is not null and src != dst")
    current = keep(pairs.select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")).distinct())
    state = _state(current)
    for _ in range(max_rounds):
        if not state[0]:
            break
        if state[0] <= local_edges:
            return local_graph.solve(current.toDF("src", "dst"), local_graph.connected, "node", "component")
        step = keep(_small_star(_large_star(current)))
        drop(current)
        current, before, state = step, state, _state(step)
        if state == before:
            break
    else:
        raise RuntimeError(f"no fixpoint after {max_rounds} rounds")
    members = current.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return members.unionByName(members.select(F.col("component").alias("node"), "component").distinct())


def _state(edges: DataFrame) -> tuple:
    """Count and order-free digest of the edges; equal ones mark the fixpoint."""
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return row[0], row[1]


def _large_star(edges: DataFrame) -> DataFrame:
    """Each node's larger neighbours are linked to its least neighbour (or itself)."""
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    linked = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return linked.where("u != v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Each node's smaller neighbours, and the node, are linked to the least of them."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    others = edges.join(least, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return others.union(least.select("u", F.col("m").alias("v"))).distinct()
