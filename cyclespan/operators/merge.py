"""Merging of candidates that share accounts, and how fragmented the results are."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.scratch import Rounds
from .components import connected_components
from .local_graph import LOCAL_EDGES
from .metrics import simple_graph_metrics, with_set_key


def ratio(a: Column, b: Column) -> Column:
    """a / b as a double; null over 0."""
    return F.when(b != 0, a.cast("double") / b.cast("double"))


def overlap_clusters(records: DataFrame, scope: str | None = None) -> DataFrame:
    """records with `cluster`: the same for records that share an account, directly or over others. With `scope`, only within equal values of that column.

    Sets and accounts are the two sides of a graph; an account of many records is one node, so no two records are ever compared.
    """
    rounds = Rounds(records.sparkSession, "overlap")
    keyed = with_set_key(records.where(F.size("participants") > 0))
    prefix = F.concat(F.col(scope).cast("string"), F.lit("/")) if scope else F.lit("")
    keyed = rounds.keep(keyed.withColumn("_node", F.concat(F.lit("s:"), prefix, F.col("set_key"))))
    ends = keyed.select(F.col("_node").alias("src"), F.explode("participants").alias("p"), *([scope] if scope else [])).distinct()
    links = ends.select("src", F.concat(F.lit("a:"), prefix, F.col("p")).alias("dst"))
    labels = connected_components(links, keep=rounds.keep, drop=rounds.drop, local_edges=LOCAL_EDGES)
    return keyed.join(labels.select(F.col("node").alias("_node"), F.col("component").alias("cluster")), "_node").drop("_node")


def merge_records(records: DataFrame) -> DataFrame:
    """One row for each cluster: the union of its accounts, the greatest transactions and amount, the sum of cycles, how many records and of which sizes."""
    c = overlap_clusters(records)
    merged = c.groupBy("cluster").agg(
        F.max(F.coalesce("transactions", F.lit(0))).alias("transactions"), F.max(F.coalesce("total_amount", F.lit(0))).alias("total_amount"),
        F.sum(F.when(F.coalesce("cycles", F.lit(0)) == 0, 1).otherwise(F.col("cycles"))).alias("cycles"), F.count("*").alias("fragment_count"),
        F.array_sort(F.collect_set("cycle_size")).alias("candidate_cycle_sizes"),
    )
    members = c.select("cluster", F.explode("participants").alias("p")).distinct().groupBy("cluster").agg(F.array_sort(F.collect_list("p")).alias("participants"))
    out = members.join(merged, "cluster").drop("cluster").withColumn("participant_count", F.size("participants"))
    return out.withColumn("cycle_size", F.col("participant_count")).withColumn("method", F.lit("overlap_merge"))


def ordered_merged(merged: DataFrame) -> DataFrame:
    return merged.orderBy(F.desc("total_amount"), F.desc("cycles"), "participants")


def merge_measured(records: DataFrame, edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """As merge_records, but with measures made anew on the graph inside each union of accounts, and their score."""
    from ..functions.scoring import group_score

    base = merge_records(records).drop("transactions", "total_amount", "method")
    base = with_set_key(base)
    made = simple_graph_metrics(base, edges, nodes)
    out = base.join(made, "set_key").drop("set_key")
    return out.withColumn("score", group_score(F.col("participant_count"), F.col("total_amount"), F.col("avg_risk"), F.col("density"), F.col("avg_activity"))).withColumn("method", F.lit("component_merge"))


def fragmentation(records: DataFrame) -> DataFrame:
    """(scope, raw_cycles, unique_sets, merged_clusters, ff_enumeration, ff_fragmentation, ff_total): for `total` and each cycle size, clusters being found anew within each."""
    rows = records.where(F.size("participants") > 0)
    sizes = F.coalesce(F.col("cycle_size"), F.size(F.array_distinct("participants"))).cast("string")
    scoped = rows.select("participants", F.explode(F.array(F.lit("total"), sizes)).alias("scope"))
    c = overlap_clusters(scoped, "scope")
    counts = c.groupBy("scope").agg(F.count("*").alias("raw_cycles"), F.count_distinct("set_key").alias("unique_sets"), F.count_distinct("cluster").alias("merged_clusters"))
    empty = records.sparkSession.createDataFrame([("total",)], "scope string")
    full = empty.join(counts, "scope", "full_outer")
    n = {x: F.coalesce(F.col(x), F.lit(0)).cast("long") for x in ("raw_cycles", "unique_sets", "merged_clusters")}
    return full.select(
        "scope", *[v.alias(k) for k, v in n.items()], ratio(n["raw_cycles"], n["unique_sets"]).alias("ff_enumeration"),
        ratio(n["unique_sets"], n["merged_clusters"]).alias("ff_fragmentation"), ratio(n["raw_cycles"], n["merged_clusters"]).alias("ff_total"),
    )
