"""Measures of account groups over the transfers inside them.

Pairs inside a group of PAIRED accounts at most are found by one equi-join of its ordered pairs, whose number is bounded, so a hub's other edges meet no group. Larger
groups take two equi-joins (source among the members, then destination), never a comparison with all pairs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .edges import DEFAULT_RISK


#: Accounts of a group up to which its own ordered pairs are joined: that many squared, at most, for each.
PAIRED = 16


def members(groups: DataFrame, key: str) -> DataFrame:
    return groups.select(key, F.explode("participants").alias("account_id"))


def inside(groups: DataFrame, weighed_pairs: DataFrame, key: str) -> DataFrame:
    """(key, src, dst, ...): the pairs with both ends in a group, self-loops too."""
    small = groups.where(F.size("participants") <= PAIRED).select(key, F.explode("participants").alias("src"), "participants").select(key, "src", F.explode("participants").alias("dst"))
    columns = [key, "src", "dst", *[c for c in weighed_pairs.columns if c not in ("src", "dst")]]
    # Planned by the size of the groups' table, which tells nothing of the pairs that it unfolds into, these joins would send the pairs through the driver.
    near = small.hint("merge").join(weighed_pairs.hint("merge"), ["src", "dst"]).select(*columns)
    m = members(groups.where(F.size("participants") > PAIRED), key)
    far = m.withColumnRenamed("account_id", "src").hint("merge").join(weighed_pairs.hint("merge"), "src").join(m.withColumnRenamed("account_id", "dst").hint("merge"), [key, "dst"]).select(*columns)
    return near.union(far)


def with_set_key(records: DataFrame) -> DataFrame:
    """participants in order of name and their joined key: measures are made once for a set."""
    return records.withColumn("participants", F.array_sort(F.array_distinct("participants"))).withColumn("set_key", F.array_join("participants", "|"))


def transaction_metrics(groups: DataFrame, transfers: DataFrame, accounts: DataFrame, key: str = "set_key") -> DataFrame:
    """(key, transactions, total_amount, avg_kyc_risk_score): over all transfers inside a group, chords and self-loops included; a risk of 0 stays 0."""
    sums = transfers.groupBy("src", "dst").agg(F.count("*").alias("n"), F.sum("amount").alias("amt"))
    flow = inside(groups, sums, key).groupBy(key).agg(F.sum("n").alias("transactions"), F.sum("amt").alias("total_amount"))
    risk = members(groups, key).hint("merge").join(accounts.select("account_id", "kyc_risk_score"), "account_id", "left")
    mean = risk.groupBy(key).agg((F.sum(F.coalesce("kyc_risk_score", F.lit(DEFAULT_RISK)).cast("decimal(30,12)")).cast("double") / F.count("*")).alias("avg_kyc_risk_score"))
    return groups.select(key).join(flow, key, "left").join(mean, key, "left").select(key, F.coalesce("transactions", F.lit(0)).alias("transactions"), F.coalesce(F.col("total_amount").cast("decimal(38,2)"), F.lit(0).cast("decimal(38,2)")).alias("total_amount"), F.coalesce("avg_kyc_risk_score", F.lit(DEFAULT_RISK)).alias("avg_kyc_risk_score"))


def enrichment(groups: DataFrame, transfers: DataFrame, key: str = "component_id") -> DataFrame:
    """(key, transactions, total_amount, density): pairs include self-loops, so density can go above 1."""
    sums = transfers.groupBy("src", "dst").agg(F.count("*").alias("n"), F.sum("amount").alias("amt"))
    flow = inside(groups, sums, key).groupBy(key).agg(F.sum("n").alias("transactions"), F.sum("amt").alias("total_amount"), F.count("*").alias("pairs"))
    sized = groups.select(key, F.size("participants").alias("_n")).join(flow, key, "left")
    possible = F.col("_n").cast("double") * (F.col("_n") - 1)
    return sized.select(key, F.coalesce("transactions", F.lit(0)).alias("transactions"), F.coalesce(F.col("total_amount").cast("decimal(38,2)"), F.lit(0).cast("decimal(38,2)")).alias("total_amount"), F.when(F.col("_n") > 1, F.coalesce("pairs", F.lit(0)) / possible).otherwise(0.0).alias("density"))


def simple_graph_metrics(groups: DataFrame, edges: DataFrame, nodes: DataFrame, key: str = "set_key") -> DataFrame:
    """(key, transactions, total_amount, density, avg_risk, avg_activity) over the group's edges without self-loops and its accounts' attributes."""
    flow = inside(groups, edges.select("src", "dst", F.col("transaction_count").alias("n"), F.col("total_amount").alias("amt")), key)
    flow = flow.groupBy(key).agg(F.sum("n").alias("transactions"), F.sum("amt").alias("total_amount"), F.count("*").alias("m"))
    own = members(groups, key).hint("merge").join(nodes, "account_id", "left").groupBy(key).agg(
        F.count("*").alias("size"), F.sum(F.coalesce("risk", F.lit(DEFAULT_RISK)).cast("decimal(30,12)")).alias("risk"), F.sum(F.coalesce("activity", F.lit(0))).alias("activity")
    )
    n = F.col("size").cast("double")
    return own.join(flow, key, "left").select(
        key, F.coalesce("transactions", F.lit(0)).alias("transactions"), F.coalesce(F.col("total_amount").cast("decimal(38,2)"), F.lit(0).cast("decimal(38,2)")).alias("total_amount"),
        F.when(n > 1, F.coalesce("m", F.lit(0)) / (n * (n - 1))).otherwise(0.0).alias("density"), (F.col("risk").cast("double") / n).alias("avg_risk"), (F.col("activity") / n).alias("avg_activity"),
    )
