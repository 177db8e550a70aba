"""Scans and pair aggregation: accounts, logical edges, pairs, graph statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: An account's risk and activity where none is known.
DEFAULT_RISK, DEFAULT_ACTIVITY = 0.5, 0


def nodes(accounts: DataFrame) -> DataFrame:
    """Account attributes for group metrics. A risk of exactly 0 counts as unknown here (kept for equal results)."""
    risk = F.coalesce(F.nanvl("kyc_risk_score", F.lit(None).cast("double")), F.lit(DEFAULT_RISK))
    return accounts.select("account_id", F.when(risk == 0, DEFAULT_RISK).otherwise(risk).alias("risk"), F.coalesce("monthly_transaction_count", F.lit(DEFAULT_ACTIVITY)).cast("long").alias("activity"))


def account_ids(accounts: DataFrame) -> DataFrame:
    return accounts.select("account_id")


def edges(transfers: DataFrame, self_loops: bool = False) -> DataFrame:
    """One row for each ordered pair: transaction_count, total_amount, first and last timestamp. Partial sums are made before the shuffle."""
    rows = transfers if self_loops else transfers.where("src != dst")
    return rows.groupBy("src", "dst").agg(F.count("*").alias("transaction_count"), F.sum("amount").alias("total_amount"), F.min("ts").alias("first_timestamp"), F.max("ts").alias("last_timestamp"))


def pairs(transfers: DataFrame) -> DataFrame:
    """Ordered pairs, self-loops included."""
    return transfers.select("src", "dst").distinct()


def upsert(old: DataFrame, new: DataFrame, rebuild: bool = True) -> DataFrame:
    """Edges after new ones were written over old ones. With rebuild the old ones are gone; else pairs that are in old alone stay as they were."""
    if rebuild:
        return new
    values = [c for c in new.columns if c not in ("src", "dst")]
    marked = new.withColumn("_new", F.lit(True))
    both = old.alias("o").join(marked.alias("n"), ["src", "dst"], "full_outer")
    return both.select("src", "dst", *[F.when(F.col("_new"), F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")).alias(c) for c in values])


def page(accounts: DataFrame, after: str, batch_size: int) -> DataFrame:
    """The next batch_size account ids after `after`, in order: one keyset page."""
    if batch_size < 1:
        raise ValueError("batch_size must be positive")
    return accounts.select("account_id").where(F.col("account_id") > after).orderBy("account_id").limit(batch_size)


def pages(accounts: DataFrame, batch_size: int) -> DataFrame:
    """(page, after, last, accounts): all keyset pages at once. Page after page, `page(accounts, after, batch_size)` gives the same accounts; the first one's `after` is null.
    Accounts are numbered by sorted ranges and their counts, so no page waits for the one before."""
    from .rings import numbered

    if batch_size < 1:
        raise ValueError("batch_size must be positive")
    rows = numbered(accounts.select("account_id").where("account_id is not null").distinct(), [F.col("account_id")], "PAGE", "_id")
    own = rows.groupBy(F.floor(F.col("_number") / batch_size).alias("page")).agg(F.max("account_id").alias("last"), F.count("*").alias("accounts"))
    before = own.select((F.col("page") + 1).alias("page"), F.col("last").alias("after"))
    return own.join(before, "page", "left").select("page", "after", "last", "accounts")


def threshold(edges: DataFrame, min_pair_transactions: int = 0, min_pair_amount: float = 0.0) -> DataFrame:
    """Edges of enough transactions and amount, filtered once before any join."""
    return edges.where((F.col("transaction_count") >= min_pair_transactions) & (F.col("total_amount") >= min_pair_amount))


def transfers_of_pairs(transfers: DataFrame, kept: DataFrame) -> DataFrame:
    """Transfers whose ordered pair is among `kept` edges: EXISTS as a left-semi join."""
    return transfers.join(kept.select("src", "dst"), ["src", "dst"], "left_semi")


def normal_accounts(accounts: DataFrame) -> DataFrame:
    """Accounts that are no ring members; all of them where there is no such column. For generation, never for detection."""
    return accounts.where(~F.coalesce("fraud_ring_member", F.lit(False))) if "fraud_ring_member" in accounts.columns else accounts


def graph_stats(accounts: DataFrame, transfers: DataFrame) -> DataFrame:
    """One row: accounts, transactions, logical pairs (self-loops included), edges (without), density of the simple graph."""
    per_pair = transfers.groupBy("src", "dst").agg(F.count("*").alias("n"))
    sums = per_pair.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("transactions"), F.count("*").alias("logical_pairs"), F.count_if(F.col("src") != F.col("dst")).alias("edges"))
    size = accounts.agg(F.count("*").alias("accounts"))
    possible = F.col("accounts").cast("double") * (F.col("accounts") - 1)
    return size.crossJoin(sums).withColumn("density", F.when(F.col("accounts") > 1, F.col("edges") / possible).otherwise(0.0))
