"""Accounts and transfers: the label-blind view of any tables, and a transfer graph derived from the customer and orders tables.

The derived graph plants rings of 3, 5 and 8 accounts in blocks of 16, with one-way bridges to a large background, so that all
operators have something to find; both engines can compute it exactly.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .schema import UNLABELLED_ACCOUNTS, UNLABELLED_TRANSACTIONS

BLOCK = 16


def label_blind(accounts: DataFrame, transactions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accounts, transfers) without any label. Transfers: transaction_id, src, dst, amount (decimal, null as 0), ts."""
    a = accounts.select(*[c for c in UNLABELLED_ACCOUNTS if c in accounts.columns])
    have = [c for c in UNLABELLED_TRANSACTIONS if c in transactions.columns]
    t = transactions.select(*have)
    amounts = [F.col(c).cast("decimal(18,2)") for c in ("amount_usd", "amount") if c in have]
    zero = F.lit(0).cast("decimal(18,2)")
    return a, t.select("transaction_id", F.col("source_account").alias("src"), F.col("destination_account").alias("dst"), F.coalesce(*amounts, zero).alias("amount"), F.col("timestamp").alias("ts"))


def account_id(key) -> F.Column:
    return F.concat(F.lit("ACC_"), F.lpad(key.cast("string"), 8, "0"))


def derived_transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Transactions of the derived graph. The size row is one row, whatever the tables."""
    customer = spark.read.parquet(f"{sf_dir}/customer.parquet")
    size = customer.agg(F.count("*").alias("n")).withColumn("r", F.greatest(F.lit(16).cast("long"), F.floor(F.col("n") / 160) * 16))
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderdate").crossJoin(F.broadcast(size))
    key, cust, n, r = F.col("o_orderkey"), F.col("o_custkey"), F.col("n"), F.col("r")
    place = cust % BLOCK
    block = cust - place
    low = F.when(place < 3, 0).when(place < 8, 3).otherwise(8)
    ring = F.when(place < 3, 3).when(place < 8, 5).otherwise(8)
    outside = r + (key * 7919) % (n - r)
    odd, bridge, chord = (block / BLOCK).cast("long") % 2 >= 1, key % 13 == 0, key % 5 == 0
    source = F.when((cust < r) & bridge & odd, outside).otherwise(cust)
    target = (
        F.when(cust >= r, r + (key * 7919 + cust * 31) % (n - r)).when(bridge & ~odd, outside).when(bridge, cust)
        .when(chord, block + low + (place - low + 2) % ring).otherwise(block + low + (place - low + 1) % ring)
    )
    return o.select(
        key.cast("string").alias("transaction_id"), account_id(source).alias("source_account"), account_id(target).alias("destination_account"),
        F.col("o_totalprice").cast("decimal(18,2)").alias("amount_usd"), F.col("o_orderdate").alias("timestamp"), (cust < r).cast("int").alias("is_fraud"),
    )


def derived_accounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = spark.read.parquet(f"{sf_dir}/customer.parquet")
    size = c.agg(F.count("*").alias("n")).select(F.greatest(F.lit(16).cast("long"), F.floor(F.col("n") / 160) * 16).alias("r"))
    risk = F.when(F.col("c_mktsegment") == "MACHINERY", F.lit(None)).otherwise(F.least(F.greatest(F.col("c_acctbal") / 10000, F.lit(0.0)), F.lit(1.0)))
    return c.crossJoin(F.broadcast(size)).select(
        account_id(F.col("c_custkey")).alias("account_id"), risk.cast("double").alias("kyc_risk_score"), (F.col("c_custkey") * 13 % 60).cast("long").alias("monthly_transaction_count"),
        (F.col("c_custkey") < F.col("r")).alias("fraud_ring_member"),
    )


def load(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return label_blind(derived_accounts(spark, sf_dir), derived_transactions(spark, sf_dir))


#: The same tables for the SQL side: a (accounts, with the label), t (transfers), e (edges without self-loops).
SQL = """
p AS (SELECT count(*) AS n, greatest(16, CAST(floor(count(*) / 160) AS BIGINT) * 16) AS r FROM customer),
o AS (SELECT orders.*, o_custkey % 16 AS k, o_custkey - o_custkey % 16 AS b, p.n, p.r FROM orders CROSS JOIN p),
g AS (SELECT *, CASE WHEN k < 3 THEN 0 WHEN k < 8 THEN 3 ELSE 8 END AS lo, CASE WHEN k < 3 THEN 3 WHEN k < 8 THEN 5 ELSE 8 END AS sz FROM o),
x AS (SELECT o_orderkey AS id, CAST(o_totalprice AS DECIMAL(18,2)) AS amount, o_orderdate AS ts,
  CASE WHEN o_custkey < r AND o_orderkey % 13 = 0 AND (b // 16) % 2 >= 1 THEN r + (o_orderkey * 7919) % (n - r) ELSE o_custkey END AS s,
  CASE WHEN o_custkey >= r THEN r + (o_orderkey * 7919 + o_custkey * 31) % (n - r)
       WHEN o_orderkey % 13 = 0 AND (b // 16) % 2 < 1 THEN r + (o_orderkey * 7919) % (n - r)
       WHEN o_orderkey % 13 = 0 THEN o_custkey
       WHEN o_orderkey % 5 = 0 THEN b + lo + (k - lo + 2) % sz ELSE b + lo + (k - lo + 1) % sz END AS d FROM g),
t AS (SELECT CAST(id AS VARCHAR) AS transaction_id, 'ACC_' || lpad(CAST(s AS VARCHAR), 8, '0') AS src, 'ACC_' || lpad(CAST(d AS VARCHAR), 8, '0') AS dst, amount, ts FROM x),
a AS (SELECT 'ACC_' || lpad(CAST(c_custkey AS VARCHAR), 8, '0') AS account_id,
  CASE WHEN c_mktsegment = 'MACHINERY' THEN NULL ELSE least(greatest(c_acctbal / 10000, 0.0), 1.0) END AS kyc_risk_score,
  c_custkey * 13 % 60 AS monthly_transaction_count, c_custkey < p.r AS fraud_ring_member FROM customer CROSS JOIN p),
e AS (SELECT src, dst, count(*) AS n, sum(amount) AS amt, min(ts) AS first_ts, max(ts) AS last_ts FROM t WHERE src <> dst GROUP BY src, dst)
"""
