"""Pair aggregation over a stream of transfers.

The batch engine has no streaming operator to match; this keeps the edge table of operators.edges up to date as transfers arrive, with
the same aggregates, and leaves the state to Structured Streaming.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_edges(transfers: DataFrame, window: str = "1 day", lateness: str = "2 days") -> DataFrame:
    """Edges by event-time window; transfers later than `lateness` are left out, so state is bounded."""
    timed = transfers.where("src != dst").withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", lateness)
    return timed.groupBy(F.window("ts", window), "src", "dst").agg(F.count("*").alias("transaction_count"), F.sum("amount").alias("total_amount"), F.min("ts").alias("first_timestamp"), F.max("ts").alias("last_timestamp"))
