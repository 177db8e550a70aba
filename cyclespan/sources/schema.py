"""Column sets of the data model. Detection reads UNLABELLED columns only."""

from __future__ import annotations

from pyspark.sql import types as T

ACCOUNTS = T.StructType([T.StructField("account_id", T.StringType(), False), T.StructField("kyc_risk_score", T.DoubleType()), T.StructField("monthly_transaction_count", T.LongType()), T.StructField("fraud_ring_member", T.BooleanType())])
TRANSACTIONS = T.StructType(
    [T.StructField(n, t) for n, t in (
        ("transaction_id", T.StringType()), ("source_account", T.StringType()), ("destination_account", T.StringType()), ("amount_usd", T.DecimalType(18, 2)), ("original_amount", T.DecimalType(18, 2)),
        ("original_currency", T.StringType()), ("timestamp", T.TimestampNTZType()), ("date", T.StringType()), ("hour", T.IntegerType()), ("channel", T.StringType()), ("transaction_type", T.StringType()),
        ("is_fraud", T.IntegerType()), ("fraud_ring_id", T.StringType()),
    )]
)
CYCLE_RECORD = T.StructType(
    [T.StructField(n, t) for n, t in (
        ("participants", T.ArrayType(T.StringType())), ("accounts", T.ArrayType(T.StringType())), ("cycle_size", T.IntegerType()), ("size", T.IntegerType()), ("transactions", T.LongType()), ("transaction_count", T.LongType()),
        ("group_transactions", T.LongType()), ("total_amount", T.DoubleType()), ("amount", T.DoubleType()), ("group_total_amount", T.DoubleType()), ("cycles", T.LongType()), ("metrics_are_group_level", T.BooleanType()),
        ("score", T.DoubleType()), ("density", T.DoubleType()), ("avg_kyc_risk_score", T.DoubleType()), ("fraud_transaction_count", T.LongType()), ("fraud_member_count", T.LongType()),
        ("method", T.StringType()), ("component_id", T.StringType()), ("community_id", T.StringType()),
    )]
)
LABELS = ("is_fraud", "fraud_ring_id", "fraud_ring_member", "transaction_type", "background_ring_id")
UNLABELLED_ACCOUNTS = ("account_id", "kyc_risk_score", "monthly_transaction_count")
UNLABELLED_TRANSACTIONS = ("transaction_id", "source_account", "destination_account", "amount_usd", "amount", "timestamp")
