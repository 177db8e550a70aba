"""Scores, signals and types of account groups as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Weights and scales of the group score (they add up to 0.90).
GROUP_WEIGHTS = {"size": 0.15, "amount": 0.25, "risk": 0.25, "density": 0.15, "activity": 0.10}
GROUP_SCALES = {"size": 10.0, "amount": 1_000_000.0, "activity": 100.0}
# Weights of the ring score.
RING_WEIGHTS = {"amount": 0.30, "cycles": 0.20, "transactions": 0.20, "risk": 0.20, "size": 0.03, "density": 0.03, "evidence": 0.04}
# Signal names in their order.
SIGNALS = (
    "closed_account_cycle", "high_total_amount", "high_internal_transaction_count", "repeated_cycles", "high_average_kyc_risk", "dense_internal_connectivity",
    "contains_generated_fraud_transactions", "contains_generated_fraud_accounts",
)
MIN_FRAUD_SCORE = 0.35


def round_half_even(x: Column, places: int) -> Column:
    """x to so many places, a tie to the even digit, as the double's exact value has it (Spark's own bround takes the decimal text instead).

    10^places * x is a double and what it leaves out, which is exact: factors split in halves give products without rounding (Dekker 1971).
    A double that stands at a tie is above or below it by the sign of what it leaves out.
    """
    x, scale = x.cast("double"), float(10**places)
    product = x * scale
    high = x * 134217729.0 - (x * 134217729.0 - x)
    left_out = (high * scale - product) + (x - high) * scale
    tie = F.abs(product - F.rint(product)) == 0.5
    whole = F.when(tie & (left_out > 0), F.ceil(product)).when(tie & (left_out < 0), F.floor(product)).otherwise(F.rint(product))
    return F.when(F.abs(x) < 1e15 / scale, whole.cast("double") / scale).otherwise(x)


def unit(x: Column) -> Column:
    """x held within 0 and 1."""
    return F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0))


def group_score(n: Column, amount: Column, risk: Column, density: Column, activity: Column) -> Column:
    w, s = GROUP_WEIGHTS, GROUP_SCALES
    capped = lambda x, scale: F.least(x.cast("double") / scale, F.lit(1.0))
    return unit(w["size"] * capped(n, s["size"]) + w["amount"] * capped(amount, s["amount"]) + w["risk"] * unit(risk) + w["density"] * unit(density) + w["activity"] * capped(activity, s["activity"]))


def ring_score(n: Column, transactions: Column, amount: Column, cycles: Column, risk: Column, density: Column, evidence: Column) -> Column:
    w = RING_WEIGHTS
    flag = lambda c: F.when(c, 1.0).otherwise(0.0)
    cap = lambda x: F.least(x, F.lit(1.0))
    return (
        cap(amount.cast("double") / 1_000_000.0) * w["amount"] + cap(cycles.cast("double") / 5.0) * w["cycles"] + cap(transactions.cast("double") / F.greatest(n * 5.0, F.lit(1.0))) * w["transactions"]
        + unit(risk) * w["risk"] + flag(n >= 3) * w["size"] + unit(density) * w["density"] + flag(evidence) * w["evidence"]
    )


# Weights of the two scores that documents describe. Both take 1 - risk, so a higher risk lowers them; detection never uses them.
DOCUMENT_CYCLE_WEIGHTS = {"size": 0.2, "amount": 0.3, "safety": 0.2, "density": 0.3}
DOCUMENT_RING_WEIGHTS = {"size": 0.2, "safety": 0.3, "amount": 0.3, "activity": 0.2}
DOCUMENT_AMOUNT = 100_000.0


def document_cycle_score(n: Column, amount: Column, risk: Column, density: Column) -> Column:
    """The described variant of a cycle's score: size is not capped, the sum is."""
    w, paid = DOCUMENT_CYCLE_WEIGHTS, F.least(amount.cast("double") / DOCUMENT_AMOUNT, F.lit(1.0))
    return F.least(n * w["size"] + paid * w["amount"] + (1 - risk) * w["safety"] + density * w["density"], F.lit(1.0))


def document_ring_score(n: Column, amount: Column, risk: Column, activity: Column) -> Column:
    """The described variant of a ring's score."""
    w, paid = DOCUMENT_RING_WEIGHTS, F.least(amount.cast("double") / DOCUMENT_AMOUNT, F.lit(1.0))
    return F.least(n * w["size"] + (1 - risk) * w["safety"] + paid * w["amount"] + activity / 100 * w["activity"], F.lit(1.0))


def signals(n: Column, transactions: Column, amount: Column, cycles: Column, risk: Column, density: Column, fraud_transactions: Column, fraud_members: Column) -> Column:
    """Names of the thresholds that are met, in the fixed order."""
    met = (n >= 3, amount >= 500_000, transactions >= F.greatest(n * 4, F.lit(8)), cycles >= 3, risk >= 0.65, density >= 0.35, fraud_transactions > 0, fraud_members > 0)
    return F.array_compact(F.array(*[F.when(c, F.lit(name)) for name, c in zip(SIGNALS, met)]))


def ring_kind(n: Column, transactions: Column, amount: Column, cycles: Column, risk: Column, density: Column, both_evidence: Column) -> Column:
    """The type that a ring's figures speak for; the first rule that holds."""
    large = amount >= 500_000
    return (
        F.when(both_evidence, F.when(large, "money_laundering").otherwise("collusion"))
        .when(risk >= 0.65, "account_takeover")
        .when((amount >= 1_000_000) | (large & (transactions >= n * 4)), "money_laundering")
        .when((n >= 8) | (density >= 0.35) | (cycles >= 5), "collusion")
        .when((transactions >= n * 3) & (amount < 1_000_000), "phishing")
        .otherwise("benign_cycle")
    )


def pattern_for_size(n: Column) -> Column:
    return F.when(n.isin(3, 4, 5), F.concat(F.lit("cycle_"), n.cast("string"))).otherwise("complex_network")


def canonical(participants: Column, nulls_as_text: bool = False) -> Column:
    """Sorted, each once. Nulls go, or become the text 'None'."""
    items = F.transform(participants, lambda x: F.coalesce(x, F.lit("None"))) if nulls_as_text else F.array_compact(participants)
    return F.array_sort(F.array_distinct(items))


def as_long(value: Column, default: int = 0) -> Column:
    """A whole number from text or number; text that is no whole number gives the default."""
    return F.coalesce(F.when(value.cast("string").rlike(r"^\s*[+-]?\d+\s*$"), _try(F.trim(value.cast("string")), "bigint")), F.lit(default).cast("long"))


def as_double(value: Column, default: float = 0.0) -> Column:
    """A number; NaN, and text that is none, give the default."""
    return F.coalesce(F.nanvl(_try(value, "double"), F.lit(None).cast("double")), F.lit(default))


def _try(value: Column, kind: str) -> Column:
    return value.try_cast(kind)


def to_usd(amount: Column, currency: Column, rates: dict[str, float]) -> Column:
    """VND is divided by its rate; EUR and GBP are multiplied by theirs; others stay."""
    return F.when(currency == "VND", amount / rates["VND_to_USD"]).when(currency == "EUR", amount * rates["EUR_to_USD"]).when(currency == "GBP", amount * rates["GBP_to_USD"]).otherwise(amount)


def date_parts(ts: Column) -> tuple[Column, Column]:
    """(date as text, hour)."""
    return F.date_format(ts, "yyyy-MM-dd"), F.hour(ts)
