"""Rings: cycle records of the same accounts as one object, scored and classified, and their tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scoring as S
from ..sources.schema import CYCLE_RECORD

#: Output order of a ring's leading fields.
FIELDS = ("ring_id", "ring_type", "participants", "participant_count", "transactions", "total_amount", "pattern", "cycles")


def normalize(records: DataFrame) -> DataFrame:
    """Records with every column of CYCLE_RECORD, aliases resolved: accounts, size, amount, transaction_count stand in for what is absent, empty or 0."""
    have = set(records.columns)
    get = {f.name: (F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType) for f in CYCLE_RECORD}
    filled = lambda c: F.when(c != 0, c)
    people = F.coalesce(F.when(F.size(get["participants"]) > 0, get["participants"]), get["accounts"])
    known = records.select(people.alias("participants"), *[get[c].alias(c) for c in get if c != "participants"])
    own = S.canonical(F.col("participants"))
    size = F.coalesce(filled(F.col("cycle_size")), filled(F.col("size")), F.size(own))
    grouped = F.coalesce("metrics_are_group_level", F.lit(False))
    return known.withColumns(
        {
            "members": own, "cycle_size": size.cast("int"), "metrics_are_group_level": grouped, "has_score": F.col("score").isNotNull(),
            "amount_of": F.coalesce(F.when(grouped, F.col("group_total_amount")), F.when(grouped, F.col("total_amount")).otherwise(filled(F.col("total_amount"))), F.col("amount"), F.lit(0.0)),
            "loose_transactions": F.coalesce(filled(F.col("transactions")), filled(F.col("transaction_count")), size).cast("long"),
            "cycles_of": F.coalesce(filled(F.col("cycles")), F.lit(1)).cast("long"),
        }
    )


def partials(records: DataFrame, strict: bool = False, instances: bool = False) -> DataFrame:
    """One row for each set of accounts, with sums and greatest values from which `finished` makes a ring's measures. Rows of several runs can be put together by `combined`."""
    r = normalize(records).where(F.size("members") > 0)
    group_level = F.col("metrics_are_group_level")
    stated = [F.col("group_transactions")] + ([] if strict else [F.when(F.col("transactions") != 0, F.col("transactions"))])
    r = r.withColumn("n_of", F.when(group_level, F.coalesce(*stated, F.col("cycle_size").cast("long"))).otherwise(F.col("loose_transactions")))
    exact = F.col("amount_of").cast("decimal(28,6)")
    best = lambda c: F.max(F.when(group_level, c))
    total = lambda c: F.sum(F.when(~group_level, c))
    # Without a risk column no record counts in the mean.
    with_risk = "avg_kyc_risk_score" in records.columns
    risk = F.coalesce("avg_kyc_risk_score", F.lit(0.5)) if with_risk else F.lit(0.0)
    more = [F.collect_list(F.struct("participants", "cycle_size", S.round_half_even(F.col("amount_of"), 2).alias("total_amount"), "score", "density", "method", "component_id", "community_id")).alias("cycle_instances")] if instances else []
    return r.groupBy(F.col("members").alias("participants")).agg(
        best(F.col("n_of")).cast("long").alias("best_n"), total(F.col("n_of")).cast("long").alias("sum_n"), best(exact).cast("decimal(38,6)").alias("best_amount"), total(exact).cast("decimal(38,6)").alias("sum_amount"),
        F.sum("cycles_of").alias("cycles"), F.max("score").alias("score"), F.sum(risk.cast("decimal(28,12)")).cast("decimal(38,12)").alias("risk_sum"), F.count(F.lit(1) if with_risk else F.lit(None)).alias("risk_rows"),
        F.max("density").alias("density"), F.max("fraud_transaction_count").alias("fraud_transaction_count"), F.max("fraud_member_count").alias("fraud_member_count"), *more,
    )


def combined(rows: DataFrame) -> DataFrame:
    """Rows of `partials` of several runs, one for each set of accounts."""
    sums, kinds = ("sum_n", "sum_amount", "cycles", "risk_sum", "risk_rows"), dict(rows.dtypes)
    return rows.groupBy("participants").agg(*[(F.sum(c) if c in sums else F.max(c)).cast(kinds[c]).alias(c) for c in rows.columns if c != "participants"])


def finished(rows: DataFrame) -> DataFrame:
    """Rings of the rows of `partials` or `combined`."""
    zero = lambda c: F.coalesce(c, F.lit(0))
    risk = F.when(F.col("risk_rows") > 0, S.round_half_even(F.col("risk_sum").cast("double") / F.col("risk_rows"), 4))
    more = ["cycle_instances"] if "cycle_instances" in rows.columns else []
    return rows.select(
        "participants", F.greatest(zero("best_n"), zero("sum_n")).cast("long").alias("transactions"), F.greatest(zero("best_amount"), zero("sum_amount")).cast("double").alias("total_amount"), "cycles",
        "score", risk.alias("avg_kyc_risk_score"), "density", "fraud_transaction_count", "fraud_member_count", *more,
    ).withColumn("participant_count", F.size("participants")).withColumn("pattern", S.pattern_for_size(F.col("participant_count")))


def aggregate(records: DataFrame, strict: bool = False, instances: bool = False) -> DataFrame:
    """One row for each set of accounts. Group-level records give their greatest transactions and amount, others add up.

    strict: a group-level record's transactions are read from group_transactions alone, else its cycle size; by default `transactions` comes before that.
    A set of mixed records takes the greater of the group-level ones and the others' sum. Where records have a risk column, each counts in the mean
    risk, a null as 0.5, and the mean is rounded to four places before anything is decided on it.
    """
    return finished(partials(records, strict, instances))


def classify(rings: DataFrame, min_fraud_score: float = S.MIN_FRAUD_SCORE) -> DataFrame:
    """Adds fraud_score, fraud_signals, is_fraud_ring, ring_type."""
    n, tx, amount, cycles = (F.col(c) for c in ("participant_count", "transactions", "total_amount", "cycles"))
    risk, density = F.coalesce("avg_kyc_risk_score", F.lit(0.5)), F.coalesce("density", F.lit(0.0))
    fraud_tx, fraud_members = (F.coalesce(c, F.lit(0)) for c in ("fraud_transaction_count", "fraud_member_count"))
    some, both = (fraud_tx > 0) | (fraud_members > 0), (fraud_tx > 0) & (fraud_members > 0)
    scored = rings.withColumns(
        {
            "fraud_score": S.round_half_even(S.ring_score(n, tx, amount, cycles, risk, density, some), 4),
            "fraud_signals": S.signals(n, tx, amount, cycles, risk, density, fraud_tx, fraud_members),
            "_kind": S.ring_kind(n, tx, amount, cycles, risk, density, both), "_proven": both & (n >= 3),
        }
    )
    ring = F.col("_proven") | ((F.col("fraud_score") >= min_fraud_score) & (F.col("_kind") != "benign_cycle"))
    return scored.withColumn("is_fraud_ring", ring).withColumn("ring_type", F.when(ring, F.col("_kind")).otherwise("benign_cycle")).drop("_kind", "_proven")


def numbered(rows: DataFrame, order: list, prefix: str, column: str = "ring_id") -> DataFrame:
    """Rows with ids PREFIX_0000, PREFIX_0001, ... in the given order, without a window over all rows: ranges are sorted, counted, and counted on."""
    n = rows.sparkSession.conf.get("spark.sql.shuffle.partitions")
    sorted_rows = rows.repartitionByRange(int(n), *order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    from ..plans.scratch import Rounds

    kept = Rounds(rows.sparkSession, "numbered").keep(sorted_rows)
    part = F.shiftright("_at", 33)
    counts = kept.groupBy(part.alias("_part")).agg(F.count("*").alias("_n")).orderBy("_part").collect()  # one row for each partition
    before, total = [], 0
    for c in counts:
        before.append((c["_part"], total))
        total += c["_n"]
    offsets = rows.sparkSession.createDataFrame(before, "_part long, _before long")
    out = kept.withColumn("_part", part).join(F.broadcast(offsets), "_part")
    number = F.col("_before") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    return out.withColumn("_number", number).withColumn(column, F.concat(F.lit(prefix + "_"), F.when(number < 10000, F.lpad(number.cast("string"), 4, "0")).otherwise(number.cast("string")))).drop("_at", "_part", "_n", "_before")


def rings(records: DataFrame, prefix: str = "RING", strict: bool = False, fraud_only: bool = False, min_fraud_score: float = S.MIN_FRAUD_SCORE, instances: bool = False, source_approach: str | None = None) -> DataFrame:
    """Aggregated, classified, ordered by amount, cycles and size, numbered; fields in FIELDS come first, the amount is rounded after the order."""
    return listed(aggregate(records, strict, instances), prefix, fraud_only, min_fraud_score, source_approach)


def listed(found: DataFrame, prefix: str = "RING", fraud_only: bool = False, min_fraud_score: float = S.MIN_FRAUD_SCORE, source_approach: str | None = None) -> DataFrame:
    """The same for rings that are aggregated already."""
    out = classify(found, min_fraud_score)
    if fraud_only:
        out = out.where("is_fraud_ring")
    out = numbered(out, [F.desc("total_amount"), F.desc("cycles"), F.desc("participant_count"), F.col("participants")], prefix)
    if source_approach:
        out = out.withColumn("source_approach", F.lit(source_approach))
    out = out.withColumn("total_amount", S.round_half_even(F.col("total_amount"), 2))
    return out.select(*FIELDS, *[c for c in out.columns if c not in FIELDS and c != "_number"])


def _by_number() -> list:
    """Order of the numbers in ring ids, which have four digits or more."""
    return [F.length("ring_id"), F.col("ring_id")]


def ring_tables(rings: DataFrame, top: int = 500) -> tuple[DataFrame, DataFrame]:
    """(rings, members): the `top` by score, and their accounts with positions."""
    best = rings.orderBy(F.desc("fraud_score"), *_by_number()).limit(top)
    return best.drop("participants"), best.select("ring_id", F.posexplode("participants").alias("position", "account_id"))


def read_back(rings: DataFrame, members: DataFrame) -> DataFrame:
    """Rings with their accounts in order of position, by score."""
    own = members.groupBy("ring_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("position", "account_id"))), lambda x: x["account_id"]).alias("participants"))
    return rings.join(own, "ring_id").orderBy(F.desc("fraud_score"), *_by_number())


def evaluate(candidates: DataFrame, truth: DataFrame, min_jaccard: float = 1.0) -> DataFrame:
    """One row: true and false positives, false negatives, precision, recall, F1. A candidate is right if the Jaccard index of its accounts and a true ring's reaches
    min_jaccard (1: equal sets); rings without any right candidate are missed. Only pairs that share an account are compared."""
    c = candidates.select(F.array_sort(F.array_distinct("participants")).alias("p")).distinct().withColumn("cid", F.array_join("p", "|"))
    t = truth.select(F.array_sort(F.array_distinct("participants")).alias("p")).distinct().withColumn("tid", F.array_join("p", "|"))
    shared = c.select("cid", F.size("p").alias("cn"), F.explode("p").alias("a")).join(t.select("tid", F.size("p").alias("tn"), F.explode("p").alias("a")), "a")
    near = shared.groupBy("cid", "cn", "tid", "tn").agg(F.count("*").alias("n")).where(F.col("n") / (F.col("cn") + F.col("tn") - F.col("n")) >= min_jaccard)
    sums = near.agg(F.count_distinct("cid").alias("tp"), F.count_distinct("tid").alias("found"))
    out = sums.crossJoin(c.agg(F.count("*").alias("nc"))).crossJoin(t.agg(F.count("*").alias("nt")))
    precision, recall = F.when(F.col("nc") > 0, F.col("tp") / F.col("nc")), F.when(F.col("nt") > 0, F.col("found") / F.col("nt"))
    return out.select("tp", (F.col("nc") - F.col("tp")).alias("fp"), (F.col("nt") - F.col("found")).alias("fn"), precision.alias("precision"), recall.alias("recall"), F.when(precision + recall > 0, 2 * precision * recall / (precision + recall)).alias("f1"))
