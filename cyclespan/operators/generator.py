"""Synthetic accounts and transactions with planted rings.

Every draw is a hash of (seed, what it is for, row number), so rows are made where they are needed, in any number of partitions, and
always alike. The distributions and budgets are those of the presets; the rows are not those of any other generator.
Account, merchant and ring details that the presets leave open are this module's own design.
"""

from __future__ import annotations

import copy
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scoring import date_parts, to_usd
from .edges import normal_accounts

CHANNELS = {"online": 0.50, "mobile": 0.35, "atm": 0.10, "branch": 0.05}
STRATEGIES = ("outbound", "inbound", "alternate_by_ring")


@dataclass
class RingProfile:
    """Rings of one size."""

    count: int
    members: int
    cycles: tuple[int, int]
    amount: tuple[float, float]


@dataclass
class Config:
    """A data set's parameters; the defaults are those all presets share."""

    normal_accounts: int
    total_transactions: int
    rings: dict[str, RingProfile]
    merchants: int = 200
    seed: int = 42
    normal_ratio: float = 0.95
    start: str = "2025-10-01"
    end: str = "2025-12-31"
    bridges_per_ring: int = 2
    strategy: str = "alternate_by_ring"
    bridges_enabled: bool = True
    bridge_amount: tuple[float, float] = (50.0, 50_000.0)
    amount_mean: float = 1500.0
    amount_std: float = 500.0
    amount_range: tuple[float, float] = (50.0, 50_000.0)
    business_hours: float = 0.85
    currencies: dict[str, float] = field(default_factory=lambda: {"VND": 0.70, "USD": 0.20, "EUR": 0.10})
    rates: dict[str, float] = field(default_factory=lambda: {"VND_to_USD": 25000.0, "EUR_to_USD": 1.08, "GBP_to_USD": 1.27})
    escalation: float = 1.05
    max_fraud_ratio: float = 0.10

    @property
    def background(self) -> int:
        return int(self.total_transactions * self.normal_ratio)

    @property
    def ring_accounts(self) -> int:
        return sum(p.count * p.members for p in self.rings.values())

    @property
    def ring_count(self) -> int:
        return sum(p.count for p in self.rings.values())

    @property
    def bridges(self) -> int:
        return self.ring_count * self.bridges_per_ring if self.bridges_enabled and self.bridges_per_ring > 0 else 0


def _profiles(small: int, medium: int, large: int, once: bool = False) -> dict[str, RingProfile]:
    c = (lambda a, b: (1, 1)) if once else (lambda a, b: (a, b))
    return {"small": RingProfile(small, 3, c(5, 10), (15_000.0, 50_000.0)), "medium": RingProfile(medium, 5, c(8, 15), (75_000.0, 150_000.0)), "large": RingProfile(large, 8, c(10, 20), (200_000.0, 350_000.0))}


# Sizes of the named data sets.
PRESETS = {
    "d1": Config(26, 20, _profiles(2, 2, 1, once=True), max_fraud_ratio=0.90),
    "academic": Config(5_000, 50_000, _profiles(15, 20, 10)),
    "d3": Config(100_000, 900_000, _profiles(3, 5, 2)),
    "d4": Config(10_000, 90_000, _profiles(3, 5, 2)),
    "d5": Config(100_000, 900_000, _profiles(3, 5, 2)),
}


def from_document(doc: dict) -> Config:
    """A Config from a data set's YAML document."""
    s = doc["synthetic_data"]
    ch, dist, link, rules = s["fraud_rings"]["ring_characteristics"], s["fraud_rings"]["ring_distribution"], s.get("background_connectivity", {}), s.get("normal_transaction_rules", {})
    rings = {
        name: RingProfile(int(dist[key]), int(ch[name]["participant_count"]), (int(ch[name].get("cycles_per_ring_min", 1)), int(ch[name].get("cycles_per_ring_max", 1))), (float(ch[name].get("total_amount_min", 1000)), float(ch[name].get("total_amount_max", 5000))))
        for name, key in (("small", "small_rings_3person"), ("medium", "medium_rings_5person"), ("large", "large_rings_8person"))
    }
    c = Config(int(s["accounts"]["normal_account_count"]), int(s["total_transactions"]), rings, int(s["accounts"].get("merchant_count", 0)), int(s.get("seed", 42)))
    c.normal_ratio = float(s["transactions"]["normal_transaction_ratio"])
    c.start, c.end = str(s["start_date"]), str(s["end_date"])
    c.bridges_enabled, c.bridges_per_ring, c.strategy = bool(link.get("enabled", False)), int(link.get("bridges_per_ring", 1)), link.get("direction_strategy", "alternate_by_ring")
    c.amount_mean, c.amount_std = float(rules.get("amount_mean", c.amount_mean)), float(rules.get("amount_std", c.amount_std))
    c.amount_range = (float(rules.get("amount_min", 50)), float(rules.get("amount_max", 50_000)))
    c.business_hours = float(rules.get("business_hours_probability", c.business_hours))
    c.bridge_amount = (float(link.get("amount_min", c.amount_range[0])), float(link.get("amount_max", c.amount_mean)))
    c.max_fraud_ratio = float(s.get("validation", {}).get("max_fraud_ratio", c.max_fraud_ratio))
    c.currencies, c.rates = dict(s["transactions"]["amounts"]["currency_distribution"]), {k: float(v) for k, v in s["transactions"]["exchange_rates"].items()}
    return c


def draw(seed: int, what: str, row: Column) -> Column:
    """Uniform in [0, 1), by hash."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.lit(what), row), 11) / float(1 << 53)


def below(seed: int, what: str, row: Column, n: Column | int) -> Column:
    """A whole number in [0, n)."""
    return F.floor(draw(seed, what, row) * n).cast("long")


def normal(seed: int, what: str, row: Column) -> Column:
    """Standard normal, by Box and Muller."""
    return F.sqrt(-2.0 * F.log(1.0 - draw(seed, what + "/r", row))) * F.cos(draw(seed, what + "/a", row) * 6.283185307179586)


def choice(seed: int, what: str, row: Column, shares: dict[str, float]) -> Column:
    u, total, out = draw(seed, what, row) * sum(shares.values()), 0.0, None
    for name, share in list(shares.items())[:-1]:
        total += share
        out = F.when(u < total, name) if out is None else out.when(u < total, name)
    last = list(shares)[-1]
    return F.lit(last) if out is None else out.otherwise(last)


def accounts(spark: SparkSession, c: Config) -> DataFrame:
    """Normal accounts, then ring accounts: risks lean low for the one, high for the other."""
    n, ring = c.normal_accounts, c.ring_accounts
    i = F.col("id")
    member = i >= n
    # The least of several draws leans low as a beta distribution does; the greatest, high.
    draws = [draw(c.seed, f"risk{k}", i) for k in range(4)]
    risk = F.when(member, F.greatest(draws[0], draws[1])).otherwise(F.least(*draws))
    mean = F.when(member, 20.0).otherwise(40.0)
    monthly = F.greatest(F.lit(0), F.round(mean + F.sqrt(mean) * normal(c.seed, "monthly", i))).cast("long")
    age = F.when(member, 10 + below(c.seed, "age", i, 291)).otherwise(30 + below(c.seed, "age", i, 1971))
    limit = F.element_at(F.when(member, F.array(*map(F.lit, (25_000, 50_000, 100_000)))).otherwise(F.array(*map(F.lit, (10_000, 25_000, 50_000, 100_000)))), (below(c.seed, "limit", i, F.when(member, 3).otherwise(4)) + 1).cast("int"))
    rows = spark.range(n + ring)
    return rows.select(
        F.format_string("ACC_%08d", i).alias("account_id"), F.bround(risk, 4).alias("kyc_risk_score"), monthly.alias("monthly_transaction_count"), age.alias("account_age_days"),
        limit.cast("long").alias("daily_limit"), member.alias("fraud_ring_member"),
    )


def merchants(spark: SparkSession, c: Config) -> DataFrame:
    i = F.col("id")
    return spark.range(c.merchants).select(F.format_string("MER_%06d", i).alias("merchant_id"), (i < min(50, c.merchants)).alias("high_risk"))


def rings(spark: SparkSession, c: Config) -> DataFrame:
    """(ring_index, ring_id, participants, cycles, total_amount): the planted rings, on the accounts after the normal ones. Their number is the configuration's."""
    made, at = [], c.normal_accounts
    for p in c.rings.values():
        for _ in range(p.count):
            made.append((len(made), f"RING_{len(made):04d}", [f"ACC_{k:08d}" for k in range(at, at + p.members)], *p.cycles, *p.amount))
            at += p.members
    rows = spark.createDataFrame(made, "ring_index long, ring_id string, participants array<string>, c0 int, c1 int, x0 double, x1 double")
    i = F.col("ring_index")
    cycles = (F.col("c0") + below(c.seed, "cycles", i, F.col("c1") - F.col("c0") + 1)).cast("int")
    return rows.select("ring_index", "ring_id", "participants", cycles.alias("cycles"), F.bround(F.col("x0") + draw(c.seed, "ring", i) * (F.col("x1") - F.col("x0")), 2).alias("total_amount"))


def _moment(c: Config, what: str, row: Column) -> Column:
    days = F.greatest(F.datediff(F.lit(c.end), F.lit(c.start)), F.lit(1))
    hour = F.when(draw(c.seed, what + "/business", row) < c.business_hours, 8 + below(c.seed, what + "/hour", row, 10)).otherwise(below(c.seed, what + "/hour", row, 24))
    seconds = below(c.seed, what + "/day", row, days) * 86_400 + hour * 3_600 + below(c.seed, what + "/minute", row, 60) * 60
    return F.timestamp_seconds(F.unix_timestamp(F.lit(c.start + " 00:00:00")) + seconds).cast("timestamp_ntz")


def _record(row_id: Column, src: Column, dst: Column, usd: Column, original: Column, currency: Column, ts: Column, channel: Column, kind: str, is_fraud: int, ring: Column) -> list[Column]:
    day, hour = date_parts(ts)
    return [
        F.format_string("TXN_%09d", row_id).alias("transaction_id"), src.alias("source_account"), dst.alias("destination_account"), F.bround(usd, 2).cast("decimal(18,2)").alias("amount_usd"),
        F.bround(original, 2).cast("decimal(18,2)").alias("original_amount"), currency.alias("original_currency"), ts.alias("timestamp"), day.alias("date"), hour.alias("hour"), channel.alias("channel"),
        F.lit(kind).alias("transaction_type"), F.lit(is_fraud).alias("is_fraud"), ring.cast("string").alias("fraud_ring_id"),
    ]


def normal_transactions(spark: SparkSession, c: Config, count: int) -> DataFrame:
    """count transfers between different normal accounts, both uniform: the second is a step of 1 to n-1 from the first, so nothing is drawn twice."""
    n = c.normal_accounts
    if n < 2 and count:
        raise ValueError("At least two normal accounts are required")
    i = F.col("id")
    a = below(c.seed, "src", i, n)
    b = (a + 1 + below(c.seed, "dst", i, max(n - 1, 1))) % max(n, 1)
    amount = F.least(F.greatest(F.exp(F.log(F.lit(c.amount_mean)) + c.amount_std / c.amount_mean * normal(c.seed, "amount", i)), F.lit(c.amount_range[0])), F.lit(c.amount_range[1]))
    currency = choice(c.seed, "currency", i, c.currencies)
    return spark.range(count).select(*_record(i + 1, F.format_string("ACC_%08d", a), F.format_string("ACC_%08d", b), to_usd(amount, currency, c.rates), amount, currency, _moment(c, "normal", i), choice(c.seed, "channel", i, CHANNELS), "p2p", 0, F.lit(None)))


def bridge_transactions(rings: DataFrame, c: Config, first_id: int) -> DataFrame:
    """bridges_per_ring transfers between each ring and normal accounts, all of a ring's in one direction."""
    if c.strategy not in STRATEGIES:
        raise ValueError(f"unknown direction strategy: {c.strategy}")
    empty = rings.where(F.size("participants") <= 0).limit(1).collect()
    if empty:
        raise ValueError(f"ring {empty[0]['ring_id']} has no participants")
    per = c.bridges_per_ring if c.bridges_enabled else 0
    rows = rings.withColumn("_k", F.explode(F.sequence(F.lit(0), F.lit(max(per, 1) - 1)))).where(F.lit(per > 0))
    row = F.col("ring_index") * max(per, 1) + F.col("_k")
    own = F.element_at("participants", (below(c.seed, "bridge/own", row, F.size("participants")) + 1).cast("int"))
    other = F.format_string("ACC_%08d", below(c.seed, "bridge/other", row, c.normal_accounts))
    outbound = {"outbound": F.lit(True), "inbound": F.lit(False), "alternate_by_ring": F.col("ring_index") % 2 == 0}[c.strategy]
    amount = c.bridge_amount[0] + draw(c.seed, "bridge/amount", row) * (c.bridge_amount[1] - c.bridge_amount[0])
    return rows.select(*_record(row + first_id, F.when(outbound, own).otherwise(other), F.when(outbound, other).otherwise(own), amount, amount, F.lit("USD"), _moment(c, "bridge", row), choice(c.seed, "bridge/channel", row, CHANNELS), "background_bridge", 0, F.lit(None)))


def background_transactions(spark: SparkSession, c: Config, rings: DataFrame) -> DataFrame:
    """Normal transfers and bridges; bridges take their share of the same budget."""
    if c.bridges > c.background:
        raise ValueError(f"{c.bridges} bridges exceed the budget of {c.background} background transactions")
    core = c.background - c.bridges
    return normal_transactions(spark, c, core).unionByName(bridge_transactions(rings, c, core + 1))


def ring_transactions(rings: DataFrame, c: Config, first_id: int) -> DataFrame:
    """Each ring's cycles, one transfer for each step, amounts growing from cycle to cycle."""
    steps = rings.select("*", F.explode(F.sequence(F.lit(0), F.col("cycles") - 1)).alias("_c")).select("*", F.posexplode("participants").alias("_p", "_src"))
    dst = F.element_at("participants", ((F.col("_p") + 1) % F.size("participants") + 1).cast("int"))
    row = F.col("ring_index") * 100_000 + F.col("_c") * 100 + F.col("_p")
    base = F.col("total_amount") / (F.col("cycles") * F.size("participants"))
    amount = base * F.pow(F.lit(c.escalation), F.col("_c") - (F.col("cycles") - 1) / 2)
    # Ids go on by ring, cycle and step: the rings before this one are known by their sizes.
    before = rings.select("ring_index", (F.col("cycles") * F.size("participants")).alias("n"))
    sizes = {r["ring_index"]: r["n"] for r in before.collect()}  # one number for each planted ring
    total, starts = 0, []
    for k in sorted(sizes):
        starts.append((k, total))
        total += sizes[k]
    offset = rings.sparkSession.createDataFrame(starts or [(0, 0)], "ring_index long, _before long")
    number = F.col("_before") + F.col("_c") * F.size("participants") + F.col("_p") + first_id
    return steps.join(F.broadcast(offset), "ring_index").select(*_record(number, F.col("_src"), dst, amount, amount, F.lit("USD"), _moment(c, "ring", row), F.lit("peer_to_peer"), "fraud_ring", 1, F.col("ring_id")))


def generate(spark: SparkSession, config: Config | str) -> dict[str, DataFrame]:
    """accounts, merchants, rings and transactions of a data set; transactions carry labels, which detection never reads."""
    c = copy.deepcopy(PRESETS[config]) if isinstance(config, str) else config
    planted = rings(spark, c)
    background = background_transactions(spark, c, planted)
    fraud = ring_transactions(planted, c, c.background + 1)
    return {"accounts": accounts(spark, c), "merchants": merchants(spark, c), "rings": planted, "transactions": background.unionByName(fraud)}


def shuffled(df: DataFrame, seed: int, column: str = "transaction_id") -> DataFrame:
    """Rows in an order drawn by MD5 of a column and the seed, ties by the column: the same one whatever the partitions."""
    return df.orderBy(F.md5(F.concat_ws(":", F.col(column).cast("string"), F.lit(str(seed)))), column)


def validate(data: dict[str, DataFrame], c: Config) -> DataFrame:
    """(check_name, passed, n_bad) of each check."""
    t, a, r = data["transactions"], data["accounts"], data["rings"]
    start, end = F.lit(c.start).cast("timestamp_ntz"), F.lit(c.end).cast("timestamp_ntz")
    members = r.select("ring_id", F.explode("participants").alias("account_id"))
    fraud = t.where("is_fraud = 1")
    counts = {
        "no_duplicate_ids": t.groupBy("transaction_id").count().where("count > 1").agg(F.count("*").alias("n")),
        "valid_amounts": t.agg(F.count_if(~F.coalesce(F.col("amount_usd") > 0, F.lit(False))).alias("n")),
        "valid_timestamps": t.agg(F.count_if(~F.coalesce(F.col("timestamp").between(start, end), F.lit(False))).alias("n")),
        "fraud_label_consistency": t.agg(F.count_if((F.col("is_fraud") == 1) != F.col("fraud_ring_id").isNotNull()).alias("n")),
        "ring_structure_valid": fraud.join(members.toDF("fraud_ring_id", "source_account"), ["fraud_ring_id", "source_account"], "left_anti").agg(F.count("*").alias("n")),
        "distribution_check": t.agg((F.sum("is_fraud") > c.max_fraud_ratio * F.count("*")).cast("long").alias("n")),
        "known_accounts": t.select(F.explode(F.array("source_account", "destination_account")).alias("account_id")).distinct().join(a, "account_id", "left_anti").agg(F.count("*").alias("n")),
    }
    out = None
    for name, n in counts.items():
        row = n.select(F.lit(name).alias("check_name"), (F.coalesce("n", F.lit(0)) == 0).alias("passed"), F.coalesce("n", F.lit(0)).cast("long").alias("n_bad"))
        out = row if out is None else out.union(row)
    return out


__all__ = ["PRESETS", "Config", "RingProfile", "accounts", "background_transactions", "bridge_transactions", "from_document", "generate", "merchants", "normal_accounts", "normal_transactions", "ring_transactions", "rings", "shuffled", "validate"]
