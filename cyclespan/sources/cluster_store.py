"""Overlap clusters as a stored table that new records are merged into: no record that came before is read again.

What is stored, in each scope (`total`, and every cycle size, within which clusters are found anew): the accounts with the label that their cluster had when they came, the
different sets, and a partial row of measures for each cluster and append. Labels are never rewritten: the merge log says which label each gone one has now. An append links
its own sets and accounts with the labels of accounts that were known, so its connected components are those of a graph of its own size; each joins all labels
that it touches under the least account of them. A cluster's label is its least account, as in a run over all records.

Appends add folders and a new log, and a manifest that is written last makes them a version (versions.py). compact() rewrites all as one append.
"""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.components import connected_components
from ..operators.merge import ratio
from ..operators.metrics import with_set_key
from ..plans.scratch import Rounds
from .versions import Versions

#: Schemas of the stored tables; `amount` has the kind that the first append's total_amount has.
_ACCOUNTS = "scope string, account string, label string"
_SETS = "scope string, set_key string, label string"
_PARTIALS = "scope string, label string, records long, transactions long, total_amount {amount}, cycles long, sizes array<int>"
_LOG = "scope string, label string, now string"
_TABLES = ("accounts", "sets", "partials")


def _schema(kind: str, manifest: dict) -> str:
    return {"accounts": _ACCOUNTS, "sets": _SETS, "partials": _PARTIALS.format(amount=manifest["amount"]), "log": _LOG}[kind]


def _read(spark: SparkSession, versions: Versions, manifest: dict, kind: str) -> DataFrame:
    folders = manifest[kind]
    schema = _schema(kind, manifest)
    if not folders:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(*map(versions.at, folders))


def _named(df: DataFrame, log: DataFrame) -> DataFrame:
    """df with its labels as they are now."""
    return df.join(log, ["scope", "label"], "left").withColumn("label", F.coalesce("now", "label")).drop("now")


def _current(spark: SparkSession, path: str) -> tuple[Versions, dict[str, Any]]:
    versions = Versions(spark, path)
    manifest = versions.read()
    if manifest is None:
        raise FileNotFoundError(f"no cluster table at {path}")
    return versions, manifest


def append(records: DataFrame, path: str) -> int:
    """Merge records (participants, cycle_size, transactions, total_amount, cycles) into the table at path, which is made if it isn't there; the new version's number.
    Null accounts link nothing; records without an account are left out."""
    spark = records.sparkSession
    versions, scratch = Versions(spark, path), Rounds(spark, "clusters")
    amount = dict(records.dtypes)["total_amount"]
    old = versions.read() or {"accounts": [], "sets": [], "partials": [], "log": [], "amount": amount, "folders": []}
    rows = with_set_key(records.where(F.size("participants") > 0))
    size = F.coalesce(F.col("cycle_size").cast("int"), F.size("participants"))
    rows = rows.select(
        F.explode(F.array(F.lit("total"), size.cast("string"))).alias("scope"), "set_key", "participants", F.col("cycle_size").cast("int").alias("size"), F.coalesce("transactions", F.lit(0)).cast("long").alias("transactions"),
        F.coalesce("total_amount", F.lit(0)).cast(old["amount"]).alias("total_amount"), F.when(F.coalesce("cycles", F.lit(0)) == 0, 1).otherwise(F.col("cycles")).cast("long").alias("cycles"),
    )
    # One row for each set: all that its records add up to.
    sets = scratch.keep(rows.groupBy("scope", "set_key").agg(
        F.first("participants").alias("participants"), F.count("*").alias("records"), F.max("transactions").alias("transactions"), F.max("total_amount").alias("total_amount"),
        F.sum("cycles").alias("cycles"), F.collect_set("size").alias("sizes"),
    ))
    ends = sets.select("scope", "set_key", F.explode("participants").alias("account")).where("account is not null")
    log = _read(spark, versions, old, "log")
    mine = ends.select("scope", "account").distinct()
    known = scratch.keep(_named(_read(spark, versions, old, "accounts").join(mine, ["scope", "account"], "left_semi"), log))
    # Nodes: sets, accounts, and labels, each with its scope before it.
    node = lambda kind, c: F.concat(F.lit(kind), F.to_json(F.array("scope", c)))
    links = ends.select(node("s", "set_key").alias("src"), node("a", "account").alias("dst")).union(known.select(node("l", "label"), node("a", "account")))
    linked = scratch.keep(connected_components(links, keep=scratch.keep, drop=scratch.drop))
    part = lambda i: F.from_json(F.substring("node", 2, 1 << 30), "array<string>")[i]
    nodes = linked.select(F.substring("node", 1, 1).alias("kind"), part(0).alias("scope"), part(1).alias("name"), "component")
    # A label is an account's name, so the least name of accounts and labels is the cluster's.
    labels = nodes.where("kind != 's'").groupBy("component").agg(F.min("name").alias("to"))
    named = scratch.keep(nodes.join(labels, "component").select("kind", "scope", "name", "to"))
    moved = named.where("kind = 'l' and name != to").select("scope", F.col("name").alias("label"), F.col("to").alias("now"))
    of_set = named.where("kind = 's'").select("scope", F.col("name").alias("set_key"), F.col("to").alias("label"))
    own = sets.join(of_set, ["scope", "set_key"])
    made = {
        "accounts": named.where("kind = 'a'").select("scope", F.col("name").alias("account"), F.col("to").alias("label")).join(known.select("scope", "account"), ["scope", "account"], "left_anti"),
        "sets": own.select("scope", "set_key", "label").join(_read(spark, versions, old, "sets").select("scope", "set_key"), ["scope", "set_key"], "left_anti"),
        "partials": own.groupBy("scope", "label").agg(F.sum("records").alias("records"), F.max("transactions").alias("transactions"), F.max("total_amount").alias("total_amount"), F.sum("cycles").alias("cycles"), F.array_distinct(F.flatten(F.collect_set("sizes"))).alias("sizes")),
        # What had moved to a label that moves now goes on with it, so that one look is always enough.
        "log": log.join(moved.select("scope", F.col("label").alias("now"), F.col("now").alias("_now")), ["scope", "now"], "left").select("scope", "label", F.coalesce("_now", "now").alias("now")).union(moved),
    }
    return _commit(versions, old, made, {k: old[k] for k in _TABLES})


def _commit(versions: Versions, old: dict, made: dict[str, DataFrame], before: dict[str, list[str]]) -> int:
    manifest = {"amount": old["amount"]}
    for kind, df in made.items():
        folder = versions.folder(kind)
        columns = [c.split()[0] for c in _schema(kind, old).split(", ")]
        df.select(*columns).write.parquet(versions.at(folder))
        manifest[kind] = [*before.get(kind, []), folder]
    manifest["folders"] = [f for kind in made for f in manifest[kind]]
    return versions.commit(manifest)


def compact(spark: SparkSession, path: str) -> int:
    """Rewrite all appends as one, with the labels of now and an empty log."""
    versions, old = _current(spark, path)
    log = _read(spark, versions, old, "log")
    made = {k: _named(_read(spark, versions, old, k), log) for k in ("accounts", "sets")}
    made["partials"] = _summed(_named(_read(spark, versions, old, "partials"), log))
    made["log"] = log.where("false")
    return _commit(versions, old, made, {})


def _summed(partials: DataFrame) -> DataFrame:
    return partials.groupBy("scope", "label").agg(F.sum("records").alias("records"), F.max("transactions").alias("transactions"), F.max("total_amount").alias("total_amount"), F.sum("cycles").alias("cycles"), F.array_distinct(F.flatten(F.collect_set("sizes"))).alias("sizes"))


def clusters(spark: SparkSession, path: str) -> DataFrame:
    """(scope, account, cluster) of all accounts."""
    versions, manifest = _current(spark, path)
    return _named(_read(spark, versions, manifest, "accounts"), _read(spark, versions, manifest, "log")).withColumnRenamed("label", "cluster")


def merged(spark: SparkSession, path: str) -> DataFrame:
    """One row for each cluster, as operators.merge.merge_records gives it for all records that were appended."""
    versions, manifest = _current(spark, path)
    log = _read(spark, versions, manifest, "log")
    sums = _summed(_named(_read(spark, versions, manifest, "partials").where("scope = 'total'"), log))
    own = clusters(spark, path).where("scope = 'total'").groupBy(F.col("cluster").alias("label")).agg(F.array_sort(F.collect_list("account")).alias("participants"))
    out = own.join(sums, "label").select("participants", "transactions", "total_amount", "cycles", F.col("records").alias("fragment_count"), F.array_sort("sizes").alias("candidate_cycle_sizes"))
    out = out.withColumn("participant_count", F.size("participants"))
    return out.withColumn("cycle_size", F.col("participant_count")).withColumn("method", F.lit("overlap_merge"))


def fragmentation(spark: SparkSession, path: str) -> DataFrame:
    """As operators.merge.fragmentation gives it for all records that were appended."""
    versions, manifest = _current(spark, path)
    log = _read(spark, versions, manifest, "log")
    raw = _named(_read(spark, versions, manifest, "partials"), log).groupBy("scope").agg(F.sum("records").alias("raw_cycles"), F.count_distinct("label").alias("merged_clusters"))
    unique = _read(spark, versions, manifest, "sets").groupBy("scope").agg(F.count("*").alias("unique_sets"))
    full = spark.createDataFrame([("total",)], "scope string").join(raw, "scope", "full_outer").join(unique, "scope", "left")
    n = {x: F.coalesce(F.col(x), F.lit(0)).cast("long") for x in ("raw_cycles", "unique_sets", "merged_clusters")}
    return full.select(
        "scope", *[v.alias(k) for k, v in n.items()], ratio(n["raw_cycles"], n["unique_sets"]).alias("ff_enumeration"),
        ratio(n["unique_sets"], n["merged_clusters"]).alias("ff_fragmentation"), ratio(n["raw_cycles"], n["merged_clusters"]).alias("ff_total"),
    )
