"""The detection runs: pair-aggregated cycles, strong components, cycles inside components, and the unaggregated baseline. Each gives its tables and a summary."""

from __future__ import annotations

import time
from collections.abc import Sequence
from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scoring import group_score
from ..operators import cycles as C
from ..operators import edges as E
from ..operators import merge as M
from ..operators import metrics as X
from ..operators import scc as S
from ..operators.rings import numbered
from . import control
from .scratch import Rounds

MODES = ("aggregate", "transactions")


@dataclass
class Result:
    raw: DataFrame
    merged: DataFrame | None
    summary: dict[str, Any]


def transactions_mode(transfers: DataFrame, accounts: DataFrame, k: int, limit: int = 0, min_pair_transactions: int = 0, min_pair_amount: float = 0.0, min_internal_transactions: int = 0, min_total_amount: float = 0.0) -> DataFrame:
    """Cycles in every rotation with measures of all transfers among their accounts (chords, self-loops), by amount; ties by participants."""
    found = C.cycles(E.edges(transfers), k, min_pair_transactions, min_pair_amount).select("participants", "cycle_size", "cycles", "metrics_are_group_level")
    keyed = found.withColumn("set_key", F.array_join(F.array_sort("participants"), "|"))
    sets = keyed.select("set_key", F.array_sort("participants").alias("participants")).distinct()
    made = X.transaction_metrics(sets, transfers, accounts)
    made = made.where((F.col("transactions") >= min_internal_transactions) & (F.col("total_amount") >= min_total_amount))
    out = C.rotations(keyed, k).join(made, "set_key").drop("set_key").orderBy(F.desc("total_amount"), "participants")
    return out.limit(limit) if limit > 0 else out


def graph_stats(accounts: DataFrame, transfers: DataFrame) -> dict[str, Any]:
    """Accounts, transactions, ordered pairs, edges and density, as a summary has them."""
    r = E.graph_stats(accounts, transfers).first()
    return {"nodes": r["accounts"], "transactions": r["transactions"], "logical_pairs": r["logical_pairs"], "edges": r["edges"], "density": round(r["density"], 6)}


def head(rows: DataFrame, n: int = 10) -> list[dict[str, Any]]:
    """The first rows in their order, for a summary."""
    return [r.asDict(recursive=True) for r in rows.limit(n).collect()]


def _ms(since: float) -> float:
    return round((time.perf_counter() - since) * 1000, 3)


def detect(accounts: DataFrame, transfers: DataFrame, sizes: Sequence[int] = (3, 5, 8), limit: int = 500, min_pair_transactions: int = 0, min_pair_amount: float = 0.0, min_internal_transactions: int = 0, min_total_amount: float = 0.0, merge: bool = True, mode: str = "aggregate", query_timeout: float = 0.0, edges: DataFrame | None = None) -> Result:
    """Cycles of the sizes, merged, with a summary. edges: the stored edge table, where there is one; else edges are made from the transfers."""
    if mode not in MODES:
        raise ValueError(f"mode must be one of {MODES}")
    spark, began = transfers.sparkSession, time.perf_counter()
    rounds, sizes = Rounds(spark, "detect"), C.check_sizes(sizes)
    options = {"min_pair_transactions": min_pair_transactions, "min_pair_amount": min_pair_amount, "min_internal_transactions": min_internal_transactions, "min_total_amount": min_total_amount, "limit": limit}
    table = rounds.keep(E.threshold(E.edges(transfers) if edges is None else edges, min_pair_transactions, min_pair_amount)) if mode == "aggregate" else None
    load_ms, began_detect, parts = _ms(began), time.perf_counter(), []
    for k in sizes:
        with control.time_limit(spark, query_timeout):
            found = C.first_cycles(table, k, **options) if mode == "aggregate" else transactions_mode(transfers, accounts, k, **options)
            parts.append(rounds.keep(found.withColumn("total_amount", F.col("total_amount").cast("double"))))
    raw = parts[0]
    for p in parts[1:]:
        raw = raw.unionByName(p, allowMissingColumns=True)
    per_size = {r["cycle_size"]: r["n_cycles"] for r in C.count_by_size(raw).collect()}
    merged = rounds.keep(M.merge_records(raw)) if merge and not raw.isEmpty() else None
    out = M.ordered_merged(merged) if merged is not None else raw
    summary = {
        "approach": "pair_aggregated_cycles_label_blind", "graph_stats": graph_stats(accounts, transfers),
        "parameters": {"cycle_sizes": list(sizes), "limit_per_size": limit, "merge_overlapping": merge, "graph_mode": mode, "query_timeout_seconds": query_timeout} | {k: v for k, v in options.items() if k != "limit"},
        "raw_result_count": sum(per_size.values()), "unique_participant_sets": raw.select(F.array_sort("participants")).distinct().count(), "merged_result_count": merged.count() if merged is not None else sum(per_size.values()),
        "results_by_cycle_size": {str(k): per_size.get(k, 0) for k in sizes}, "load_elapsed_ms": load_ms, "detect_elapsed_ms": _ms(began_detect), "sample_results": head(out), "elapsed_ms": _ms(began),
    }
    return Result(raw, out, summary)


def components(accounts: DataFrame, transfers: DataFrame, min_size: int = 3, max_size: int = 12, limit: int = 0) -> DataFrame:
    """Strong components in the size band with measures over all transfers inside; self-loops count in the graph."""
    labels = S.strong_components(E.pairs(transfers), E.account_ids(accounts))
    groups = S.ordered(S.grouped(labels, min_size, max_size), limit)
    made = X.enrichment(groups, transfers)
    out = groups.join(made, "component_id").withColumn("cycle_size", F.col("participant_count")).withColumn("cycles", F.lit(1).cast("long")).withColumn("method", F.lit("strong_components")).withColumn("metrics_are_group_level", F.lit(True))
    return out.orderBy(F.desc("participant_count"), "component_id")


def component_cycles(accounts: DataFrame, transfers: DataFrame, sizes: Sequence[int] = (3, 5, 8), min_size: int = 3, max_size: int = 12, min_internal_transactions: int = 0, min_total_amount: float = 0.0) -> DataFrame:
    """Every simple cycle of the sizes inside strong components of the size band, with measures of its accounts' inner graph and a score.
    A cycle lies in one component, so all others go before any cycle is looked for."""
    sizes = [k for k in C.check_sizes(sizes, 2) if k >= min_size]
    rounds = Rounds(transfers.sparkSession, "inner")
    table = rounds.keep(E.edges(transfers))
    labels = rounds.keep(S.strong_components(table.select("src", "dst"), E.account_ids(accounts)))
    inner = rounds.keep(S.inner_edges(table, labels, min_size, max_size))
    if not sizes:
        sizes, inner = [2], inner.where("false")
    found = C.cycles_of(inner, sizes, least=2).select(F.col("participants").alias("path"), "cycle_size", "cycles")
    keyed = found.withColumn("participants", F.array_sort("path")).withColumn("set_key", F.array_join("participants", "|"))
    sets = keyed.select("set_key", "participants").distinct()
    made = X.simple_graph_metrics(sets, table, E.nodes(accounts))
    out = keyed.join(made, "set_key").withColumn("participant_count", F.size("participants")).drop("set_key")
    out = out.withColumn("score", group_score(F.col("participant_count"), F.col("total_amount"), F.col("avg_risk"), F.col("density"), F.col("avg_activity")))
    return out.where((F.col("transactions") >= min_internal_transactions) & (F.bround(F.col("total_amount").cast("double"), 3) >= min_total_amount))


def merged_component_cycles(raw: DataFrame, accounts: DataFrame, transfers: DataFrame, limit: int = 0) -> DataFrame:
    """Clusters by score. component_id numbers them before that, in the order of their accounts."""
    merged = M.merge_measured(raw, E.edges(transfers), E.nodes(accounts))
    out = numbered(merged, [F.col("participants")], "HYBRID_V02_COMPONENT", "component_id").drop("_number").orderBy(F.desc("score"), F.desc("total_amount"), F.desc("participant_count"), "participants")
    return out.limit(limit) if limit > 0 else out


def component_summary(accounts: DataFrame, transfers: DataFrame, found: DataFrame, parameters: dict[str, Any], began: float) -> dict[str, Any]:
    return {"approach": "strong_components_label_blind", "parameters": parameters, "graph_stats": graph_stats(accounts, transfers), "result_count": found.count(), "sample_results": head(found), "elapsed_ms": _ms(began)}


def inner_summary(accounts: DataFrame, transfers: DataFrame, raw: DataFrame, merged: DataFrame, sizes: Sequence[int], began: float) -> dict[str, Any]:
    per_size = {r["cycle_size"]: r["n_cycles"] for r in C.count_by_size(raw).collect()}
    return {
        "approach": "component_cycles_label_blind", "graph_stats": graph_stats(accounts, transfers), "parameters": {"cycle_sizes": list(sizes)}, "raw_result_count": sum(per_size.values()),
        "unique_participant_sets": raw.select(F.array_sort("participants")).distinct().count(), "merged_result_count": merged.count(), "results_by_cycle_size": {str(k): per_size.get(k, 0) for k in sizes},
        "sample_results": head(merged), "elapsed_ms": _ms(began),
    }


def baseline(transfers: DataFrame, k: int, path: str, timeout: float = 900.0, skip: bool = False) -> dict[str, Any]:
    """The unaggregated paths of one size, written as they are found; a limit gives a status instead of an error, and rows are then those that had been written: all of finished tasks."""
    from ..sources.files import count_lines, write_jsonl

    spark = transfers.sparkSession
    done = control.guarded(spark, lambda: write_jsonl(C.transaction_paths(transfers, k), path, keep_finished=True), timeout, skip)
    rows = 0 if skip else done["result"] if done["result"] is not None else count_lines(spark, path)
    return {"cycle_size": k, "status": done["status"], "rows": rows, "elapsed_ms": done["elapsed_ms"], "error": done["error"]}
