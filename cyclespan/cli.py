"""Command line: detect, components, inner, baseline, fragmentation, generate, rings."""

from __future__ import annotations

import argparse
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import cycles as C
from .operators import edges as E
from .operators import generator, merge, rings
from .plans import control, detect
from .plans.scratch import Rounds
from .sources import edge_store, files, schema, transfers


def sizes(text: str) -> tuple[int, ...]:
    return tuple(sorted({int(x) for x in text.split(",") if x.strip()}))


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="cyclespan", description=__doc__)
    sub = p.add_subparsers(dest="command", required=True)
    for name in ("detect", "components", "inner", "baseline"):
        s = sub.add_parser(name)
        s.add_argument("--dataset-dir", required=True, help="folder of accounts.csv and transactions.csv")
        s.add_argument("--cycle-sizes", type=sizes, default=(3, 5, 8))
        s.add_argument("--limit", type=int, default=500 if name == "detect" else 0)
        s.add_argument("--min-pair-transactions", type=int, default=3)
        s.add_argument("--min-pair-amount", type=float, default=0.0)
        s.add_argument("--min-internal-transactions", type=int, default=0)
        s.add_argument("--min-total-amount", type=float, default=0.0)
        s.add_argument("--min-component-size", type=int, default=3)
        s.add_argument("--max-component-size", type=int, default=12)
        s.add_argument("--graph-mode", choices=detect.MODES, default="aggregate")
        s.add_argument("--no-merge", action="store_true")
        s.add_argument("--query-timeout", type=float, default=900.0 if name == "baseline" else 0.0)
        s.add_argument("--cycle8-timeout", type=float, default=60.0)
        s.add_argument("--skip-cycle8", action="store_true")
        s.add_argument("--progress-interval", type=float, default=30.0)
        s.add_argument("--quiet", action="store_true")
        s.add_argument("--dry-run", action="store_true", help="print the plan, run nothing")
        s.add_argument("--raw-out"), s.add_argument("--merged-out"), s.add_argument("--json-out")
        if name == "detect":
            s.add_argument("--edge-table", help="folder of the stored edges; detection reads them instead of summing all transfers")
            s.add_argument("--prepare-aggregates", action="store_true", help="write the edge table first")
            s.add_argument("--keep-existing-aggregates", action="store_true", help="leave stored pairs that the transfers lack")
            s.add_argument("--aggregate-batch-size", type=int, default=edge_store.PARTS, help="parts of the edge table written at once")
    s = sub.add_parser("fragmentation")
    s.add_argument("--raw-jsonl", required=True), s.add_argument("--json-out")
    s = sub.add_parser("rings")
    s.add_argument("--raw-jsonl", required=True), s.add_argument("--out", required=True)
    s.add_argument("--prefix", default="RING"), s.add_argument("--strict", action="store_true"), s.add_argument("--fraud-only", action="store_true"), s.add_argument("--min-fraud-score", type=float, default=0.35)
    s = sub.add_parser("generate")
    s.add_argument("--preset", choices=sorted(generator.PRESETS)), s.add_argument("--config"), s.add_argument("--out", required=True)
    return p


def dry_run(a: argparse.Namespace, accounts: DataFrame, moves: DataFrame, limits: dict) -> list[tuple[str, DataFrame]]:
    """What a subcommand would run, by name. Iterative operators have no single plan: what their rounds start from stands for them."""
    if a.command == "components":
        return [("graph of the strong components", E.pairs(moves)), ("measures of all transfers of a pair", moves.groupBy("src", "dst").agg(F.count("*").alias("n"), F.sum("amount").alias("amt")))]
    if a.command == "inner":
        return [("edges", E.edges(moves)), ("nodes", E.nodes(accounts))] + [(f"cycles of {k} inside a component", C.cycles(E.edges(moves), k, least=2)) for k in a.cycle_sizes]
    if a.command == "baseline":
        return [(f"cycles whose paths of {k} transactions are unfolded", C.cycles(E.edges(moves), k, least=2)) for k in a.cycle_sizes]
    if a.graph_mode == "transactions":
        return [(f"cycles of {k} with measures of all transfers", detect.transactions_mode(moves, accounts, k, a.limit, a.min_pair_transactions, a.min_pair_amount, **limits)) for k in a.cycle_sizes]
    return [(f"cycles of {k}", C.cycles(E.edges(moves), k, a.min_pair_transactions, a.min_pair_amount, limit=a.limit, **limits)) for k in a.cycle_sizes]


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    a = parser().parse_args(argv)
    spark = spark or SparkSession.builder.appName("cyclespan").getOrCreate()
    if a.command == "generate":
        c = generator.from_document(files.load_config(a.config)) if a.config else generator.PRESETS[a.preset or "d1"]
        data = generator.generate(spark, c)
        bad = [r["check_name"] for r in generator.validate(data, c).collect() if not r["passed"]]
        if bad:
            raise ValueError(f"failed checks: {bad}")
        for name in ("accounts", "merchants", "transactions"):
            files.write_csv(data[name], f"{a.out}/{name}.csv")
        files.write_rings_document(data["rings"], f"{a.out}/fraud_rings.json")
        return 0
    if a.command == "fragmentation":
        rows = merge.fragmentation(files.read_jsonl(spark, a.raw_jsonl)).collect()
        out = {"total": {}, "by_cycle_size": {}}
        for r in rows:
            d = {k: round(v, 6) if isinstance(v, float) else v for k, v in r.asDict().items() if k != "scope"}
            if r["scope"] == "total":
                out["total"] = d
            else:
                out["by_cycle_size"][r["scope"]] = d
        if a.json_out:
            files.write_document(spark, out, a.json_out)
        print(files.as_document(out))
        return 0
    if a.command == "rings":
        made = rings.rings(files.read_jsonl(spark, a.raw_jsonl), a.prefix, a.strict, a.fraud_only, a.min_fraud_score)
        print(files.write_jsonl(made, a.out))
        return 0
    accounts, moves = transfers.label_blind(files.read_csv(spark, f"{a.dataset_dir}/accounts.csv", schema.ACCOUNTS), files.read_csv(spark, f"{a.dataset_dir}/transactions.csv", schema.TRANSACTIONS))
    limits = {"min_internal_transactions": a.min_internal_transactions, "min_total_amount": a.min_total_amount}
    if a.dry_run:
        for name, df in dry_run(a, accounts, moves, limits):
            print(f"-- {name}\n{control.plan_text(df)}")
        return 0
    began, edges = time.perf_counter(), None
    if a.command == "detect" and a.edge_table:
        if a.prepare_aggregates or not edge_store.exists(spark, a.edge_table):
            n = edge_store.prepare(moves, a.edge_table, not a.keep_existing_aggregates, a.aggregate_batch_size)
            control.log_line(f"{n} pairs written to the edge table")
        edges = edge_store.load(spark, a.edge_table)
    with control.heartbeat(spark, a.command, 0 if a.quiet else a.progress_interval):
        if a.command == "detect":
            r = detect.detect(accounts, moves, a.cycle_sizes, a.limit, a.min_pair_transactions, a.min_pair_amount, merge=not a.no_merge, mode=a.graph_mode, query_timeout=a.query_timeout, edges=edges, **limits)
            for path, df in ((a.raw_out, r.raw), (a.merged_out, r.merged)):
                if path:
                    files.write_jsonl(df, path)
            summary = r.summary
        elif a.command == "components":
            found = detect.components(accounts, moves, a.min_component_size, a.max_component_size, a.limit)
            found = files.with_defaults(found, "GDS", "scc_candidate", "strong_components_label_blind", [F.desc("participant_count"), F.col("component_id")], "strongly_connected_component")
            found = Rounds(spark, "found").keep(found).orderBy(F.desc("participant_count"), "component_id")
            if a.raw_out:
                files.write_jsonl(found, a.raw_out)
            summary = detect.component_summary(accounts, moves, found, {"min_component_size": a.min_component_size, "max_component_size": a.max_component_size, "limit": a.limit}, began)
        elif a.command == "inner":
            raw = Rounds(spark, "raw").keep(detect.component_cycles(accounts, moves, a.cycle_sizes, a.min_component_size, a.max_component_size, **limits))
            merged = detect.merged_component_cycles(raw, accounts, moves, a.limit)
            order = [F.desc("score"), F.desc("total_amount"), F.desc("participant_count"), F.col("participants")]
            merged = files.with_defaults(merged, "HYBRID_V02", "detected_cycle_component", "component_cycles_label_blind", order)
            merged = Rounds(spark, "merged").keep(merged).orderBy(*order)
            for path, df in ((a.raw_out, raw), (a.merged_out, merged)):
                if path:
                    files.write_jsonl(df, path)
            summary = detect.inner_summary(accounts, moves, raw, merged, a.cycle_sizes, began)
        else:
            runs = [detect.baseline(moves, k, f"{a.raw_out}/k{k}", a.cycle8_timeout if k == 8 else a.query_timeout, a.skip_cycle8 and k == 8) for k in a.cycle_sizes]
            summary = {"runs": runs}
    if a.json_out:
        files.write_document(spark, summary, a.json_out)
    print(files.as_document(summary))
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
