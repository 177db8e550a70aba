"""Files, generation, run control, command line, entry points."""

import json
import subprocess
import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from cyclespan import cli
from cyclespan.operators import generator as N
from cyclespan.operators import scc as K
from cyclespan.plans import control
from cyclespan.sources import files
from cyclespan.sources import schema as H

ROOT = Path(__file__).resolve().parent.parent


def test_jsonl(spark, tmp_path):
    p = tmp_path / "x.jsonl"
    p.write_text('{"participants": ["é", "b"], "cycle_size": 2}\n\n  \n{"participants": [], "size": 4, "unknown": 1}\n', encoding="utf-8")
    assert [(r.participants, r.cycle_size, r["size"]) for r in files.read_jsonl(spark, str(p)).collect()] == [(["é", "b"], 2, None), ([], None, 4)]
    p.write_text('{"a": 1}\n\n[1]\n')
    with pytest.raises(ValueError, match="line 3 is not a JSON object"):
        files.read_jsonl(spark, str(p))
    n = files.write_jsonl(spark.createDataFrame([(["é"], 1), (["b"], None)], "participants array<string>, cycle_size int"), str(tmp_path / "out"), single_file=True)
    lines = [json.loads(x) for f in (tmp_path / "out").glob("part-*") for x in f.read_text(encoding="utf-8").splitlines()]
    assert n == 2 and lines == [{"participants": ["é"], "cycle_size": 1}, {"participants": ["b"]}]


def test_defaults(spark):
    df = spark.createDataFrame([("B", None), ("A", "own")], "name string, ring_id string")
    out = files.with_defaults(df, "GDS", "scc_candidate", "x", [F.col("name")], "p").orderBy("name").collect()
    assert [(r.name, r.ring_id, r.ring_type, r.pattern) for r in out] == [("A", "own", "scc_candidate", "p"), ("B", "GDS_0001", "scc_candidate", "p")]


def test_documents(spark, tmp_path):
    files.write_document(spark, {"a": [1, {"b": None}], "é": 2}, f"file://{tmp_path}/s.json")
    text = (tmp_path / "s.json").read_text(encoding="utf-8")
    assert json.loads(text) == {"a": [1, {"b": None}], "é": 2} and "\n  " in text
    rings = spark.createDataFrame([("R1", ["a", "b"])], "ring_id string, participants array<string>")
    files.write_rings_document(rings, str(tmp_path / "rings"))
    assert [tuple(r) for r in files.read_rings_document(spark, str(tmp_path / "rings")).select("ring_id", "participants").collect()] == [("R1", ["a", "b"])]


def test_generator(spark):
    c = N.PRESETS["academic"]
    assert (c.background, c.ring_accounts, c.ring_count, c.bridges) == (47_500, 225, 45, 90)
    data = N.generate(spark, "academic")
    t = data["transactions"].cache()
    kinds = {r.transaction_type: r.n for r in t.groupBy("transaction_type").agg(F.count("*").alias("n")).collect()}
    assert kinds["background_bridge"] == 90 and kinds["p2p"] == 47_410
    assert all(r.passed for r in N.validate(data, c).collect())
    members = data["rings"].select("ring_index", F.explode("participants").alias("acc"))
    b = t.where("transaction_type = 'background_bridge'")
    out = b.join(members, b.source_account == members.acc).groupBy("ring_index").agg(F.count("*").alias("n"))
    back = b.join(members, b.destination_account == members.acc).groupBy("ring_index").agg(F.count("*").alias("n"))
    assert {(r.ring_index % 2, r.n) for r in out.collect()} == {(0, 2)} and {(r.ring_index % 2, r.n) for r in back.collect()} == {(1, 2)}
    assert t.where("is_fraud = 1 and transaction_type != 'fraud_ring'").count() == 0
    again = N.generate(spark, "academic")["transactions"]
    assert again.exceptAll(t).isEmpty()


def test_rings_stay_components(spark):
    data = N.generate(spark, "d1")
    t = data["transactions"].select(F.col("source_account").alias("src"), F.col("destination_account").alias("dst"))
    comp = {r.account_id: r.component for r in K.strong_components(t).collect()}
    for r in data["rings"].collect():
        assert len({comp[p] for p in r.participants}) == 1
        assert sum(x == comp[r.participants[0]] for x in comp.values()) == len(r.participants)


def test_generator_errors(spark):
    c = N.Config(1, 10, {})
    with pytest.raises(ValueError):
        N.normal_transactions(spark, c, 3)
    rings = spark.createDataFrame([(0, "R", [], 1, 1.0)], "ring_index long, ring_id string, participants array<string>, cycles int, total_amount double")
    with pytest.raises(ValueError, match="no participants"):
        N.bridge_transactions(rings, N.PRESETS["d1"], 1)
    with pytest.raises(ValueError, match="strategy"):
        N.bridge_transactions(rings, N.Config(5, 10, {}, strategy="sideways"), 1)
    with pytest.raises(ValueError, match="exceed"):
        N.background_transactions(spark, N.Config(5, 2, N.PRESETS["d1"].rings), rings)


def test_control(spark):
    assert control.guarded(spark, lambda: spark.range(5).count()) | {"elapsed_ms": 0} == {"status": control.COMPLETED, "elapsed_ms": 0, "result": 5, "error": None}
    assert control.guarded(spark, lambda: 1, skip=True)["status"] == control.BY_FLAG
    slow = spark.range(0, 10**11, 1, 4).selectExpr("sum(hash(id))")
    assert control.guarded(spark, slow.collect, 1.0)["status"] == control.SKIPPED
    # A limit reaches its own jobs only.
    import threading

    other = threading.Thread(target=lambda: done.append(spark.range(0, 2 * 10**9, 1, 4).selectExpr("sum(hash(id))").collect()))
    done: list = []
    other.start()
    assert control.guarded(spark, slow.collect, 0.5)["status"] == control.SKIPPED
    other.join()
    assert len(done) == 1
    with pytest.raises(ZeroDivisionError):
        control.guarded(spark, lambda: 1 / 0)
    assert "Physical Plan" in control.plan_text(spark.range(3))


def test_command_line(spark, tmp_path, capsys):
    assert cli.main(["generate", "--preset", "d1", "--out", str(tmp_path)], spark) == 0
    base = ["--dataset-dir", str(tmp_path), "--min-pair-transactions", "0", "--quiet"]
    capsys.readouterr()
    assert cli.main(["detect", *base, "--raw-out", str(tmp_path / "raw"), "--merged-out", str(tmp_path / "merged"), "--json-out", f"{tmp_path}/s.json"], spark) == 0
    s = json.loads(capsys.readouterr().out)
    assert s["results_by_cycle_size"]["8"] >= 1 and json.loads((tmp_path / "s.json").read_text()) == s
    assert cli.main(["fragmentation", "--raw-jsonl", str(tmp_path / "raw")], spark) == 0
    assert json.loads(capsys.readouterr().out)["total"]["raw_cycles"] == s["raw_result_count"]
    assert cli.main(["rings", "--raw-jsonl", str(tmp_path / "raw"), "--out", str(tmp_path / "rings")], spark) == 0
    store = ["--edge-table", f"file://{tmp_path}/edges"]
    capsys.readouterr()
    assert cli.main(["detect", *base, *store, "--aggregate-batch-size", "16"], spark) == 0
    own = json.loads(capsys.readouterr().out)
    assert cli.main(["detect", *base, *store, "--prepare-aggregates", "--keep-existing-aggregates"], spark) == 0
    again = json.loads(capsys.readouterr().out)
    for key in ("results_by_cycle_size", "unique_participant_sets", "graph_stats", "sample_results"):
        assert s[key] == own[key] == again[key]
    assert len(s["sample_results"]) <= 10 and s["load_elapsed_ms"] + s["detect_elapsed_ms"] <= s["elapsed_ms"] + 1
    assert cli.main(["components", *base], spark) == 0
    assert json.loads(capsys.readouterr().out)["result_count"] >= 1
    assert cli.main(["inner", *base], spark) == 0
    assert "unique_participant_sets" in json.loads(capsys.readouterr().out)
    assert cli.main(["baseline", *base, "--cycle-sizes", "3", "--raw-out", str(tmp_path / "paths")], spark) == 0
    for command in ("detect", "components", "inner", "baseline"):
        capsys.readouterr()
        assert cli.main([command, *base, "--dry-run", "--cycle-sizes", "3"], spark) == 0
        out = capsys.readouterr().out
        assert "Physical Plan" in out and out.startswith("-- ")
    assert cli.sizes("8,3,3") == (3, 8)


def test_schemas_cover_labels():
    assert not set(H.LABELS) & (set(H.UNLABELLED_ACCOUNTS) | set(H.UNLABELLED_TRANSACTIONS))


def test_entry_without_the_text_subpackage(tmp_path):
    import shutil

    shutil.copytree(ROOT / "cyclespan", tmp_path / "cyclespan", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    out = subprocess.run([sys.executable, "-B", "-c", "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()))"], cwd=tmp_path, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path)}, capture_output=True, text=True)
    assert out.returncode == 0 and int(out.stdout.split()[0]) > 30, out.stderr


def test_rings_document_of_several_files(spark, tmp_path):
    # The first rows lie in the smallest file, and a scan begins with the largest.
    rings = spark.range(0, 3000, 1, 3).select(F.concat(F.lit("R"), "id").alias("ring_id"), F.expr("transform(sequence(0, cast(id div 300 as int)), x -> uuid())").alias("participants"))
    files.write_rings_document(rings, str(tmp_path / "rings"))
    (part,) = (tmp_path / "rings").glob("part-*")
    text = part.read_text()
    assert [r["ring_id"] for r in json.loads(text)["rings"]] == [f"R{i}" for i in range(3000)]
    assert files.read_rings_document(spark, str(tmp_path / "rings")).count() == 3000
