"""Stored tables with versions, cluster tables that are appended to, kept counts, halves of cycles."""

import random

import pytest
from pyspark.sql import functions as F

from cyclespan.operators import cycles as C
from cyclespan.operators import edges as E
from cyclespan.operators import merge as M
from cyclespan.operators import metrics as X
from cyclespan.operators import rings as R
from cyclespan.plans import detect as D
from cyclespan.sources import cluster_store, edge_store, ring_store
from cyclespan.sources.versions import Versions


def moves(spark, flows):
    rows = [(f"T{i:04d}", s, d, float(x)) for i, (s, d, x) in enumerate(flows)]
    df = spark.createDataFrame(rows, "transaction_id string, src string, dst string, x double")
    return df.select("transaction_id", "src", "dst", F.col("x").cast("decimal(18,2)").alias("amount"), F.timestamp_seconds(F.lit(0)).cast("timestamp_ntz").alias("ts"))


def random_moves(spark, n, m, seed=1):
    rng = random.Random(seed)
    return moves(spark, [(f"V{rng.randrange(n):02d}", f"V{rng.randrange(n):02d}", rng.randint(1, 90)) for _ in range(m)])


# Edges


def held(spark, path):
    return {(r.src, r.dst): (r.transaction_count, float(r.total_amount)) for r in edge_store.load(spark, path).collect()}


def of(edges):
    return {(r.src, r.dst): (r.transaction_count, float(r.total_amount)) for r in edges.collect()}


@pytest.mark.parametrize("rebuild", [True, False])
@pytest.mark.parametrize("stop_at", [24])
def test_a_stopped_preparation_leaves_the_version_before(spark, tmp_path, rebuild, stop_at):
    path = f"file://{tmp_path}/edges"
    first, more = random_moves(spark, 12, 60), random_moves(spark, 15, 40, 2)
    edge_store.prepare(first, path)
    before = held(spark, path)
    assert before == of(E.edges(first))

    def stop(at):
        if at == stop_at:
            raise KeyboardInterrupt

    with pytest.raises(KeyboardInterrupt):
        edge_store.prepare(more, path, rebuild, 12, stop)
    assert held(spark, path) == before and Versions(spark, path).numbers() == [1]
    edge_store.prepare(more, path, rebuild, 12)
    assert held(spark, path) == (of(E.edges(more)) if rebuild else before | of(E.edges(more)))
    # The stopped run's folders are gone, the version before is still whole.
    known = {f for n in Versions(spark, path).numbers() for f in Versions(spark, path).read(n)["folders"]}
    assert {p.name for p in (tmp_path / "edges").iterdir()} == known | {"_versions"}


def test_a_stopped_first_preparation_is_no_table(spark, tmp_path):
    path = f"file://{tmp_path}/edges"

    def stop(at):
        raise KeyboardInterrupt

    with pytest.raises(KeyboardInterrupt):
        edge_store.prepare(random_moves(spark, 9, 30), path, True, 32, stop)
    assert not edge_store.exists(spark, path)
    with pytest.raises(FileNotFoundError):
        edge_store.load(spark, path)


def test_versions_keep_foreign_files_and_refuse_a_taken_number(spark, tmp_path):
    (tmp_path / "own").mkdir(parents=True)
    v = Versions(spark, f"file://{tmp_path}")
    assert v.read() is None and v.commit({"folders": []}) == 1 and v.commit({"folders": []}) == 2 and v.commit({"folders": []}) == 3
    assert v.numbers() == [2, 3] and (tmp_path / "own").is_dir()
    late = Versions(spark, f"file://{tmp_path}")
    late.numbers = lambda: [2]
    with pytest.raises(RuntimeError):
        late.commit({"folders": []})


def test_pages(spark):
    a = spark.createDataFrame([(f"A{i:02d}",) for i in range(23)] + [(None,)], "account_id string")
    rows = sorted(E.pages(a, 5).collect(), key=lambda r: r.page)
    assert [r.accounts for r in rows] == [5, 5, 5, 5, 3] and rows[0].after is None
    for r in rows:
        own = [x.account_id for x in E.page(a, r.after or "", 5).collect()]
        assert own[-1] == r["last"] and len(own) == r.accounts
    assert E.pages(a.where("false"), 5).count() == 0


# Clusters


def records(spark, rows):
    return spark.createDataFrame([(p, k, n, float(x), c) for p, k, n, x, c in rows], "participants array<string>, cycle_size int, transactions long, x double, cycles long").select(
        "participants", "cycle_size", "transactions", F.col("x").cast("decimal(38,2)").alias("total_amount"), "cycles"
    )


def merged_rows(df):
    return sorted((r.participants, r.participant_count, r.transactions, float(r.total_amount), r.cycles, r.fragment_count, r.candidate_cycle_sizes) for r in df.collect())


def fragments(df):
    return {r.scope: tuple(r)[1:] for r in df.collect()}


@pytest.mark.parametrize("seed", range(1))
def test_appends_give_the_clusters_of_a_full_run(spark, tmp_path, seed):
    rng, path = random.Random(seed), f"file://{tmp_path}/clusters"
    rows = []
    for _ in range(60):
        k = rng.choice([3, 3, 5])
        rows.append(([f"A{rng.randrange(70):02d}" for _ in range(k)], rng.choice([k, k, None]), rng.randint(1, 9), rng.randint(1, 500), rng.choice([0, 1, 2, None])))
    rows += [rows[0], ([], 3, 1, 1, 1), (["A00", None, "A01"], 3, 1, 1, 1), ([None], 1, 1, 1, 1)]
    at = 0
    for n in (20, 26, len(rows)):
        before = cluster_store.append(records(spark, rows[at : at + n]), path)
        at += n
        whole = records(spark, rows[:at])
        # The accounts that carry nulls are compared by the accounts that are known.
        want = [([p for p in x[0] if p is not None], *x[1:]) for x in merged_rows(M.merge_records(whole.where("size(participants) > 0")))]
        assert merged_rows(cluster_store.merged(spark, path)) == want
        assert fragments(cluster_store.fragmentation(spark, path)) == fragments(M.fragmentation(whole.where("size(filter(participants, x -> x is not null)) > 0")))
    assert before == 3
    cluster_store.compact(spark, path)
    assert merged_rows(cluster_store.merged(spark, path)) == want
    labels = {(r.scope, r.account): r.cluster for r in cluster_store.clusters(spark, path).collect()}
    full = M.overlap_clusters(records(spark, rows).where("size(participants) > 0")).select("cluster", F.explode("participants").alias("p")).where("p is not null").collect()
    assert {k[1]: v for k, v in labels.items() if k[0] == "total"} == {r.p: r.cluster.removeprefix("a:") for r in full}


def test_appends_read_no_old_records(spark, tmp_path):
    path = f"file://{tmp_path}/clusters"
    first = tmp_path / "first"
    records(spark, [(["A", "B"], 2, 1, 1, 1), (["C", "D"], 2, 1, 1, 1)]).write.parquet(f"file://{first}")
    cluster_store.append(spark.read.parquet(f"file://{first}"), path)
    first.rename(tmp_path / "away")
    cluster_store.append(records(spark, [(["B", "C"], 2, 7, 7, 1)]), path)
    assert merged_rows(cluster_store.merged(spark, path)) == [(["A", "B", "C", "D"], 4, 7, 7.0, 3, 3, [2])]


def test_an_empty_cluster_table(spark, tmp_path):
    path = f"file://{tmp_path}/clusters"
    with pytest.raises(FileNotFoundError):
        cluster_store.merged(spark, path)
    cluster_store.append(records(spark, []), path)
    assert cluster_store.merged(spark, path).count() == 0
    assert fragments(cluster_store.fragmentation(spark, path)) == fragments(M.fragmentation(records(spark, [])))


# Cycles


def simple(df):
    return sorted((r.participants, r.transactions, float(r.total_amount)) for r in df.collect())


@pytest.mark.parametrize("k", [4, 5, 7])
def test_halves_give_the_cycles_of_the_chain(spark, k):
    e = E.edges(random_moves(spark, 12, 45, k))
    want = simple(C.cycles(e, k))
    assert want and simple(C.cycles_by_halves(e, k)) == want
    assert simple(C.cycles_by_halves(e, k, 2)) == simple(C.cycles(e, k, 2))


def test_reachable_pairs_lie_on_closed_walks(spark):
    from cyclespan.plans.scratch import Rounds

    e = E.edges(moves(spark, [("A", "B", 1), ("B", "C", 1), ("C", "D", 1), ("D", "A", 1), ("B", "X", 1), ("X", "Y", 1), ("Y", "B", 1)]))
    on = C.reachable(e, 4, Rounds(spark, "on"))
    assert {i: sorted(map(tuple, df.collect())) for i, df in on.items()} == {1: [("A", "B")], 2: [("A", "C")], 3: [("A", "D")]}


@pytest.mark.parametrize("k", [2, 3, 5])
def test_factors_expand_to_the_paths(spark, k):
    t = random_moves(spark, 8, 40, k)
    want = sorted((r.participants, r.transaction_ids, float(r.total_amount)) for r in C.transaction_paths(t, k).collect())
    f = C.factorised_paths(t, k)
    assert sorted((r.participants, r.transaction_ids, float(r.total_amount)) for r in f.expand().collect()) == want
    n = f.count().first()
    assert n.n_paths == len(want) and n.n_cycles == f.cycles.count()
    some = f.expand("a0 = 'V00'")
    assert some.count() == sum("V00" == min(p) for p, _, _ in want)


@pytest.mark.parametrize("first", [1, 256])
def test_first_cycles_are_those_of_the_limit(spark, first, monkeypatch):
    monkeypatch.setattr(C, "FIRST_STARTS", first)
    e = E.edges(random_moves(spark, 25, 160))
    for k, limit in ((3, 5), (3, 10**6), (4, 17)):
        assert [r.participants for r in C.first_cycles(e, k, limit).collect()] == [r.participants for r in C.cycles(e, k, limit=limit).collect()]
    assert C.first_cycles(e.where("false"), 3, 5).count() == 0
    assert simple(C.first_cycles(e, 3, 0)) == simple(C.cycles(e, 3))


def test_triangles_by_amount_with_parallel_transactions(spark):
    t = moves(spark, [(a, b, x) for a, b in (("A", "B"), ("B", "C"), ("C", "A"), ("C", "D"), ("D", "B"), ("A", "A")) for x in (1, 5, 5, 9, 2)])
    for limit in (1, 7, 100):
        rows = C.triangles_by_amount(t, limit).collect()
        flows = [(r.transaction_id, r.src, r.dst, float(r.amount)) for r in t.collect()]
        every = [(-(x[3] + y[3] + z[3]), x[0], y[0], z[0]) for x in flows for y in flows if x[2] == y[1] for z in flows if y[2] == z[1] and z[2] == x[1] and len({x[0], y[0], z[0]}) == 3]
        assert [(-r.total_amount, r.x_id, r.y_id, r.z_id) for r in rows] == sorted(every)[:limit]


def test_measures_of_small_and_large_groups(spark):
    t = random_moves(spark, 30, 300)
    sums = t.groupBy("src", "dst").agg(F.count("*").alias("n"))
    groups = spark.createDataFrame([(i, [f"V{j:02d}" for j in own]) for i, own in enumerate([range(4), range(3, 20), range(30), [], [7]])], "g int, participants array<string>")
    own = {r.g: set(r.participants) for r in groups.collect()}
    want = sorted((g, r.src, r.dst, r.n) for g, m in own.items() for r in sums.collect() if r.src in m and r.dst in m)
    assert sorted((r.g, r.src, r.dst, r.n) for r in X.inside(groups, sums, "g").collect()) == want


# Runs that stop


def test_a_stopped_baseline_tells_the_rows_that_can_be_read(spark, tmp_path, monkeypatch):
    t = random_moves(spark, 40, 900, 3).repartition(8)
    whole = D.baseline(t, 3, f"file://{tmp_path}/whole", 0)
    assert whole["status"] == "completed" and whole["rows"] == spark.read.text(f"file://{tmp_path}/whole").count() > 0
    slow = F.udf(lambda x, i: __import__("time").sleep(0 if i % 4 else 600) or x, "string")
    monkeypatch.setattr(C, "transaction_paths", lambda t, k: spark.range(64).repartition(8, "id").withColumn("x", slow(F.lit("a"), F.spark_partition_id())))
    stopped = D.baseline(t, 3, f"file://{tmp_path}/part", 15)
    assert stopped["status"] == "skipped_timeout_or_resource_limit"
    assert 0 < stopped["rows"] == spark.read.text(f"file://{tmp_path}/part").count() < 64
    assert D.baseline(t, 3, f"file://{tmp_path}/none", skip=True)["rows"] == 0


# Rings


def test_rings_of_two_runs_are_those_of_one(spark, tmp_path):
    rng = random.Random(5)
    rows = []
    for _ in range(60):
        own = rng.sample("ABCDEFG", rng.choice([3, 4]))
        rows.append((own, len(own), rng.randint(0, 9), rng.choice([0.0, 12.5, 700_000.25, None]), rng.choice([1, 2, None]), rng.random() < 0.5, rng.choice([0.1, 0.9, None]), rng.choice([None, 0.4]), rng.choice([0, 3, None])))
    df = spark.createDataFrame(rows, "participants array<string>, cycle_size int, transactions long, total_amount double, cycles long, metrics_are_group_level boolean, avg_kyc_risk_score double, density double, fraud_transaction_count long")
    parts = [df.where(f"pmod(xxhash64(participants, transactions), 3) = {i}") for i in range(3)]
    for risk in (True, False):
        for strict in (True, False):
            path = f"file://{tmp_path}/rings{risk}{strict}"
            own = (lambda x: x) if risk else (lambda x: x.drop("avg_kyc_risk_score"))
            for p in parts:
                ring_store.append(own(p), path, strict)
            want = [tuple(r) for r in R.rings(own(df), strict=strict).orderBy("ring_id").collect()]
            assert [tuple(r) for r in ring_store.rings(spark, path).orderBy("ring_id").collect()] == want and want
            with pytest.raises(ValueError):
                ring_store.append(df, path, not strict)
    ring_store.compact(spark, path)
    assert [tuple(r) for r in ring_store.rings(spark, path).orderBy("ring_id").collect()] == want


# Findings of round 3


@pytest.mark.parametrize("k", [5, 6])
def test_halves_make_no_sets_of_reachable_pairs(spark, monkeypatch, k):
    # Pairs that lie up to k - 1 hops apart are nearly all pairs of a dense graph.
    monkeypatch.setattr(C, "reachable", None)
    e = E.edges(random_moves(spark, 10, 50, k))
    want = simple(C.cycles(e, k))
    assert want and simple(C.cycles_by_halves(e, k)) == want
    n, total = {}, {}
    for p, tx, _ in want:
        n[p[0]], total[p[0]] = n.get(p[0], 0) + 1, total.get(p[0], 0) + tx
    assert {r.account: (r.n_cycles, r.transactions) for r in C.added_up(e, k).collect()} == {v: (n[v], total[v]) for v in n}


def test_halves_of_ascending_cycles(spark):
    e = E.edges(random_moves(spark, 12, 70, 3))
    for k in (4, 5):
        assert simple(C.cycles_by_halves(e, k, monotone=True)) == simple(C.cycles(e, k, monotone=True)) != []


def test_amounts_beyond_a_long_of_cents(spark):
    big = "99999999999999999999.25"
    e = spark.createDataFrame([(a, b, 1, big) for a, b in ("AB", "BC", "CD", "DA")], "src string, dst string, transaction_count long, t string").withColumn("total_amount", F.col("t").cast("decimal(28,2)"))
    assert [str(r.total_amount) for r in C.cycles_by_halves(e, 4).collect()] == ["399999999999999999997.00"]


def test_paths_are_unfolded_after_all_joins(spark, monkeypatch):
    monkeypatch.setattr(C, "LIST", 2), monkeypatch.setattr(C, "PATHS_IN_TASK", 100)
    t = moves(spark, [("A", "B", 1)] * 5 + [("B", "C", 2)] * 4 + [("C", "A", 3)] * 7)
    got = C.transaction_paths(t, 3)
    assert "Join" not in got._jdf.queryExecution().optimizedPlan().toString()
    rows = [(tuple(r.participants), tuple(r.transaction_ids)) for r in got.collect()]
    assert len(rows) == len(set(rows)) == 3 * 5 * 4 * 7


def test_pairs_of_groups_do_not_pass_through_the_driver(spark):
    # The groups' table is small, the pairs that it unfolds into are not.
    groups = spark.createDataFrame([("g", ["A", "B", "C"]), ("h", [f"V{i}" for i in range(20)])], "set_key string, participants array<string>")
    sums = E.edges(moves(spark, [("A", "B", 1), ("V0", "V19", 2), ("V0", "A", 3)])).select("src", "dst", F.col("transaction_count").alias("n"))
    found = X.inside(groups, sums, "set_key")
    assert "BroadcastHashJoin" not in found._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, found.collect())) == [("g", "A", "B", 1), ("h", "V0", "V19", 1)]


# Findings of round 4


@pytest.mark.parametrize("cells", [1, 40, 1 << 19])
@pytest.mark.parametrize("monotone", [False, True])
def test_closed_gives_each_cycle_once(cells, monotone):
    import itertools

    import numpy as np

    from cyclespan.operators import local_graph as L

    rng, n, k = random.Random(4), 9, 6
    links = sorted({(a, b) for a, b in ((rng.randrange(n), rng.randrange(n)) for _ in range(60)) if a != b} | {(i, i + 1) for i in range(n - 1)} | {(k - 1, 0)})
    value = {x: rng.randrange(100) for x in links}
    want = sorted((p, sum(value[x] for x in zip(p, p[1:] + p[:1]))) for p in itertools.permutations(range(n), k) if p[0] == min(p) and all(x in value for x in zip(p, p[1:] + p[:1])) and (not monotone or list(p) == sorted(p)))
    pieces = [[np.array([f(x) for x in links[i::3]], t) for f, t in ((lambda x: x[0], np.int32), (lambda x: x[1], np.int32), (value.get, np.int64))] for i in range(3)]
    g = L.Adjacent(n, pieces, 1)
    got = [(tuple(int(x) for x in p), int(v)) for cycle, places in L.closed(g, k, np.arange(n), monotone, cells) for p, v in zip(zip(*cycle), sum(g.values[0][x] for x in places))]
    assert sorted(got) == want and want


def test_halves_of_cycles_stay_in_their_tasks(spark, monkeypatch):
    # Halves of eight accounts' cycles are more than any disk holds; joins of them are for graphs that no task can hold.
    e = E.edges(random_moves(spark, 14, 60, 3))
    t = random_moves(spark, 14, 60, 3)
    answers = lambda: (sorted(map(tuple, C.added_up(e, 8).collect())), C.factorised_paths(t, 8).count().first(), simple(C.cycles_by_halves(e, 6)))
    monkeypatch.setattr(C, "HELD_LINKS", 0)
    want = answers()
    monkeypatch.setattr(C, "_joined_halves", None)
    for held in (e.count(), 1 << 26):  # links without and with their values
        monkeypatch.setattr(C, "HELD_LINKS", held)
        assert answers() == want and want[0] and want[1].n_cycles and want[2]
