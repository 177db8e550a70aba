"""Bounded directed cycles as chains of equi-joins.

Catalyst sees plain joins, so it picks sort-merge or broadcast by size and splits skewed keys. What it can't know is put in each join's
condition: the least account comes first (a path only goes to accounts above its first one) and accounts differ. Each hop
prunes at once, and a cycle is found in one rotation.
"""

from __future__ import annotations

import operator
from collections.abc import Sequence
from functools import cached_property, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.scratch import Rounds
from . import local_graph
from .edges import threshold


def check_sizes(sizes: Sequence[int], least: int = 3) -> tuple[int, ...]:
    """Sizes, sorted and each once."""
    out = tuple(sorted(set(int(s) for s in sizes)))
    if not out or out[0] < least:
        raise ValueError(f"cycle sizes must be at least {least}")
    return out


def cycles(edges: DataFrame, k: int, min_pair_transactions: int = 0, min_pair_amount: float = 0.0, min_internal_transactions: int = 0, min_total_amount: float = 0.0, limit: int = 0, least: int = 3, monotone: bool = False, starts: tuple | None = None) -> DataFrame:
    """All directed cycles of k different accounts: participants (from the least on, in the cycle's order), cycle_size, transactions,
    total_amount (sums over the cycle's edges), cycles, metrics_are_group_level. With a limit, the first by participants.
    monotone keeps only cycles whose accounts ascend up to the closing edge. starts: (after, upto), the range of first accounts; None leaves an end open."""
    check_sizes([k], least)
    kept = threshold(edges, min_pair_transactions, min_pair_amount).select("src", "dst", F.col("transaction_count").alias("n"), F.col("total_amount").alias("amt"))
    path = kept.where("dst > src").select(F.col("src").alias("a0"), F.col("dst").alias("a1"), "n", "amt")
    for end, inside in zip(starts or (), (lambda x: F.col("a0") > x, lambda x: F.col("a0") <= x)):
        path = path if end is None else path.where(inside(end))
    for i in range(1, k - 1):
        hop = kept.toDF("_s", "_d", "_n", "_amt")
        new = [F.col("_d") > F.col("a0")] + [F.col("_d") != F.col(f"a{j}") for j in range(1, i)]
        if monotone:
            new = [F.col("_d") > F.col(f"a{i}")]
        path = path.join(hop, reduce(lambda x, y: x & y, new, F.col("_s") == F.col(f"a{i}")))
        path = path.select(*[f"a{j}" for j in range(i + 1)], F.col("_d").alias(f"a{i + 1}"), (F.col("n") + F.col("_n")).alias("n"), (F.col("amt") + F.col("_amt")).alias("amt"))
    close = kept.toDF("_s", "_d", "_n", "_amt")
    closed = path.join(close, (F.col("_s") == F.col(f"a{k - 1}")) & (F.col("_d") == F.col("a0")))
    out = closed.select(
        F.array(*[f"a{j}" for j in range(k)]).alias("participants"), F.lit(k).alias("cycle_size"), (F.col("n") + F.col("_n")).alias("transactions"),
        (F.col("amt") + F.col("_amt")).cast("decimal(38,2)").alias("total_amount"), F.lit(1).cast("long").alias("cycles"), F.lit(True).alias("metrics_are_group_level"),
    )
    out = out.where((F.col("transactions") >= min_internal_transactions) & (F.col("total_amount") >= min_total_amount))
    return out.orderBy("participants").limit(limit) if limit > 0 else out


#: First accounts of the first range that first_cycles looks at.
FIRST_STARTS = 256


def first_cycles(edges: DataFrame, k: int, limit: int = 0, **options) -> DataFrame:
    """The rows of cycles() with a limit, without making all cycles: since the order is by participants, first accounts are taken range by range, in ascending order,
    until the cycles that begin there are enough. Each range is as long as those before let expect, twice as long as all before at least."""
    if limit <= 0:
        return cycles(edges, k, limit=limit, **options)
    rounds = Rounds(edges.sparkSession, "first")
    kept = threshold(edges, options.pop("min_pair_transactions", 0), options.pop("min_pair_amount", 0.0)).select("src", "dst", "transaction_count", "total_amount")
    kept = rounds.keep(kept)
    accounts = rounds.keep(kept.where("dst > src").select("src").distinct())
    parts, have, seen, after, take = [cycles(kept.where("false"), k, **options)], 0, 0, None, FIRST_STARTS
    while have < limit:
        rest = accounts if after is None else accounts.where(F.col("src") > after)
        n, upto = rest.orderBy("src").limit(take).agg(F.count("*"), F.max("src")).first()
        if not n:
            break
        found = rounds.keep(cycles(kept, k, starts=(after, upto), **options))
        have, seen, after = have + found.count(), seen + n, upto
        take = max(2 * seen, seen * (limit - have) // max(1, have))
        parts.append(found)
    return reduce(DataFrame.union, parts).orderBy("participants").limit(limit)


def cycles_of(edges: DataFrame, sizes: Sequence[int], **options) -> DataFrame:
    """Cycles of several sizes. The edges that pass are written once, and each size's chain of joins reads them."""
    least = options.get("least", 3)
    kept = threshold(edges, options.get("min_pair_transactions", 0), options.get("min_pair_amount", 0.0))
    kept = Rounds(edges.sparkSession, "cycles").keep(kept.select("src", "dst", "transaction_count", "total_amount"))
    if options.get("monotone") and not set(options) - {"monotone", "min_pair_transactions", "min_pair_amount"}:
        return reduce(DataFrame.unionByName, [cycles_by_halves(kept, k, monotone=True) for k in check_sizes(sizes, least)])
    return reduce(DataFrame.unionByName, [cycles(kept, k, **options) for k in check_sizes(sizes, least)])


def count_by_size(found: DataFrame) -> DataFrame:
    return found.groupBy("cycle_size").agg(F.count("*").alias("n_cycles"))


def rotations(found: DataFrame, k: int) -> DataFrame:
    """Each cycle once for each of its accounts as the first."""
    turned = F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: F.concat(F.slice("participants", i + 1, F.lit(k)), F.slice("participants", F.lit(1), i)))
    return found.withColumn("participants", F.explode(turned))


def transaction_paths(transfers: DataFrame, k: int) -> DataFrame:
    """The unaggregated baseline: a row for each closed path of k transactions over k different accounts, every rotation and every parallel transaction.

    Closed paths are found over ordered pairs of accounts, in one rotation, so no join carries parallel transactions; these come to the cycles that there are as lists,
    and rows are made where those lie: nothing that has been unfolded is shuffled.
    """
    return factorised_paths(transfers, k).expand()


def transaction_path_count(edges: DataFrame, k: int, **options) -> DataFrame:
    """The number of transaction_paths without making them: k times the sum over cycles of the product of their edges' counts."""
    kept = threshold(edges, options.get("min_pair_transactions", 0), options.get("min_pair_amount", 0.0)).where("src != dst")
    rounds = Rounds(edges.sparkSession, "count")
    kept = rounds.keep(kept.select("src", "dst", _product(kept, k).alias("n")))
    return _counted(_closed(by_number(kept, rounds)[1], k, {"n": _times(kept)}, rounds, whole=False), k)


def _product(kept: DataFrame, k: int):
    """transaction_count in a type that holds the product of k of them."""
    most = kept.agg(F.max("transaction_count")).first()[0] or 1
    return F.col("transaction_count").cast("long" if int(most) ** k < 1 << 62 else "decimal(38,0)")


def _times(kept: DataFrame) -> tuple:
    return operator.mul, dict(kept.dtypes)["n"]


def _counted(found: DataFrame, k: int) -> DataFrame:
    return found.agg(F.count("*").alias("n_cycles"), (F.coalesce(F.sum(F.col("n").cast("decimal(38,0)")), F.lit(0)) * k).cast("long").alias("n_paths"))


def triangles_by_amount(transfers: DataFrame, limit: int = 100) -> DataFrame:
    """Closed paths of three transactions with their amount and the first one's time, all rotations, by amount; ties by the ids.

    Triangles are found over ordered pairs. Of a pair's parallel transactions only the first `limit` by amount can be in the result: in place of a later one, each
    of those before gives a row that comes earlier."""
    t = transfers.select("src", "dst", F.col("transaction_id").alias("id"), "amount", "ts")
    place = F.row_number().over(Window.partitionBy("src", "dst").orderBy(F.desc("amount"), "id"))
    best = Rounds(transfers.sparkSession, "triangles").keep(t.withColumn("place", place).where(F.col("place") <= limit).drop("place"))
    pairs = best.select("src", "dst").distinct()
    p, q, r = (pairs.toDF(f"{c}_s", f"{c}_d") for c in "pqr")
    found = p.join(q, F.col("p_d") == F.col("q_s")).join(r, (F.col("q_d") == F.col("r_s")) & (F.col("r_d") == F.col("p_s"))).select(F.col("p_s").alias("a"), F.col("q_s").alias("b"), F.col("r_s").alias("c"))
    for x, s, d in (("x", "a", "b"), ("y", "b", "c"), ("z", "c", "a")):
        own = best.toDF("_s", "_d", f"{x}_id", f"{x}_amount", f"{x}_ts")
        found = found.join(own, (F.col("_s") == F.col(s)) & (F.col("_d") == F.col(d))).drop("_s", "_d")
    different = found.where("x_id != y_id and y_id != z_id and x_id != z_id")  # a pattern never takes the same transaction twice
    out = different.select("a", "b", "c", (F.col("x_amount") + F.col("y_amount") + F.col("z_amount")).cast("double").alias("total_amount"), F.col("x_ts").alias("start_time"), "x_id", "y_id", "z_id")
    return out.orderBy(F.desc("total_amount"), "x_id", "y_id", "z_id").limit(limit)


def reachable(edges: DataFrame, k: int, rounds: Rounds) -> dict[int, DataFrame]:
    """{i: (a0, v)} for i from 1 to k - 1: v lies i hops behind a0 on a closed walk of k edges whose other accounts are all above a0.

    Sets of pairs, not paths: hop by hop forward, then back from those that close, so that each pair that is left is on such a walk (a semi-join reduction of the chain of joins).
    """
    e = edges.select("src", "dst")
    ahead = {1: rounds.keep(e.where("dst > src").toDF("a0", "v"))}
    for i in range(2, k):
        ahead[i] = rounds.keep(ahead[i - 1].join(e.toDF("v", "w"), "v").where("w > a0").select("a0", F.col("w").alias("v")).distinct())
    closing = e.where("src > dst").select(F.col("dst").alias("a0"), F.col("src").alias("v"))
    out = {k - 1: rounds.keep(ahead[k - 1].join(closing, ["a0", "v"], "left_semi"))}
    for i in range(k - 2, 0, -1):
        before = out[i + 1].join(e.toDF("u", "v"), "v").select("a0", F.col("u").alias("v"))
        out[i] = rounds.keep(ahead[i].join(before, ["a0", "v"], "left_semi"))
    for df in ahead.values():
        rounds.drop(df)
    return out


def by_number(kept: DataFrame, rounds: Rounds) -> tuple[DataFrame, DataFrame]:
    """(names, edges): names (name, i) number the accounts in their order, and edges are kept ones (src, dst, values) between numbers, which take less room in sorts and shuffles."""
    from .rings import numbered

    ends = kept.select(F.col("src").alias("name")).union(kept.select("dst")).where("name is not null").distinct()
    names = rounds.keep(numbered(ends, [F.col("name")], "A", "_id").select("name", F.col("_number").alias("i")))
    values = [c for c in kept.columns if c not in ("src", "dst")]
    ends = kept.join(names.toDF("src", "_s"), "src").join(names.toDF("dst", "_d"), "dst")
    return names, rounds.keep(ends.select(F.col("_s").alias("src"), F.col("_d").alias("dst"), *values))


def _named(found: DataFrame, k: int, names: DataFrame) -> DataFrame:
    """Cycles (a0, ...) of numbers with their accounts' names."""
    for i in range(k):
        found = found.join(names.toDF(f"_name{i}", f"_i{i}"), F.col(f"a{i}") == F.col(f"_i{i}"))
    return found.select(*[F.col(f"_name{i}").alias(f"a{i}") for i in range(k)], *[c for c in found.columns if not c.startswith(("_", "a")) or c == "amt"])


def _both(put: tuple, x, y):
    return put[0](x, y).cast(put[1])


#: Links of a graph whose halves of cycles are made where a copy of it lies, each value of a link counted as one more: a task holds 8 bytes a link, 12 and 8 a value with values, and half as much again while it reads them.
HELD_LINKS = 1 << 26
#: Cycles of fewer accounts have short halves, which are joined.
LONG_CYCLE = 5


def _closed(kept: DataFrame, k: int, sums: dict, rounds: Rounds, monotone: bool = False, whole: bool = True) -> DataFrame:
    """(a0, ..., a{k-1}, and the columns of sums) of all simple cycles of k accounts, a0 the least: paths of k // 2 hops from a0, joined with paths that lead back to a0 from where they end.
    Both halves grow from a0, over accounts above it alone, so neither is longer than half of the cycle and no set of what can be reached is made. kept: written (src, dst, values), accounts as
    numbers; sums: {value: (how two of it are put together, its type)}; monotone: only cycles that ascend up to the closing edge; not whole: a0 is enough of the accounts.

    There are far more halves than cycles: a graph of n accounts and degree d has n d^4 of four hops, and d^8 / 8 cycles of eight. So up to HELD_LINKS links, by their count, first accounts are dealt out over tasks,
    which get a copy of the links each and keep of their halves those that meet; only cycles leave a task. Where links fit, but not with their values, these are joined to the cycles. Larger graphs take joins of halves."""
    links = kept.count() if k >= LONG_CYCLE else HELD_LINKS + 1
    if links > HELD_LINKS:
        return _joined_halves(kept, k, sums, monotone)
    kinds = dict(kept.dtypes)
    if links * (1 + len(sums)) <= HELD_LINKS and all(kinds[v] == "bigint" for v in sums):
        return _by_copies(kept, k, sums, monotone, whole)
    return _with_values(rounds.keep(_by_copies(kept, k, {}, monotone)), kept, k, sums)


def _by_copies(kept: DataFrame, k: int, sums: dict, monotone: bool = False, whole: bool = True) -> DataFrame:
    """The rows of _closed for a graph that a task can hold, first accounts being dealt out over tasks. Values are longs."""
    values, tasks = list(sums), 2 * kept.sparkSession.sparkContext.defaultParallelism
    kinds = [np.int32, np.int32] + [np.int64] * len(values)
    n = (kept.agg(F.max(F.greatest("src", "dst"))).first()[0] or 0) + 1
    names, sent = [f"a{i}" for i in range(k)] if whole else ["a0"], ["src", "dst", *values]

    def pack(batches):
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([pa.array([c.to_numpy(zero_copy_only=False).astype(t).tobytes()], pa.binary()) for c, t in zip(batch.columns, kinds)], sent)

    def run(batches):
        task, pieces = None, []
        for batch in batches:
            if batch.num_rows:
                task = batch.column(0)[0].as_py()
                pieces += [[np.frombuffer(x, t) for x, t in zip(row, kinds)] for row in zip(*(c.to_pylist() for c in batch.columns[1:]))]
        if task is None:
            return
        g = local_graph.Adjacent(n, pieces, len(values))
        for cycle, places in local_graph.closed(g, k, np.arange(task, n, tasks), monotone):
            columns = cycle[: len(names)]
            for v, own in zip(values, g.values):
                columns = [*columns, reduce(sums[v][0], [own[x] for x in places])]
            for i in range(0, len(cycle[0]), 50_000):
                yield pa.RecordBatch.from_arrays([pa.array(c[i : i + 50_000].astype(np.int64)) for c in columns], [*names, *values])

    # Links of one source side by side pack well in the shuffle.
    ordered = kept.select(*sent).repartitionByRange("src").sortWithinPartitions("src")
    copies = ordered.mapInArrow(pack, ", ".join(f"{c} binary" for c in sent)).select(F.explode(F.sequence(F.lit(0), F.lit(tasks - 1))).alias("task"), *sent)
    return copies.repartitionById(tasks, "task").mapInArrow(run, ", ".join(f"{c} long" for c in [*names, *values]))


def _with_values(found: DataFrame, kept: DataFrame, k: int, sums: dict) -> DataFrame:
    """Cycles (a0, ...) with what their links' values come to."""
    names, values = [f"a{i}" for i in range(k)], list(sums)
    folded = lambda v: F.aggregate(F.slice(v, 2, k), F.col(v)[0], lambda x, y: _both(sums[v], x, y))
    hops = found.select(*names, F.explode(F.array(*[F.struct(F.col(f"a{i}").alias("s"), F.col(f"a{(i + 1) % k}").alias("d")) for i in range(k)])).alias("hop")).select(*names, F.col("hop.s").alias("src"), F.col("hop.d").alias("dst"))
    lists = hops.join(kept, ["src", "dst"]).groupBy(*names).agg(*[F.collect_list(v).alias(v) for v in values])
    return lists.select(*names, *[folded(v).alias(v) for v in values])


def _joined_halves(kept: DataFrame, k: int, sums: dict, monotone: bool = False) -> DataFrame:
    """The rows of _closed for any graph, by joins."""
    values, h = list(sums), k // 2
    hop = kept.select(F.col("src").alias("_s"), F.col("dst").alias("_d"), *[F.col(v).alias(f"_{v}") for v in values])

    def longer(path: DataFrame, names: list[str], new: str, ahead: bool) -> DataFrame:
        """Paths that end at names[-1] (or, backward, come from there) with one account more."""
        near, far = ("_s", "_d") if ahead else ("_d", "_s")
        last = F.col(names[-1])
        fit = [F.col(far) > last if ahead else F.col(far) < last] if monotone and len(names) > 1 else []
        fit += [F.col(far) > F.col("a0")] + ([] if monotone else [F.col(far) != F.col(x) for x in names[1:-1]])
        step = path.join(hop, reduce(lambda x, y: x & y, fit, F.col(near) == last))
        return step.select(*names, F.col(far).alias(new), *[_both(sums[v], F.col(v), F.col(f"_{v}")).alias(v) for v in values])

    first, names = kept.where("dst > src").toDF("a0", "a1", *values), ["a0", "a1"]
    for i in range(2, h + 1):
        first, names = longer(first, names, f"a{i}", True), [*names, f"a{i}"]
    last = f"a{k - 1}"
    second = kept.where("src > dst").select(F.col("dst").alias("a0"), F.col("src").alias(last), *values)
    names = ["a0", last]
    for i in range(k - 2, h - 1, -1):
        second, names = longer(second, names, f"a{i}", False), [*names, f"a{i}"]
    second = second.select(F.col("a0").alias("_a"), F.col(f"a{h}").alias("_m"), *[f"a{j}" for j in range(h + 1, k)], *[F.col(v).alias(f"_{v}") for v in values])
    apart = [] if monotone else [F.col(f"a{i}") != F.col(f"a{j}") for i in range(1, h) for j in range(h + 1, k)]
    whole = first.join(second, reduce(lambda x, y: x & y, apart, (F.col("a0") == F.col("_a")) & (F.col(f"a{h}") == F.col("_m"))))
    return whole.select(*[f"a{j}" for j in range(k)], *[_both(sums[v], F.col(v), F.col(f"_{v}")).alias(v) for v in values])


def _weighed(edges: DataFrame, k: int, rounds: Rounds) -> tuple[DataFrame, dict, bool]:
    """Edges (src, dst, n, amt), how these add up, and whether amt is in whole cents, which it is if k of the largest fit into a long."""
    amount = F.col("total_amount").cast("decimal(38,2)")
    kept = rounds.keep(edges.where("src != dst").select("src", "dst", F.col("transaction_count").alias("n"), amount.alias("amt")))
    most = kept.agg(F.max(F.abs("amt"))).first()[0] or 0
    cents = int(most * 100) * k < 1 << 62
    if not cents:
        return kept, {"n": (operator.add, "bigint"), "amt": (operator.add, "decimal(38,2)")}, False
    return kept.withColumn("amt", (F.col("amt") * 100).cast("long")), {"n": (operator.add, "bigint"), "amt": (operator.add, "bigint")}, True


def _dollars(cents: bool):
    return (F.col("amt").cast("decimal(20,0)") * F.lit("0.01").cast("decimal(2,2)")).cast("decimal(38,2)") if cents else F.col("amt")


def cycles_by_halves(edges: DataFrame, k: int, min_pair_transactions: int = 0, min_pair_amount: float = 0.0, monotone: bool = False) -> DataFrame:
    """The rows of cycles(), for longer cycles of dense graphs: a chain of k joins carries about degree^(k-1) paths an account, halves carry degree^(k - k // 2)."""
    if k < 4:
        return cycles(edges, k, min_pair_transactions, min_pair_amount, monotone=monotone)
    rounds = Rounds(edges.sparkSession, "halves")
    kept, sums, cents = _weighed(threshold(edges, min_pair_transactions, min_pair_amount), k, rounds)
    names, kept = by_number(kept, rounds)
    found = _named(rounds.keep(_closed(kept, k, sums, rounds, monotone)), k, names)
    return found.select(
        F.array(*[f"a{j}" for j in range(k)]).alias("participants"), F.lit(k).alias("cycle_size"), F.col("n").alias("transactions"), _dollars(cents).alias("total_amount"),
        F.lit(1).cast("long").alias("cycles"), F.lit(True).alias("metrics_are_group_level"),
    )


def added_up(edges: DataFrame, k: int) -> DataFrame:
    """(account, n_cycles, transactions, total_amount): all cycles of k accounts, k at least 4, added up by their least one."""
    rounds = Rounds(edges.sparkSession, "added")
    kept, sums, cents = _weighed(edges, k, rounds)
    names, kept = by_number(kept, rounds)
    found = _closed(kept, k, sums, rounds, whole=False).groupBy("a0").agg(F.count("*").alias("n_cycles"), F.sum("n").alias("transactions"), F.sum(F.col("amt").cast("decimal(38,0)") if cents else "amt").alias("amt"))
    return found.join(names, F.col("a0") == F.col("i")).select(F.col("name").alias("account"), "n_cycles", "transactions", _dollars(cents).alias("total_amount"))


#: Transfers of a pair that a list holds; paths that a task makes, about.
LIST, PATHS_IN_TASK = 256, 1_000_000


class FactorisedPaths:
    """The paths of transaction_paths() for k accounts, kept as factors: cycles (a0, ..., n: how many paths each stands for in one rotation) and the transfers (src, dst, id, amt) of the ordered pairs on a cycle."""

    def __init__(self, k: int, pairs: DataFrame, sums: dict, names: DataFrame, own: DataFrame, rounds: Rounds):
        self.k, self._pairs, self._sums, self._names, self._own, self._rounds = k, pairs, sums, names, own, rounds

    @cached_property
    def _numbered(self) -> DataFrame:
        return self._rounds.keep(_closed(self._pairs, self.k, self._sums, self._rounds))

    @cached_property
    def cycles(self) -> DataFrame:
        return _named(self._numbered, self.k, self._names)

    @cached_property
    def transfers(self) -> DataFrame:
        used = reduce(DataFrame.union, [self.cycles.select(F.col(f"a{i}").alias("src"), F.col(f"a{(i + 1) % self.k}").alias("dst")).distinct() for i in range(self.k)]).distinct()
        return self._rounds.keep(self._own.join(used, ["src", "dst"], "left_semi"))

    def count(self) -> DataFrame:
        """(n_cycles, n_paths), exact, from the factors alone, which needn't be written for it."""
        made = self.__dict__.get("_numbered")
        return _counted(_closed(self._pairs, self.k, self._sums, self._rounds, whole=False) if made is None else made, self.k)

    def expand(self, where: str | None = None) -> DataFrame:
        """All paths, or those of the cycles that a condition on (a0, ...) takes. A pair's transfers come as lists of about LIST, hop by hop, to the cycles; then tasks unfold rotations and lists, so that
        no unfolded row is shuffled."""
        k, found = self.k, self.cycles.where(where) if where else self.cycles
        sizes = self.transfers.groupBy("src", "dst").agg(F.ceil(F.count("*") / LIST).alias("_lists"))
        part = F.pmod(F.xxhash64("id"), F.col("_lists"))
        lists = self.transfers.join(sizes, ["src", "dst"]).groupBy("src", "dst", part.alias("part")).agg(F.collect_list(F.struct("id", "amt")).alias("own"))
        lists = self._rounds.keep(lists.drop("part"))
        for i in range(k):
            own = lists.toDF("_s", "_d", f"_own{i}")
            found = found.join(own, (F.col("_s") == F.col(f"a{i}")) & (F.col("_d") == F.col(f"a{(i + 1) % k}"))).drop("_s", "_d")
        found = self._rounds.keep(found)
        paths = reduce(lambda x, y: x * y, [F.size(f"_own{i}").cast("double") for i in range(k)])
        total = found.agg(F.coalesce(F.sum(paths), F.lit(0.0))).first()[0] * k
        turns = []
        for r in range(k):
            at = [(i + r) % k for i in range(k)]
            turns.append(found.select(F.array(*[f"a{i}" for i in at]).alias("participants"), *[F.col(f"_own{i}").alias(f"_own{j}") for j, i in enumerate(at)]))
        path = reduce(DataFrame.union, turns).repartition(max(1, int(total // PATHS_IN_TASK) + 1), "participants", F.xxhash64("_own0"))
        for i in range(k):
            path = path.withColumn(f"_x{i}", F.explode(f"_own{i}")).drop(f"_own{i}")
        amount = reduce(lambda x, y: x + y, [F.col(f"_x{i}.amt") for i in range(k)])
        return path.select("participants", F.lit(k).alias("cycle_size"), F.array(*[f"_x{i}.id" for i in range(k)]).alias("transaction_ids"), F.lit(k).cast("long").alias("transactions"), amount.cast("decimal(38,2)").alias("total_amount"))


def factorised_paths(transfers: DataFrame, k: int, min_pair_transactions: int = 0) -> FactorisedPaths:
    """transaction_paths() without unfolding parallel transactions and rotations: as many rows as there are cycles and transactions on them."""
    if k < 2:
        raise ValueError("cycle size must be at least 2")
    rounds = Rounds(transfers.sparkSession, "factors")
    t = transfers.where("src != dst").select("src", "dst", F.col("transaction_id").alias("id"), F.col("amount").cast("decimal(38,2)").alias("amt"))
    sums = rounds.keep(t.groupBy("src", "dst").agg(F.count("*").alias("transaction_count")).where(F.col("transaction_count") >= min_pair_transactions))
    kept = rounds.keep(sums.select("src", "dst", _product(sums, k).alias("n")))
    names, e = by_number(kept, rounds)
    return FactorisedPaths(k, e, {"n": _times(kept)}, names, t, rounds)
