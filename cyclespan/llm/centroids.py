"""Centroid clustering of integer vectors: float32 screening with rigorous rounding-error intervals, exact integers for what stays open.

Vectors become integers, floor(scale * x). To assign a slice of them, one float32 matrix product gives x.c for all centroids at once. Whatever
order its sums are made in, fused or not, an entry's error is at most g * |x| * |c| with g = m u / (1 - m u), u = 2^-24, m = dims + 4 (dims products and
sums, two conversions to float32; Higham 2002, section 3.1). So |c|^2 - 2 x.c lies in a known interval for each centroid, and
only centroids whose interval reaches below the least upper end can be the nearest. Where one is left it is the nearest; where several are,
their distances are computed with integers and the least number of the least distance wins. Intervals that are not finite keep every centroid.

A round is one pass over the table: tasks add up whole numbers for each centroid, Spark adds the tasks' sums, and k rows of them reach the
driver, whatever the number of vectors. No vector is shuffled.

Defined cases: vectors that are null, have another number of components or hold a null or non-finite one are left out, as are all if the
table is empty; a null vec_id is kept and starts no centroid before all others did; repeated rows and ids are each a vector of their own (starts of one id are taken in the
order of their components); fewer vectors than centroids make as many centroids as there are vectors; other columns are ignored. Integers of 2^62 and more end in an
error that says so, since sums and distances are longs; distances from 2^63 on are null, and so are sums of them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Fixed values of the query: components, their scale, centroids, rounds.
DIMS, SCALE, K, ROUNDS = 64, 64.0, 16, 3
#: Unit roundoff of float32.
UNIT = 2.0**-24
#: Rows of a slice: its products with all centroids are held at once.
SLICE_ROWS = 4096
#: Magnitude of integers up to which differences, squares and sums of a few hundred components fit int64.
SAFE = 1 << 26
LARGEST = 1 << 62


def vectors(table: DataFrame, dims: int = DIMS, id_col: str = "vec_id", col: str = "embedding") -> DataFrame:
    """(id, v) of the vectors that are kept, as doubles."""
    v = F.col(common.quoted(col)).cast("array<double>")
    whole = (F.size(v) == dims) & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return table.select(F.col(common.quoted(id_col)).cast("long").alias("id"), v.alias("v")).where(whole)


def integers(batch: pa.RecordBatch, dims: int, scale: float) -> np.ndarray:
    """floor(scale * x) of a batch's vectors, as int64."""
    v = common.column(batch, "v")
    out = np.floor(scale * v.flatten().to_numpy(zero_copy_only=False).reshape(-1, dims))
    if out.size and not np.abs(out).max() < LARGEST:
        raise ValueError("a component is too large: its integer must stay below 2^62")
    return out.astype(np.int64)


def _squares(d: np.ndarray) -> np.ndarray:
    """Sums of squares along the last axis, as int64 where that is exact, else as Python's integers."""
    if not d.size or np.abs(d).max() <= 2 * SAFE:
        d = d.astype(np.int64)
        return np.einsum("...i,...i->...", d, d)
    d = d.astype(object)
    return (d * d).sum(-1)


def _difference(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    large = max(np.abs(a).max(initial=0), np.abs(b).max(initial=0)) > SAFE
    return a.astype(object) - b.astype(object) if large else a - b


class Centroids:
    """k centroids, ready to be screened."""

    def __init__(self, rows: list[tuple[int, ...]], dims: int):
        self.exact = np.array(rows, np.int64).reshape(len(rows), dims)
        with np.errstate(over="ignore"):
            self.single = self.exact.astype(np.float32)
        c = self.exact.astype(np.float64)
        self.square, self.norm = (c * c).sum(1), np.sqrt((c * c).sum(1))
        m = dims + 4
        self.g = m * UNIT / (1 - m * UNIT)

    def open(self, x: np.ndarray) -> np.ndarray:
        """Which centroids of each row can be its nearest: never without the nearest ones."""
        with np.errstate(over="ignore", invalid="ignore"):
            dots = (x.astype(np.float32) @ self.single.T).astype(np.float64)
            f = x.astype(np.float64)
            norms = np.sqrt((f * f).sum(1))
            value = self.square - 2 * dots
            # Norms, squares and this difference are doubles: their own errors are some thousand units of 2^-53, far below the slack.
            slack = 2.0**-40
            error = 2 * self.g * (1 + slack) * norms[:, None] * self.norm + slack * (self.square + 2 * np.abs(dots)) + 2.0**-40
            low, high = value - error, value + error
        bad = ~(np.isfinite(low) & np.isfinite(high))
        low[bad], high[bad] = -np.inf, np.inf
        return low <= high.min(1)[:, None]

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """(number, exact squared distance) of each row's nearest centroid, and how many rows took exact comparisons."""
        shortlist = self.open(x)
        number = shortlist.argmax(1)
        several = np.flatnonzero(shortlist.sum(1) > 1)
        if len(several):
            row, j = np.nonzero(shortlist[several])
            d = _squares(_difference(x[several[row]], self.exact[j]))
            order = np.lexsort((j, d, row)) if d.dtype != object else np.array(sorted(range(len(d)), key=lambda i: (row[i], d[i], j[i])))
            first = np.r_[True, np.diff(row[order]) > 0]
            number[several] = j[order][first]
        return number, _squares(_difference(x, self.exact[number])), len(several)


def _slices(batches: Iterator[pa.RecordBatch], dims: int, scale: float) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for batch in batches:
        for at in range(0, batch.num_rows, SLICE_ROWS):
            piece = batch.slice(at, SLICE_ROWS)
            yield piece, integers(piece, dims, scale)


def starts(kept: DataFrame, k: int, dims: int, scale: float) -> list[tuple[int, ...]]:
    """The k vectors whose ids have the least hashes: each partition gives its k first, of which one task takes k."""
    h = F.sha2(F.concat(F.lit("1:"), F.col("id").cast("string")), 256)
    chosen = kept.withColumn("h", h).orderBy(F.asc_nulls_last("h"), "v").limit(k).collect()
    return [tuple(int(np.floor(scale * x)) for x in r["v"]) for r in chosen]


def _sums(kept: DataFrame, centroids: Centroids, dims: int, scale: float) -> list:
    """(cluster, n, inertia, s0, s1, ...): k rows at most, added up by task and then by Spark; exact."""

    def run(batches):
        n, total, parts = np.zeros(len(centroids.exact), np.int64), [0] * len(centroids.exact), [[0] * dims for _ in centroids.exact]
        for _, x in _slices(batches, dims, scale):
            number, distance, _ = centroids.nearest(x)
            exact = np.int64 if not x.size or np.abs(x).max() <= SAFE else object
            for j in np.unique(number):
                own = number == j
                n[j] += int(own.sum())
                total[j] += sum(distance[own].tolist())
                parts[j] = [a + int(b) for a, b in zip(parts[j], x[own].astype(exact).sum(0))]
        at = np.flatnonzero(n)
        # Sums of a task may go beyond a long: they are sent as text and added up as decimals.
        columns = [pa.array(at, pa.int32()), pa.array(n[at], pa.int64()), pa.array([str(total[j]) for j in at], pa.string())]
        columns += [pa.array([str(parts[j][i]) for j in at], pa.string()) for i in range(dims)]
        yield pa.RecordBatch.from_arrays(columns, names)

    names = ["cluster", "n", "inertia", *[f"s{i}" for i in range(dims)]]
    made = kept.mapInArrow(run, "cluster int, n long, " + ", ".join(f"{c} string" for c in names[2:]))
    return made.groupBy("cluster").agg(F.sum("n").alias("n"), *[F.sum(F.col(c).cast("decimal(38,0)")).alias(c) for c in names[2:]]).collect()


def fit(table: DataFrame, k: int = K, rounds: int = ROUNDS, dims: int = DIMS, scale: float = SCALE, id_col: str = "vec_id", col: str = "embedding") -> list[tuple[int, ...]]:
    """The centroids after so many rounds; none without vectors."""
    kept = vectors(table, dims, id_col, col)
    now = starts(kept, k, dims, scale)
    for _ in range(rounds if now else 0):
        for r in _sums(kept, Centroids(now, dims), dims, scale):
            now[r["cluster"]] = tuple(int(r[f"s{i}"]) // r["n"] for i in range(dims))
    return now


SCHEMA = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"


def _long(x: int | None) -> int | None:
    return x if x is not None and x < 1 << 63 else None


def assign(table: DataFrame, centroids: list[tuple[int, ...]], dims: int = DIMS, scale: float = SCALE, id_col: str = "vec_id", col: str = "embedding") -> DataFrame:
    """A row for each vector: its centroid, the squared distance, the distances' sums over its cluster and over all, and a digest of its centroid."""
    kept = vectors(table, dims, id_col, col)
    if not centroids:
        return kept.sparkSession.createDataFrame([], SCHEMA)
    model = Centroids(centroids, dims)
    own = {r["cluster"]: int(r["inertia"]) for r in _sums(kept, model, dims, scale)}
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    total = _long(sum(own.values()))

    def run(batches):
        for piece, x in _slices(batches, dims, scale):
            number, distance, _ = model.nearest(x)
            numbers = number.tolist()
            yield pa.RecordBatch.from_arrays(
                [
                    common.column(piece, "id"), pa.array(numbers, pa.int32()), pa.array([_long(d) for d in distance.tolist()], pa.int64()),
                    pa.array([_long(own[j]) for j in numbers], pa.int64()), pa.array([total] * len(numbers), pa.int64()), pa.array([digests[j] for j in numbers]),
                ],
                [c.split()[0] for c in SCHEMA.split(", ")],
            )

    return kept.mapInArrow(run, SCHEMA)


def cluster(table: DataFrame, k: int = K, rounds: int = ROUNDS, dims: int = DIMS, scale: float = SCALE) -> DataFrame:
    return assign(table, fit(table, k, rounds, dims, scale), dims, scale)


def query(spark, sf_dir: str) -> DataFrame:
    return cluster(common.table(spark, sf_dir, "embeddings"))


def _round_sql(i: int, k: int = K) -> str:
    """Assignment a{i} to the centroids c{i}, and the centroids c{i+1} that follow."""
    return f"""
a{i} AS MATERIALIZED (SELECT r, arg_min(j, (d, j)) AS j, min(d) AS d FROM (SELECT v.r, c.j, CAST(list_sum(list_transform(list_zip(v.x, c.x), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS BIGINT) AS d FROM v CROSS JOIN c{i} c) GROUP BY r),
m{i} AS (SELECT j, i, CAST(floor(sum(x) / count(*)) AS BIGINT) AS x FROM (SELECT a.j, unnest(v.x) AS x, unnest(range(len(v.x))) AS i FROM a{i} a JOIN v USING (r)) GROUP BY j, i),
c{i + 1} AS MATERIALIZED (SELECT c.j, coalesce(n.x, c.x) AS x FROM c{i} c LEFT JOIN (SELECT j, list(x ORDER BY i) AS x FROM m{i} GROUP BY j) n USING (j)),"""


ORACLE = f"""
WITH v AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor({SCALE:.0f} * CAST(x AS DOUBLE)) AS BIGINT)) AS x FROM embeddings
  WHERE len(embedding) = {DIMS} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {DIMS}),
c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h, x) - 1 AS j, x FROM (SELECT sha256('1:' || CAST(vec_id AS VARCHAR)) AS h, x FROM v ORDER BY h, x LIMIT {K})),{"".join(_round_sql(i) for i in range(ROUNDS + 1))}
s AS (SELECT j, sum(d) AS d FROM a{ROUNDS} GROUP BY j)
SELECT v.vec_id, CAST(a.j AS INTEGER) AS cluster, a.d AS distance, CAST(s.d AS BIGINT) AS cluster_inertia, CAST((SELECT sum(d) FROM s) AS BIGINT) AS inertia, sha256(array_to_string(c.x, ',')) AS centroid_sha256
FROM a{ROUNDS} a JOIN v USING (r) JOIN s USING (j) JOIN c{ROUNDS} c USING (j)
"""
