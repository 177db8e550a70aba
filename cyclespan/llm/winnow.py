"""Document fingerprints by winnowing (Schleimer, Wilkerson, Aiken 2003).

Rolling hashes of all k-grams of code points; in each window of w consecutive k-grams the least hash is chosen, the
rightmost of equal ones; chosen (position, hash) pairs are the fingerprint. Any two texts that share
w + k - 1 code points share a chosen hash, and the kept positions place the match.

The fingerprint string holds 16 hexadecimal digits for each chosen k-gram: position, then hash, 32 bits each. A text
shorter than k has one k-gram, the text itself; an empty one has the empty fingerprint. The likeness of two
fingerprints is the Jaccard index of their sets of hashes; 1.0 if both are empty.

Defined cases: a null text is empty. Order is descending doc_id, then the texts' XXH64 and the text (so repeated ids
have a fixed order); a null id is last. The only row of a table is its own next document. An empty table gives
an empty result. Other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

K = 16
WINDOW = 100
_BASE = 0x9E3779B97F4A7C15
#: Rows of one range of ids, while there are no more than MAX_RANGES ranges; they are cut at quantiles. MAX_RANGES bounds what the driver holds.
RANGE_ROWS, MAX_RANGES = 2_000, 20_000


def kgram_hashes(points: np.ndarray, k: int = K) -> np.ndarray:
    """32-bit hashes of all k-grams: the polynomial hash modulo 2^64 by doubling runs, mixed and cut."""
    n, mask = len(points), (1 << 64) - 1
    if not n:
        return np.empty(0, np.uint64)
    k = min(k, n)
    run, length, base = points.astype(np.uint64), 1, _BASE
    acc, done = None, 0
    while True:
        if k & length:
            m = n - done - length + 1
            acc = run[:m].copy() if acc is None else acc[:m] * np.uint64(base) + run[done : done + m]
            done += length
        if length * 2 > k:
            break
        run = run[: len(run) - length] * np.uint64(base) + run[length:]
        length, base = length * 2, base * base & mask
    h = (acc ^ (acc >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0x94D049BB133111EB)
    return h >> np.uint64(32)


def winnow(points: np.ndarray, k: int = K, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """(positions, hashes) of the chosen k-grams, by position."""
    h = kgram_hashes(points, k)
    n = len(h)
    if not n:
        return np.empty(0, np.uint32), np.empty(0, np.uint32)
    low = np.uint64(0xFFFFFFFF)
    # The hash above, the complement of the position below: the least value is the least hash, rightmost first.
    best, w, length = (h << np.uint64(32)) | (low - np.arange(n, dtype=np.uint64)), min(window, n), 1
    while length * 2 <= w:
        best = np.minimum(best[:-length], best[length:])
        length *= 2
    if length < w:
        best = np.minimum(best[: n - w + 1], best[w - length :])
    chosen = best[np.flatnonzero(np.r_[True, best[1:] != best[:-1]])]
    return (low - (chosen & low)).astype(np.uint32), (chosen >> np.uint64(32)).astype(np.uint32)


def encode(positions: np.ndarray, hashes: np.ndarray) -> str:
    return np.stack([positions, hashes], 1).astype(">u4").tobytes().hex()


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard index of two sorted arrays of different hashes."""
    if not len(a) and not len(b):
        return 1.0
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both)


def points_of(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


class _Print:
    """A text's fingerprint."""

    def __init__(self, text: str, k: int, window: int):
        self.points = points_of(text)
        self.positions, hashes = winnow(self.points, k, window)
        self.string, self.hashes = encode(self.positions, hashes), np.unique(hashes)


def edited_points(own: np.ndarray, following: np.ndarray) -> np.ndarray:
    """The last floor(n/2) code points give way to the first as many (or all) of the following text."""
    half = len(own) // 2
    return np.concatenate([own[: len(own) - half], following[:half]])


def neighbours(docs: DataFrame, range_rows: int = RANGE_ROWS, max_ranges: int = MAX_RANGES) -> DataFrame:
    """(rng, id, text, extra): the rows dealt out by ranges of descending id, and each range's successor row (extra).

    The one row that a range needs from the next is added to it, so a task sees all its neighbours
    and no task sees all ids: a range's first row is found by an aggregate of ids.
    """
    rows = docs.select(F.col("id").cast("long").alias("id"), "text")
    n = rows.count()
    parts = max(1, min(max_ranges, -(-n // range_rows)))
    found = rows.agg(F.percentile_approx("id", [i / parts for i in range(1, parts)], 100_000)).first()[0] if parts > 1 else None
    cuts = np.array(sorted(set(found or [])), np.int64)  # at most max_ranges

    def make():
        def f(batch: pa.RecordBatch) -> pa.RecordBatch:
            ids = common.column(batch, "id")
            # Range 0 holds ids above the greatest cut; a null id comes last.
            rng = len(cuts) - np.searchsorted(cuts, ids.fill_null(0).to_numpy(zero_copy_only=False), "left")
            rng = np.where(ids.is_null().to_numpy(zero_copy_only=False), len(cuts), rng)
            return pa.RecordBatch.from_arrays([ids, common.column(batch, "text"), pa.array(rng.astype(np.int32))], ["id", "text", "rng"])

        return f

    placed = common.map_slices(rows, make, "id long, text string, rng int")
    ids = rows.select("id")

    def place(batches):
        f = make()
        for batch in batches:
            yield f(pa.RecordBatch.from_arrays([batch.column(0), pa.array([""] * batch.num_rows)], ["id", "text"])).select(["id", "rng"])

    firsts = ids.mapInArrow(place, "id long, rng int").groupBy("rng").agg(F.max("id").alias("top")).orderBy("rng").collect()  # one row for each range
    if not firsts:
        return placed.withColumn("extra", F.lit(False))
    spark = docs.sparkSession
    # The range before each one; the first range follows the last.
    before = spark.createDataFrame([(r.rng, r.top, firsts[i - 1].rng) for i, r in enumerate(firsts)], "rng int, top long, before int")
    tops = placed.join(F.broadcast(before), "rng").where("id <=> top")
    extra = tops.groupBy("before").agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text", "id")).alias("x")).select("x.id", "x.text", F.col("before").alias("rng"), F.lit(True).alias("extra"))
    out = placed.withColumn("extra", F.lit(False)).unionByName(extra)
    return out.repartition(len(firsts), "rng").sortWithinPartitions("rng", "extra", F.col("id").desc_nulls_last(), F.xxhash64("text"), "text")


SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, n_kept long"


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K, window: int = WINDOW) -> DataFrame:
    """Fingerprints of each text and of its edited text, with their likeness to each other and to the next document's."""
    base = docs.select(F.col(id_col).cast("long").alias("id"), common.text_of(text_col).alias("text"))

    def run(batches):
        held = None  # (range, id, print) of the row whose next one is still to come
        out: list[tuple] = []

        def emit(own, following):
            edited = edited_points(own[2].points, following.points)
            positions, hashes = winnow(edited, k, window)
            digest = hashlib.sha256(edited.astype("<u4").tobytes().decode("utf-32-le", "surrogatepass").encode("utf-8", "surrogatepass")).hexdigest()
            p = own[2]
            out.append((own[1], len(p.points), digest, p.string, encode(positions, hashes), likeness(p.hashes, np.unique(hashes)), likeness(p.hashes, following.hashes), len(p.positions)))

        def flush():
            columns = list(zip(*out))
            types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.int64()]
            made = pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types)], [x.split()[0] for x in SCHEMA.split(", ")])
            out.clear()
            return made

        size = 0
        for batch in batches:
            for piece in common.slices(batch):
                for rng, i, text, extra in zip(*(common.column(piece, c).to_pylist() for c in ("rng", "id", "text", "extra"))):
                    here = _Print(text, k, window)
                    if held is not None and held[0] == rng:
                        emit(held, here)
                        size += len(held[2].string) * 2
                    held = None if extra else (rng, i, here)
                    if size > 1 << 22:
                        yield flush()
                        size = 0
        if out:
            yield flush()

    return neighbours(base).mapInArrow(run, SCHEMA)


def query(spark, sf_dir: str) -> DataFrame:
    return fingerprints(common.table(spark, sf_dir, "documents"))
