"""SimHash near-duplicates by covering locality-sensitive hashing (Pagh 2016).

A random map sends each of the 64 bit positions to a vector of r+1 bits; each of the 2^(r+1)-1 nonzero
vectors a gives a table whose mask keeps the positions m with <a, m> = 1. Any r positions leave some a
orthogonal to all their vectors, so every pair of fingerprints within the radius r agrees on a mask:
no pair is lost. Equal fingerprints are one node, so copies cost nothing; nodes of a bucket are linked by
wildcard keys (see `bucket_links`), whose groups hold at most 2^r nodes, however large the bucket is.

Defined cases: a null text is empty; a text of fewer words than a shingle has has its whole word sequence as the
only shingle; one without words has the fingerprint zero, which links like any other. Repeated rows are nodes of
the same fingerprint. A null id is kept in the result but never becomes a component's id unless all are null.
An empty table gives an empty result. Other columns, whatever their names, are ignored.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from ..operators.components import connected_components
from ..operators.local_graph import LOCAL_EDGES
from . import common

SHINGLE = 3
RADIUS = 2
BITS = 64
#: Nodes of a bucket that one task links in memory (8 bytes each); larger buckets are dealt out by wildcard key.
BUCKET_IN_TASK = 1 << 16


def shingle_hashes(text: bytes, shingle: int = SHINGLE) -> np.ndarray:
    """The shingles' XXH64 hashes (seed 42), repeats included; none of a text without words."""
    w = common.words(text)
    if len(w) <= shingle:
        return np.array([xxh64_intdigest(b" ".join(w), 42)] if w else [], np.uint64)
    join = b" ".join
    return np.fromiter((xxh64_intdigest(join(s), 42) for s in zip(*(w[i:] for i in range(shingle)))), np.uint64, len(w) - shingle + 1)


def majority(h: np.ndarray) -> int:
    """A bit is 1 if it is set in over half of the hashes."""
    ones = np.zeros(BITS, np.int64)
    for i in range(0, len(h), 1 << 14):
        part = h[i : i + (1 << 14)].astype(">u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(h)).tobytes(), "big")


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """A bit is 1 if it is set in over half of the shingles' XXH64 hashes (seed 42), repeats counted."""
    return majority(shingle_hashes(text, shingle))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """(id, th, fp): one row for each row of docs, th the text's XXH64, fp the fingerprint as a signed long."""

    def make():
        def f(batch: pa.RecordBatch) -> pa.RecordBatch:
            fp = np.array([fingerprint(t, shingle) for t in common.utf8(batch)], np.uint64).view(np.int64)
            return pa.RecordBatch.from_arrays([common.column(batch, "id"), common.column(batch, "th"), pa.array(fp)], ["id", "th", "fp"])

        return f

    text = common.text_of(text_col)
    return common.map_slices(docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text).alias("th"), text.alias("text")), make, "id long, th long, fp long")


def masks(radius: int = RADIUS, bits: int = BITS, seed: int = 7) -> list[int]:
    """The covering family: 2^(radius+1)-1 masks as unsigned integers."""
    size = (1 << (radius + 1)) - 1
    m = [1 + i % size for i in range(bits)]  # nonzero vectors, evenly spread over the positions
    np.random.default_rng(seed).shuffle(m)
    return [sum(1 << i for i in range(bits) if (a & m[i]).bit_count() & 1) for a in range(1, size + 1)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def bucket_links(fps: np.ndarray, free: list[int], radius: int) -> np.ndarray:
    """Links that join all pairs within the radius in one bucket, whose nodes differ in the free positions only.

    Two nodes within the radius are equal once some `radius` free positions are cleared, so for each choice of them
    nodes are sorted by the rest, and neighbours that are equal there are linked: no pair is compared.
    """
    fps = np.unique(fps.view(np.uint64))
    if len(fps) * (len(fps) - 1) // 2 <= 1 << 12:
        i, j = np.triu_indices(len(fps), 1)
        near = np.bitwise_count(fps[i] ^ fps[j]) <= radius
        return np.stack([fps[i[near]], fps[j[near]]], 1).view(np.int64)
    found = []
    differ = np.bitwise_or.reduce(fps ^ fps[0])
    free = [b for b in free if int(differ) >> b & 1]
    for chosen in combinations(free, min(radius, len(free))):
        clear = np.uint64(~sum(1 << b for b in chosen) & (2**64 - 1))
        rest = fps & clear
        order = np.argsort(rest, kind="stable")
        same = rest[order][1:] == rest[order][:-1]
        found.append(np.stack([fps[order][:-1][same], fps[order][1:][same]], 1))
    return np.unique(np.concatenate(found), axis=0).view(np.int64) if found else np.empty((0, 2), np.int64)


def links(nodes: DataFrame, radius: int = RADIUS, in_task: int = BUCKET_IN_TASK) -> DataFrame:
    """(a, b): links between different fingerprints (column fp, distinct), enough to connect all pairs within the radius."""
    family = [_signed(m) for m in masks(radius)]
    free = {i: [b for b in range(BITS) if not m >> b & 1] for i, m in enumerate(masks(radius))}
    tables = F.array(*[F.struct(F.lit(i).alias("t"), F.col("fp").bitwiseAND(F.lit(m)).alias("key")) for i, m in enumerate(family)])
    rows = nodes.select("fp", F.inline(tables))
    # A list of a bucket's nodes is made only where a count has shown that it is short enough for a task.
    sizes = rows.groupBy("t", "key").agg(F.count("*").alias("n")).where("n > 1")
    shared = rows.join(sizes, ["t", "key"])

    def run(batches):
        for batch in batches:
            out = [bucket_links(np.array(f, np.int64), free[t], radius) for t, f in zip(*(common.column(batch, c).to_pylist() for c in ("t", "fps")))]
            if out:
                both = np.concatenate(out)
                yield pa.RecordBatch.from_arrays([pa.array(both[:, 0].copy()), pa.array(both[:, 1].copy())], ["a", "b"])

    small = shared.where(F.col("n") <= in_task).groupBy("t", "key").agg(F.collect_list("fp").alias("fps")).select("t", "fps").mapInArrow(run, "a long, b long")

    def wildcards(batches):
        for batch in batches:
            t, fp = (common.column(batch, c).to_numpy() for c in ("t", "fp"))
            for table in np.unique(t):
                own = fp[t == table]
                for n, chosen in enumerate(combinations(free[table], radius)):
                    clear = np.int64(_signed(~sum(1 << b for b in chosen) & (2**64 - 1)))
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own), n, np.int32)), pa.array(own & clear), pa.array(own), pa.array(np.full(len(own), table, np.int32))], ["choice", "rest", "fp", "t"])

    large = shared.where(F.col("n") > in_task).select("t", "fp").mapInArrow(wildcards, "choice int, rest long, fp long, t int")
    # A choice clears other bits in another table. At most 2^radius different nodes share a table's wildcard key; all are within the radius of the least.
    large = large.groupBy("t", "choice", "rest").agg(F.min("fp").alias("a"), F.collect_set("fp").alias("all")).where(F.size("all") > 1).select("a", F.explode("all").alias("b"))
    return small.union(large).where("a != b").distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """(id, th, fp, group, component_id): the component, and the smallest id in it, over links of at most `radius` differing bits."""
    spark = docs.sparkSession
    scratch = common.Scratch(spark, "simhash")
    fps = scratch.keep(fingerprints(docs, id_col, text_col, shingle))
    nodes = scratch.keep(fps.groupBy("fp").agg(F.min("id").alias("least")))
    edges = scratch.keep(links(nodes.select("fp"), radius))
    # Only nodes that have links take part in the rounds.
    labels = connected_components(edges.select(F.col("a").alias("src"), F.col("b").alias("dst")), keep=scratch.keep, drop=scratch.drop, local_edges=LOCAL_EDGES)
    member = nodes.join(labels.select(F.col("node").alias("fp"), "component"), "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    least = member.groupBy("component").agg(F.min("least").alias("component_id"))
    classes = member.join(least, "component").select("fp", F.col("component").alias("group"), "component_id")
    return fps.join(classes, "fp").select("id", "th", "fp", "group", "component_id")


def query(spark, sf_dir: str) -> DataFrame:
    out = near_duplicates(common.table(spark, sf_dir, "documents"))
    return out.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def one_of_each(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """The rows of docs, one for each component: that with the smallest id; of rows that share it, the one with the least text hash."""
    return heads_of(docs, near_duplicates(docs.select("doc_id", common.text_of().alias("text")), shingle=shingle, radius=radius))


def heads_of(docs: DataFrame, out: DataFrame) -> DataFrame:
    """One row of docs for each group of out (id, th, group, component_id): of those with its smallest id the one with the least text hash, whatever rows share the id elsewhere."""
    # Names that no table's own columns have.
    chosen = out.where("id <=> component_id").groupBy("group").agg(F.min("th").alias("_cyclespan_th"), F.first("id").alias("_cyclespan_id"))
    rows = out.groupBy(F.col("id").alias("_i"), F.col("th").alias("_t")).agg(F.count("*").alias("_cyclespan_n"))
    heads = chosen.join(rows, F.col("_cyclespan_id").eqNullSafe(F.col("_i")) & (F.col("_cyclespan_th") == F.col("_t"))).select("_cyclespan_id", "_cyclespan_th", "_cyclespan_n")
    heads = common.Scratch(docs.sparkSession, "heads").keep(heads)
    text = F.xxhash64(common.text_of())
    same = F.col("doc_id").eqNullSafe(F.col("_cyclespan_id")) & (text == F.col("_cyclespan_th"))
    # Nearly all heads stand for one row; only repeated ones need a choice.
    one = docs.join(heads.where("_cyclespan_n = 1"), same, "left_semi")
    again = docs.join(heads.where("_cyclespan_n > 1"), same, "left_semi").select(F.struct(*[F.col(common.quoted(c)) for c in docs.columns]).alias("_row"), text.alias("_h"))
    kept = again.groupBy("_row.doc_id", "_h").agg(F.first("_row").alias("_row"))
    return one.unionByName(kept.select(*[F.col(f"_row.{common.quoted(c)}").alias(c) for c in docs.columns]))
