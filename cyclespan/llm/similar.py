"""Near duplicates by SimHash fingerprints, and by the Jaccard similarity of word shingles, each pair of which is verified.

Links of two kinds join texts. The one is SimHash's: fingerprints of the same shingles (repeats counted) that differ in RADIUS bits at most, by covering
LSH as in simhash.py, which loses none. But pairs of similarity 0.8 differ in 5 to 14 of 64 bits, and masks that cover so wide a radius have keys of a few bits.
So pairs of at least `similarity` are linked too, by MinHash bands:
a text's set holds the XXH64 hashes (seed 42) of its runs of `shingle` words. Equal sets are one node. A node has BANDS keys, each made of
ROWS minima of the set under random maps; two sets of similarity s share one with probability 1 - (1 - s^ROWS)^BANDS, so a pair at 0.8 is
missed with probability 5e-8, and pairs above it less.

0. Nodes of equal fingerprints are linked to the least of them, and nodes whose fingerprints lie within the radius to each other's.
1. Each bucket's nodes are compared with its least one, and pairs of at least `similarity` are linked.
2. Nodes of a bucket that are then still in different components are all compared, so no pair that shares a key is left out. A bucket of up to
   SMALL_BUCKET nodes gives its pairs. A larger one is dealt out in blocks of about BLOCK_SHINGLES shingles, and a task compares two blocks by an inverted
   index over their shingles and returns only links between components: rows grow with nodes times blocks, not with pairs, and what a task holds is bounded.

Defined cases: a null text is empty; a text of fewer words than a shingle has its whole word sequence as the only shingle; texts without words
are copies of each other. A null id never becomes a component's id unless all are null. An empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from ..operators.components import connected_components
from ..operators.local_graph import LOCAL_EDGES
from . import common
from .simhash import RADIUS, links, majority, shingle_hashes

SHINGLE = 5
SIMILARITY = 0.8
BANDS, ROWS = 32, 4
#: Nodes of a bucket that give pairs at once; shingles of a block of a larger one.
SMALL_BUCKET, BLOCK_SHINGLES = 16, 400_000
#: Hashes that all random maps are taken of at once.
PIECE = 1024
_R = np.random.default_rng(11).integers(0, 2**64, (2, BANDS * ROWS, 1), np.uint64)
_XOR, _TIMES = _R[0], _R[1] | np.uint64(1)


def shingle_set(text: bytes, shingle: int = SHINGLE) -> np.ndarray:
    """The different hashes, ascending."""
    return np.unique(shingle_hashes(text, shingle))


def band_keys(s: np.ndarray) -> list[int]:
    """One signed key for each band; none of an empty set."""
    if not len(s):
        return []
    least = np.full(BANDS * ROWS, 2**64 - 1, np.uint64)
    for i in range(0, len(s), PIECE):
        np.minimum(least, ((s[None, i : i + PIECE] ^ _XOR) * _TIMES).min(axis=1), out=least)
    rows = least.reshape(BANDS, ROWS)
    return np.array([xxh64_intdigest(rows[b].tobytes(), b) for b in range(BANDS)], np.uint64).view(np.int64).tolist()


def similar(a: np.ndarray, b: np.ndarray, similarity: float = SIMILARITY) -> bool:
    """Whether the Jaccard similarity of two sets reaches the limit."""
    if min(len(a), len(b)) < similarity * max(len(a), len(b)) - 1e-9:
        return False
    shared = len(np.intersect1d(a, b, assume_unique=True))
    return shared >= similarity * (len(a) + len(b) - shared) - 1e-9


def _nodes(docs: DataFrame, shingle: int, keys) -> DataFrame:
    """(id, node, fp, size, bands, text): one row for each row of docs; fp is the text's fingerprint, size that of the set."""

    def make():
        def f(batch: pa.RecordBatch) -> pa.RecordBatch:
            hashes = [shingle_hashes(t, shingle) for t in common.utf8(batch)]
            fp = np.array([majority(h) for h in hashes], np.uint64).view(np.int64)
            sets = [np.unique(h) for h in hashes]
            node = np.array([xxh64_intdigest(s.tobytes(), 42) for s in sets], np.uint64).view(np.int64)
            bands = pa.array([keys(s) for s in sets], pa.list_(pa.int64()))
            size = pa.array([len(s) for s in sets], pa.int64())
            return pa.RecordBatch.from_arrays([common.column(batch, "id"), pa.array(node), pa.array(fp), size, bands, common.column(batch, "text")], ["id", "node", "fp", "size", "bands", "text"])

        return f

    return common.map_slices(docs.select(F.col("doc_id").cast("long").alias("id"), common.text_of().alias("text")), make, "id long, node long, fp long, size long, bands array<long>, text string")


def block_links(node: np.ndarray, own: np.ndarray, left: np.ndarray, right: np.ndarray, sets: list[np.ndarray], similarity: float) -> list[tuple[int, int]]:
    """Links that join the components (own) of all similar pairs of a node of the left block and one of the right. Blocks may be the same."""
    length = np.array([len(s) for s in sets])
    tokens, of = np.unique(np.concatenate(sets), return_inverse=True)
    begin = np.cumsum(length) - length
    holder = np.repeat(np.arange(len(sets)), length)
    # Of each shingle, the right block's nodes that hold it.
    mine = right[holder]
    order = np.argsort(of[mine], kind="stable")
    held, edges = holder[mine][order], np.searchsorted(of[mine][order], np.arange(len(tokens) + 1))
    component, found = np.unique(own, return_inverse=True)[1], []
    for x in np.flatnonzero(left):
        t = of[begin[x] : begin[x] + length[x]]
        if (component[right] == component[x]).all():
            continue
        shared = np.bincount(np.concatenate([held[edges[i] : edges[i + 1]] for i in t]), minlength=len(sets)) if len(t) else np.zeros(len(sets), np.int64)
        near = right & (shared >= similarity * (length[x] + length - shared) - 1e-9) & (component != component[x])
        while near.any():
            y = int(np.argmax(near))
            found.append((int(node[x]), int(node[y])))
            component[component == component[y]] = component[x]
            near &= component != component[x]
    return found


def _fingerprint_links(rows: DataFrame, radius: int, scratch: common.Scratch) -> DataFrame:
    """(a, b): links that join the nodes of all fingerprints within the radius. rows: (node, fp)."""
    held = scratch.keep(rows.select("node", "fp").distinct())
    first = scratch.keep(held.groupBy("fp").agg(F.min("node").alias("first")))
    same = held.join(first, "fp").select(F.col("first").alias("a"), F.col("node").alias("b"))
    near = links(first.select("fp"), radius).toDF("fa", "fb").join(first.toDF("fa", "a"), "fa").join(first.toDF("fb", "b"), "fb").select("a", "b")
    return scratch.keep(same.union(near).where("a != b").distinct())


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, similarity: float = SIMILARITY, keys=band_keys, radius: int = RADIUS) -> DataFrame:
    """(id, th, group, component_id): the component, and the smallest id in it, over fingerprints of at most `radius` differing bits and pairs of at least `similarity`; th is the text's XXH64."""
    scratch = common.Scratch(docs.sparkSession, "similar")
    rows = scratch.keep(_nodes(docs, shingle, keys).withColumn("th", F.xxhash64("text")))
    nodes = scratch.keep(rows.groupBy("node").agg(F.min("id").alias("least"), F.first("size").alias("size"), F.first("bands").alias("bands")))
    rows_of_keys = nodes.select("node", "size", F.explode("bands").alias("key"))
    buckets = rows_of_keys.groupBy("key").agg(F.min("node").alias("first"), F.max("node").alias("last")).where("first != last").select("key", "first")
    shared = scratch.keep(rows_of_keys.join(buckets, "key"))
    # Any text of a node will do: its set is the same. A bitmap of fixed size keeps those of nodes that share no bucket out of all shuffles.
    word = F.shiftright("node", 6).bitwiseAND(F.lit(common.BITMAP_WORDS - 1))
    bits = shared.select(word.alias("word"), F.expr("shiftleft(1L, cast(node & 63 as int))").alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("bits"))
    bits = scratch.keep(bits)  # BITMAP_WORDS rows at most
    held = rows.select("node", "text", word.alias("word")).join(F.broadcast(bits), "word").where("bit_get(bits, cast(node & 63 as int)) = 1")
    texts_of = scratch.keep(held.groupBy("node").agg(F.min("text").alias("text")))

    def verify(batches):
        last = (None, None)
        for batch in (piece for whole in batches for piece in common.slices(whole, "b_text", 1 << 20)):
            a, b = [], []
            for x, y, x_text, y_text in zip(*(common.column(batch, c).to_pylist() for c in ("a", "b", "a_text", "b_text"))):
                if last[0] != x:
                    last = (x, shingle_set(x_text.encode("utf-8", "surrogatepass"), shingle))
                if similar(last[1], shingle_set(y_text.encode("utf-8", "surrogatepass"), shingle), similarity):
                    a.append(x), b.append(y)
            if a:
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    def linked(pairs: DataFrame) -> DataFrame:
        needed = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
        texts = texts_of.join(needed, "node", "left_semi")
        both = pairs.join(texts.toDF("b", "b_text"), "b").join(texts.toDF("a", "a_text"), "a")
        return scratch.keep(both.select("a", "b", "a_text", "b_text").mapInArrow(verify, "a long, b long"))

    def in_blocks(large: DataFrame) -> DataFrame:
        """(a, b): links among the nodes of large (key, node, own, blocks)."""
        needed = large.select("node").distinct()
        texts = texts_of.join(needed, "node", "left_semi")

        def make():
            def f(batch: pa.RecordBatch) -> pa.RecordBatch:
                return pa.RecordBatch.from_arrays([common.column(batch, "node"), pa.array([shingle_set(t, shingle).view(np.int64) for t in common.utf8(batch)], pa.list_(pa.int64()))], ["node", "set"])

            return f

        sets = scratch.keep(common.map_slices(texts, make, "node long, set array<long>"))
        own = F.pmod(F.xxhash64("node", "key"), F.col("blocks")).cast("int")
        dealt = large.select("key", "node", "own", own.alias("block"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
        dealt = dealt.select("key", "node", "own", "block", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j")).join(sets, "node")

        def compare(table: pa.Table) -> pa.Table:
            block, i, j = table.column("block").to_numpy(), table.column("i")[0].as_py(), table.column("j")[0].as_py()
            held = table.column("set").combine_chunks()
            flat, edge = held.flatten().to_numpy(), np.r_[0, np.cumsum(pc.list_value_length(held).to_numpy(zero_copy_only=False))]
            found = block_links(table.column("node").to_numpy(), table.column("own").to_numpy(), block == i, block == j, [flat[a:b] for a, b in zip(edge, edge[1:])], similarity)
            return pa.table({"a": pa.array([min(x) for x in found], pa.int64()), "b": pa.array([max(x) for x in found], pa.int64())})

        return scratch.keep(dealt.groupBy("key", "i", "j").applyInArrow(compare, "a long, b long"))

    def components(edges: DataFrame) -> DataFrame:
        labels = connected_components(edges.select(F.col("a").alias("src"), F.col("b").alias("dst")), keep=scratch.keep, drop=scratch.drop, local_edges=LOCAL_EDGES)
        return scratch.keep(labels.select("node", F.col("component").alias("own")))

    stars = scratch.keep(shared.where("node != first").select(F.col("first").alias("a"), F.col("node").alias("b")).distinct())
    edges = linked(stars).union(_fingerprint_links(rows, radius, scratch))
    placed = scratch.keep(shared.join(components(edges), "node", "left").select("key", "node", "size", F.coalesce("own", "node").alias("own")))
    open_keys = placed.groupBy("key").agg(F.min("own").alias("low"), F.max("own").alias("high"), F.count("*").alias("n"), F.sum("size").alias("total")).where("low != high")
    open_keys = scratch.keep(open_keys.select("key", "n", F.ceil(F.col("total") / BLOCK_SHINGLES).cast("int").alias("blocks")))
    left = scratch.keep(placed.join(open_keys.where(F.col("n") <= SMALL_BUCKET).select("key"), "key"))
    cross = left.select("key", F.col("node").alias("a"), "own").join(left.select("key", F.col("node").alias("b"), F.col("own").alias("other")), "key").where("own != other and a < b").select("a", "b").distinct()
    # A bucket's first node is its least, so a star's pair is ascending too.
    cross = scratch.keep(cross.join(stars, ["a", "b"], "left_anti"))
    large = scratch.keep(placed.join(open_keys.where(F.col("n") > SMALL_BUCKET), "key"))
    labels = components(edges.union(linked(cross)).union(in_blocks(large)))
    member = nodes.join(labels, "node", "left").select("node", "least", F.coalesce("own", "node").alias("own"))
    classes = member.join(member.groupBy("own").agg(F.min("least").alias("component_id")), "own").select("node", F.col("own").alias("group"), "component_id")
    return rows.select("id", "th", "node").join(classes, "node").select("id", "th", "group", "component_id")
