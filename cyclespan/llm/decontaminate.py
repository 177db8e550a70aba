"""Benchmark decontamination: size-partitioned MinHash containment search, verified by exact shingle containment.

Short items are the queries and long documents the searched sets, so a fixed-length signature of a document would
lose an item of 40 shingles among 20,000. As in LSH Ensemble (Zhu et al. 2016) sets are put in size classes (doubling: 1, 2-3, 4-7, ...) and
each class turns the containment threshold into its own sketch: bottom-k MinHash, the k least shingle hashes of an item, k being the most that a set
of the class can lack, and one more. A document that holds the threshold's share of an item's shingles lacks fewer than k of them, so it holds one of the k
least: the search loses nothing. Documents are partitioned by size too: one with fewer shingles than an item needs is never its candidate.

1. Items are a table with their sketches; a bitmap of fixed size over all sketch hashes is broadcast, nothing else, however many items there are.
2. One scan of the documents: their shingle hashes (of every length that items have) probe the bitmap, and a document with hits is written with
   these hashes.
3. Hits are joined with the sketches by hash, which gives candidates (document, item).
4. Every candidate is verified on the shingles themselves.

Defined cases: words are [^\\x20\\x09-\\x0D]+ with A-Z lower-cased; a null text is empty; an item of fewer than SHINGLE
words has its whole word sequence as only shingle (searched among document shingles of that length); an item
without words matches nothing. Repeated item rows, or ids, are rows of the result each; null ids are kept. An
empty table on either side gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from . import common

SHINGLE = 5
THRESHOLD = 0.8
#: Multiplier of the word hashes' polynomial.
_BASE = 0x9E3779B97F4A7C15


def shingles(w: list[bytes], length: int) -> set[bytes]:
    return {b" ".join(s) for s in zip(*(w[i:] for i in range(length)))}


def least_needed(size: int, threshold: float) -> int:
    """Shingles that a document must hold of an item with `size` of them."""
    return max(1, math.ceil(threshold * size - 1e-9))


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(32))


def rolling(word_hashes: np.ndarray, length: int) -> np.ndarray:
    """A hash of each run of `length` words."""
    n = len(word_hashes) - length + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    h = np.zeros(n, np.uint64)
    for i in range(length):
        h = h * np.uint64(_BASE) + word_hashes[i : i + n]
    return _mix(h)


def hashes(w: list[bytes]) -> np.ndarray:
    return np.fromiter((xxh64_intdigest(x) for x in w), np.uint64, len(w))


def size_class(n: int) -> int:
    return n.bit_length()


@lru_cache(maxsize=256)
def sketch_size(c: int, threshold: float) -> int:
    """The k of class c. Sizes go from 2^(c-1) to 2^c - 1."""
    return max(n - least_needed(n, threshold) + 1 for n in range(1 << (c - 1), 1 << c))


def sketch(h: np.ndarray, threshold: float) -> np.ndarray:
    """The least hashes of a set of different ascending ones, as many as its size class asks for."""
    return h[: sketch_size(size_class(len(h)), threshold)] if len(h) else h


def _items(items: DataFrame, shingle: int, threshold: float, scratch: common.Scratch) -> DataFrame:
    """(rid, item_id, item_text, length, n, sketch): one row for each item with words; n is the number of different shingles, of `length` words."""

    def make():
        def f(batch: pa.RecordBatch) -> pa.RecordBatch:
            rows = []
            for i, t in zip(common.column(batch, "item_id").to_pylist(), common.utf8(batch, "item_text")):
                if w := common.words(t):
                    length = min(shingle, len(w))
                    h = np.unique(rolling(hashes(w), length))
                    rows.append((i, t.decode("utf-8", "surrogatepass"), length, len(h), sketch(h, threshold).view(np.int64)))
            types = [pa.int64(), pa.string(), pa.int32(), pa.int64(), pa.list_(pa.int64())]
            return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows) if rows else [()] * 5, types)], ["item_id", "item_text", "length", "n", "sketch"])

        return f

    made = common.map_slices(items, make, "item_id long, item_text string, length int, n long, sketch array<long>", column="item_text")
    # The number is drawn when the table is written, so rows that are alike stay apart from then on.
    return scratch.keep(made.withColumn("rid", F.monotonically_increasing_id()))


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > 200_000:
            self.clear()
        h = self[word] = xxh64_intdigest(word)
        return h


def _hits(docs: DataFrame, lengths: list[int], sent, scratch: common.Scratch) -> DataFrame:
    """(key, id, text, probes): the documents with shingle hashes whose bit is set, and these hashes."""

    def make():
        known, bits = _WordHashes(), sent.value

        def f(batch: pa.RecordBatch) -> pa.RecordBatch:
            found, probes = [], []
            for at, t in enumerate(common.utf8(batch)):
                w = common.words(t)
                h = np.fromiter(map(known.__getitem__, w), np.uint64, len(w))
                own = [r[common.there(bits, r)] for r in (rolling(h, n) for n in lengths) if len(r)]
                if own and any(map(len, own)):
                    found.append(at), probes.append(np.unique(np.concatenate(own)).view(np.int64))
            out = batch.take(pa.array(found, pa.int32()))
            return pa.RecordBatch.from_arrays([common.column(out, "id"), common.column(out, "text"), pa.array(probes, pa.list_(pa.int64()))], ["id", "text", "probes"])

        return f

    made = common.map_slices(docs, make, "id long, text string, probes array<long>")
    return scratch.keep(made.withColumn("key", F.monotonically_increasing_id()))


def _matches(docs: DataFrame, items: DataFrame, shingle: int, threshold: float) -> DataFrame:
    """(doc_id, item_id, n_shared, n_item) of docs (id, text) and items (item_id, item_text)."""
    spark, schema = docs.sparkSession, "doc_id long, item_id long, n_shared long, n_item long"
    scratch = common.Scratch(spark, "decontaminate")
    own = _items(items, shingle, threshold, scratch)
    lengths = sorted(r[0] for r in own.select("length").distinct().collect())  # `shingle` numbers at most
    if not lengths:
        return spark.createDataFrame([], schema)
    keys = own.select("rid", "n", F.explode("sketch").alias("h"))
    sent = spark.sparkContext.broadcast(common.bitmap(keys, "h"))
    hits = _hits(docs, lengths, sent, scratch)
    sent.unpersist()
    pairs = scratch.keep(hits.select("key", F.explode("probes").alias("h")).join(keys, "h").select("key", "rid").distinct())
    rows = pairs.join(own.select("rid", "item_id", "item_text", "length"), "rid").join(hits.select("key", "id", "text"), "key").select("key", "id", "text", "item_id", "item_text", "length")

    def verify(batches):
        last, held, wanted = None, {}, {}
        for batch in (piece for whole in batches for piece in common.slices(whole, "text")):
            out = []
            for key, i, t, item, q, length in zip(*(common.column(batch, c).to_pylist() for c in ("key", "id", "text", "item_id", "item_text", "length"))):
                if key != last:
                    last, w, held = key, common.words(t.encode("utf-8", "surrogatepass")), {}
                if len(wanted) > 10_000:
                    wanted.clear()
                if q not in wanted:
                    wanted[q] = shingles(common.words(q.encode("utf-8", "surrogatepass")), length)
                need = least_needed(len(wanted[q]), threshold)
                if len(w) - length + 1 < need:  # a smaller size class than the item asks for
                    continue
                if length not in held:
                    held[length] = shingles(w, length)
                n = len(wanted[q] & held[length])
                if n >= need:
                    out.append((i, item, n, len(wanted[q])))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.int64()) for c in zip(*out)], ["doc_id", "item_id", "n_shared", "n_item"])

    return rows.mapInArrow(verify, schema)


def contained(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", item_id: str = "item_id", text: str = "text", shingle: int = SHINGLE, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, item_id, n_shared, n_item, containment): all pairs where the document holds at least `threshold` of the item's distinct shingles."""
    whole = docs.select(F.col(doc_id).cast("long").alias("id"), common.text_of(text).alias("text"))
    out = _matches(whole, items.select(F.col(item_id).cast("long").alias("item_id"), common.text_of(text).alias("item_text")), shingle, threshold)
    return out.withColumn("containment", F.col("n_shared") / F.col("n_item"))


def query(spark, sf_dir: str) -> DataFrame:
    return contained(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark"))


def without_benchmark(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The rows of docs that contain no item. A row is known by its text's XXH64, since equal texts hold the same items."""
    name = F.xxhash64(common.text_of())
    found = _matches(docs.select(name.alias("id"), common.text_of().alias("text")), items.select(F.lit(None).cast("long").alias("item_id"), common.text_of().alias("item_text")), SHINGLE, THRESHOLD)
    # A name that no table's own columns have.
    gone = common.Scratch(docs.sparkSession, "contaminated").keep(found.select(F.col("doc_id").alias("_cyclespan_text")).distinct())
    return docs.join(gone, name == F.col("_cyclespan_text"), "left_anti")


_WORDS = "list_filter(string_split_regex(translate({t}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \\t-\\r]+'), lambda x: x <> '')"

ORACLE = f"""
WITH d AS (SELECT doc_id, {_WORDS.format(t="coalesce(text, '')")} AS w FROM documents),
b AS (SELECT row_number() OVER () AS rid, item_id, {_WORDS.format(t="coalesce(text, '')")} AS w FROM benchmark),
i AS (SELECT DISTINCT rid, item_id, least({SHINGLE}, len(w)) AS k, array_to_string(w[p:p + least({SHINGLE}, len(w)) - 1], ' ') AS s
      FROM (SELECT *, unnest(range(1, len(w) - least({SHINGLE}, len(w)) + 2)) AS p FROM b WHERE len(w) > 0)),
n AS (SELECT rid, item_id, count(*) AS n_item FROM i GROUP BY ALL),
k AS (SELECT DISTINCT k FROM i),
s AS (SELECT DISTINCT doc_id, k, array_to_string(w[p:p + k - 1], ' ') AS s
      FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS p FROM d, k WHERE len(w) >= k)),
m AS (SELECT doc_id, rid, count(*) AS n_shared FROM s JOIN i USING (k, s) GROUP BY ALL)
SELECT doc_id, item_id, n_shared, n_item, CAST(n_shared AS DOUBLE) / n_item AS containment
FROM m JOIN n USING (rid) WHERE n_shared >= greatest(1, ceil({THRESHOLD} * n_item - 1e-9))
"""
