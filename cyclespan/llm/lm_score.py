"""Language-model scores from a log-frequency Bloom filter (Talbot and Osborne 2007), parted by hash range.

1. One pass over the texts hashes tokens and packs whole documents into blocks of about BLOCK_TOKENS tokens: the block's different words,
   and each token as a place among them. All later steps read blocks, never texts.
2. Each block sends its different n-grams, with how often learnt texts have them (0 for those of held-out texts alone), to the n-grams' hash
   ranges. The number of ranges follows the corpus, so a range holds about RANGE_TOKENS learnt tokens at any size.
3. A range's task adds up the counts and makes its part of the filter: a count of level k (LEVELS: 1, 2, 3, 4, then steps of a quarter) enters
   once for each level up to k. Then it answers the blocks' n-grams from the part: membership of level 1, 2, ... is asked until one is
   missing, which gives the level back, never too low, and too high with the small probability of a false positive.
4. The answers meet their blocks again, and each text is scored.

The filter grows with the corpus at BITS_PER_ENTRY bits an entry and is never held whole by the driver or a worker: of one filter of 6 GB
at 30 GB of text each worker would need a copy. There are no cutoffs and no bounds that change a score.

Score: p(w|uv) = (c(uvw) + MU p(w|v)) / (max(c(uv), c(uvw)) + MU), and so on down to p(w) = (c(w) + 0.5) / (N + 0.5 (V + 1)), counts being the
values of the filter's levels; before a text's first token stands the start, which is as frequent as the end. base_score takes exact counts, which the ranges send along.

Defined cases: a null text is empty and has one token, the end. A null id counts as the text '' for the fold (so it is
learnt from). Repeated rows are learnt from and scored each. Without learning rows N = V = 0, and all
scores follow from the formulas. An empty table gives an empty result. A text longer than a block is a block of its own. Other columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from . import common

ORDER = 3
BITS_PER_ENTRY = 10
PROBES = 5
MU = 2.0
#: Tokens of a block, and learnt tokens of a hash range.
BLOCK_TOKENS, RANGE_TOKENS = 1 << 20, 700_000
#: Least number of ranges, so that small corpora are spread too.
LEAST_RANGES = 12
_START, _END = np.uint64(0x5851F42D4C957F2D), np.uint64(0x14057B7EF767814F)
_U = np.uint64


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> _U(31))) * _U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> _U(29))) * _U(0x94D049BB133111EB)
    return h ^ (h >> _U(32))


class WordHashes(dict):
    """Hashes of words, kept while they are few."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 200_000:
            self.clear()
        h = self[word] = xxh64_intdigest(word, 1)
        return h


def _levels() -> np.ndarray:
    least = [1]
    while least[-1] < 1 << 62:
        least.append(max(least[-1] + 1, math.ceil(1.25 * least[-1])))
    return np.array(least, np.uint64)


#: The least count of each level, from level 1 on.
LEVELS = _levels()
#: The count that a level stands for: the geometric middle of those in it; 0 for none.
VALUES = np.r_[0.0, np.sqrt(LEVELS[:-1].astype(np.float64) * (LEVELS[1:] - _U(1)).astype(np.float64))]


def level_of(counts: np.ndarray) -> np.ndarray:
    return np.searchsorted(LEVELS[:-1], counts.astype(np.uint64), "right").astype(np.uint8)


def ngrams(h: np.ndarray, first: np.ndarray, order: int) -> list[np.ndarray]:
    """Hashes of the n-grams that end at each token, for n = 1 to order; first marks each text's first token, before which stands the start."""
    out = [h]
    for k in range(2, order + 1):
        before = np.r_[_START, out[-1][:-1]]
        before[first] = _START
        out.append(mix(before * _U(0x9E3779B97F4A7C15) + mix(h + _U(k))))
    return out


def range_of(top: np.ndarray, ranges: int) -> np.ndarray:
    """The range of hashes by their upper 32 bits."""
    return (top * _U(ranges)) >> _U(32)


class Part:
    """One range's part of the filter."""

    def __init__(self, keys: np.ndarray, levels: np.ndarray, bits_per_entry: int = BITS_PER_ENTRY):
        self.nbits = _U(max(64, int(levels.sum(dtype=np.int64)) * bits_per_entry))
        there = np.zeros(-(-int(self.nbits) // 8) * 8, bool)
        for k in range(1, int(levels.max(initial=0)) + 1):
            a, b = self._steps(keys[levels >= k], k)
            for i in range(PROBES):
                there[((a + _U(i) * b) % self.nbits).astype(np.int64)] = True
        self.data = np.packbits(there)

    def _steps(self, keys: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray]:
        x = mix(keys + _U(level * 0xD6E8FEB86659FD93 & (1 << 64) - 1))
        return x & _U(0xFFFFFFFF), (x >> _U(32)) | _U(1)

    def levels(self, keys: np.ndarray) -> np.ndarray:
        """The level of each key: 0 if it isn't there."""
        out, at = np.zeros(len(keys), np.uint8), np.arange(len(keys))
        for k in range(1, len(LEVELS)):
            a, b = self._steps(keys[at], k)
            for i in range(PROBES):
                s = ((a + _U(i) * b) % self.nbits).astype(np.int64)
                hit = (self.data[s >> 3] >> (7 - (s & 7)).astype(np.uint8)) & 1 == 1
                at, a, b = at[hit], a[hit], b[hit]
            if not len(at):
                break
            out[at] = k
        return out


# Packing


def zipped(data: bytes) -> bytes:
    return np.uint64(len(data)).tobytes() + pa.compress(data, codec="zstd", asbytes=True)


def unzipped(data: bytes) -> bytes:
    return pa.decompress(data[8:], int(np.frombuffer(data, np.uint64, 1)[0]), "zstd", asbytes=True)


def pack(x: np.ndarray) -> bytes:
    """Whole numbers, byte by byte (all lowest bytes, then all second ones, ...), in as many bytes as the greatest needs."""
    width = max(1, -(-int(x.max(initial=0)).bit_length() // 8))
    return zipped(bytes([width]) + np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes())


def unpack(data: bytes) -> np.ndarray:
    data = unzipped(data)
    out = np.zeros(((len(data) - 1) // data[0], 8), np.uint8)
    out[:, : data[0]] = np.frombuffer(data, np.uint8, -1, 1).reshape(data[0], -1).T
    return out.view("<u8").ravel()


_WIDE = _U(0xFFFFFFFF)


def pack_sorted(q: np.ndarray) -> bytes:
    """Ascending numbers as differences of 32 bits; those that are wider follow behind."""
    d = np.diff(q, prepend=_U(0))
    wide = d >= _WIDE
    narrow = pack(np.where(wide, _WIDE, d))
    return np.uint32(len(narrow)).tobytes() + narrow + d[wide].tobytes()


def unpack_sorted(data: bytes) -> np.ndarray:
    n = int(np.frombuffer(data, np.uint32, 1)[0])
    d = unpack(data[4 : 4 + n])
    wide = d == _WIDE
    d[wide] = np.frombuffer(data[4 + n :], np.uint64)
    return np.cumsum(d, dtype=np.uint64)


# Blocks

BLOCK = "ids array<long>, held array<boolean>, n array<long>, words binary, places binary"


def blocks(texts: DataFrame, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """texts (id, held_out, text) as blocks: ids, whether held out, tokens of each text; the block's word hashes, by frequency; the place of each token among them."""

    def run(batches):
        seen = WordHashes()
        get = seen.__getitem__
        ids, held, n, parts, size = [], [], [], [], 0

        def made():
            h = np.concatenate(parts)
            words, places, counts = np.unique(h, return_inverse=True, return_counts=True)
            order = np.argsort(-counts, kind="stable")
            rank = np.empty(len(order), np.int64)
            rank[order] = np.arange(len(order))
            return pa.RecordBatch.from_arrays(
                [pa.array([ids], pa.list_(pa.int64())), pa.array([held], pa.list_(pa.bool_())), pa.array([n], pa.list_(pa.int64())), pa.array([words[order].tobytes()], pa.binary()), pa.array([pack(rank[places])], pa.binary())],
                ["ids", "held", "n", "words", "places"],
            )

        for batch in batches:
            for piece in common.slices(batch):
                for i, out, t in zip(common.column(piece, "id").to_pylist(), common.column(piece, "held_out").to_pylist(), common.utf8(piece)):
                    w = common.words(t)
                    h = np.empty(len(w) + 1, np.uint64)
                    h[:-1] = np.fromiter(map(get, w), np.uint64, len(w))
                    h[-1] = _END
                    ids.append(i), held.append(out), n.append(len(h)), parts.append(h)
                    size += len(h)
                    if size >= block_tokens:
                        yield made()
                        ids, held, n, parts, size = [], [], [], [], 0
        if ids:
            yield made()

    return texts.mapInArrow(run, BLOCK)


class Block:
    """A block as it was before it was packed."""

    def __init__(self, held: list, n: list, words: bytes, places: bytes, order: int):
        self.n = np.array(n, np.int64)
        self.begin = np.cumsum(self.n) - self.n
        by_rank = np.frombuffer(words, np.uint64)
        by_hash = np.argsort(by_rank)
        self.words = by_rank[by_hash]
        place = np.empty(len(by_hash), np.int64)
        place[by_hash] = np.arange(len(by_hash))
        #: Of each token, its place among the words, which ascend.
        self.at = place[unpack(places).astype(np.int64)]
        self.learnt = np.repeat(~np.array(held, bool), self.n)
        self.first = np.zeros(len(self.at), bool)
        self.first[self.begin] = True
        #: Of each token, the n-grams of order 2 and up that end there, as 48-bit numbers.
        self.grams = [g >> _U(16) for g in ngrams(self.words[self.at], self.first, order)[1:]]


def _edges(ranges_of: np.ndarray, ranges: int) -> np.ndarray:
    return np.searchsorted(ranges_of, np.arange(ranges + 1, dtype=np.uint64))


def asked(block_rows: DataFrame, order: int, ranges: int) -> DataFrame:
    """(rng, block, words, word_counts, grams, gram_counts): each block's different n-grams by range, with their learnt counts."""

    def run(batches):
        for batch in batches:
            for block, held, n, words, places in zip(*(common.column(batch, c).to_pylist() for c in ("block", "held", "n", "words", "places"))):
                b = Block(held, n, words, places, order)
                word_counts = np.bincount(b.at[b.learnt], minlength=len(b.words)).astype(np.uint64)
                # The number above, whether it is learnt below: one sort gives both.
                both = np.concatenate([g << _U(1) | b.learnt.astype(np.uint64) for g in b.grams] or [np.empty(0, np.uint64)])
                both.sort()
                q = both >> _U(1)
                start = np.flatnonzero(np.r_[True, q[1:] != q[:-1]]) if len(q) else np.empty(0, np.int64)
                counts = np.add.reduceat(both & _U(1), start) if len(q) else np.empty(0, np.uint64)
                q = q[start]
                w_edge, q_edge = _edges(range_of(b.words >> _U(32), ranges), ranges), _edges(range_of(q >> _U(16), ranges), ranges)
                rows = []
                for r in np.flatnonzero((np.diff(w_edge) > 0) | (np.diff(q_edge) > 0)).tolist():
                    w, g = slice(w_edge[r], w_edge[r + 1]), slice(q_edge[r], q_edge[r + 1])
                    rows.append((r, block, b.words[w].tobytes(), pack(word_counts[w]), pack_sorted(q[g]), pack(counts[g])))
                types = [pa.int32(), pa.int64()] + [pa.binary()] * 4
                yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows), types)], ["rng", "block", "words", "word_counts", "grams", "gram_counts"])

    return block_rows.select("block", "held", "n", "words", "places").mapInArrow(run, "rng int, block long, words binary, word_counts binary, grams binary, gram_counts binary")


def _added(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(different keys, their counts, the place of each given key among them)."""
    if not keys:
        return np.empty(0, np.uint64), np.empty(0, np.uint64), np.empty(0, np.int64)
    k, back = np.unique(np.concatenate(keys), return_inverse=True)
    return k, np.bincount(back, np.concatenate(counts).astype(np.float64), len(k)).astype(np.uint64), back


ANSWER = "rng int, block long, word_levels binary, word_counts binary, gram_levels binary, n_tokens long, n_words long"


def answered(asks: DataFrame, bits_per_entry: int = BITS_PER_ENTRY) -> DataFrame:
    """For each row of asked its levels and exact word counts; and for each range one row of block -1 with its learnt tokens and words."""

    def answer(table: pa.Table) -> pa.Table:
        rng, block = table.column("rng")[0].as_py(), table.column("block").to_pylist()
        words = [np.frombuffer(x, np.uint64) for x in table.column("words").to_pylist()]
        grams = [unpack_sorted(x) for x in table.column("grams").to_pylist()]
        w, w_n, w_back = _added(words, [unpack(c) for c in table.column("word_counts").to_pylist()])
        g, g_n, g_back = _added(grams, [unpack(c) for c in table.column("gram_counts").to_pylist()])
        keys = np.concatenate([w, g << _U(16)])
        counts = np.concatenate([w_n, g_n])
        there = counts > 0
        part = Part(keys[there], level_of(counts[there]), bits_per_entry)
        levels = part.levels(keys)
        w_level, g_level = levels[: len(w)][w_back], levels[len(w) :][g_back]
        w_count = w_n[w_back]
        a, b = np.cumsum([0, *map(len, words)]), np.cumsum([0, *map(len, grams)])
        columns = [
            pa.array([rng] * (len(block) + 1), pa.int32()), pa.array([*block, -1], pa.int64()),
            pa.array([*(zipped(w_level[i:j].tobytes()) for i, j in zip(a, a[1:])), b""], pa.binary()), pa.array([*(pack(w_count[i:j]) for i, j in zip(a, a[1:])), b""], pa.binary()),
            pa.array([*(zipped(g_level[i:j].tobytes()) for i, j in zip(b, b[1:])), b""], pa.binary()),
            pa.array([0] * len(block) + [int(w_n.sum())], pa.int64()), pa.array([0] * len(block) + [int((w_n > 0).sum())], pa.int64()),
        ]
        return pa.Table.from_arrays(columns, ["rng", "block", "word_levels", "word_counts", "gram_levels", "n_tokens", "n_words"])

    return asks.groupBy("rng").applyInArrow(answer, ANSWER)


SCHEMA = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", order: int = ORDER, folds: int = 5, fold: int = 1, bits_per_entry: int = BITS_PER_ENTRY, block_tokens: int = BLOCK_TOKENS, range_tokens: int = RANGE_TOKENS) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score): all rows scored, learning from those that aren't held out."""
    scratch = common.Scratch(docs.sparkSession, "lm")
    held = F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))) % folds == fold
    texts = docs.select(F.col(id_col).cast("long").alias("id"), common.text_of(text_col).alias("text"), held.alias("held_out"))
    # The number is drawn when the table is written, so it names the block from then on.
    block_rows = scratch.keep(blocks(texts, block_tokens).withColumn("block", F.monotonically_increasing_id()))
    size = block_rows.agg(F.sum(F.expr("aggregate(zip_with(held, n, (h, k) -> if(h, 0L, k)), 0L, (s, k) -> s + k)"))).first()[0] or 0
    ranges = max(LEAST_RANGES, -(-size // range_tokens))
    answers = scratch.keep(answered(asked(block_rows, order, ranges), bits_per_entry))
    n_all, n_words = (x or 0 for x in answers.where("block = -1").agg(F.sum("n_tokens"), F.sum("n_words")).first())
    whole = n_all + 0.5 * (n_words + 1)

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        ids, row = left.column("ids")[0].as_py(), {c: left.column(c)[0].as_py() for c in ("held", "n", "words", "places")}
        b = Block(**row, order=order)
        by_range = np.argsort(right.column("rng").to_numpy())
        get = lambda c: [right.column(c)[int(i)].as_py() for i in by_range]
        word_value, gram_value = (VALUES[np.frombuffer(b"".join(map(unzipped, get(c))), np.uint8)] for c in ("word_levels", "gram_levels"))
        exact = np.concatenate([unpack(c) for c in get("word_counts")])
        asked_grams, back = np.unique(np.concatenate(b.grams or [np.empty(0, np.uint64)]), return_inverse=True)
        if len(word_value) != len(b.words) or len(gram_value) != len(asked_grams):
            raise ValueError("a block's answers do not fit its n-grams")
        base = np.add.reduceat(np.log10((exact + 0.5) / whole)[b.at], b.begin)
        known = np.add.reduceat((exact > 0).astype(np.int64)[b.at], b.begin)
        own = [word_value[b.at], *np.split(gram_value[back], order - 1)] if order > 1 else [word_value[b.at]]
        end = np.searchsorted(b.words, _END)
        p = (own[0] + 0.5) / whole
        for below, c in zip(own, own[1:]):
            context = np.r_[0.0, below[:-1]]
            context[b.first] = word_value[end]
            p = (c + MU * p) / (np.maximum(context, c) + MU)
        total = np.add.reduceat(np.log10(np.minimum(p, 1.0)), b.begin)
        m = len(ids)
        columns = [pa.array(ids, pa.int64()), pa.array(row["held"], pa.bool_()), pa.array(b.n), pa.array(known), pa.array([n_all] * m, pa.int64()), pa.array(base), pa.array(total)]
        return pa.Table.from_arrays(columns, [x.split()[0] for x in SCHEMA.split(", ")])

    kept = answers.where("block >= 0").select("block", "rng", "word_levels", "word_counts", "gram_levels")
    return block_rows.groupBy("block").cogroup(kept.groupBy("block")).applyInArrow(score, SCHEMA)


def query(spark, sf_dir: str) -> DataFrame:
    return scores(common.table(spark, sf_dir, "documents"))
