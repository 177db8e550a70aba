"""Byte-level BPE by recursive queries: each Arrow batch's words are contracted by DuckDB, within the task.

A text is parted by the tokenizer's pattern. A word that is itself a token has that one id. All other
different words go as lists of byte ids to a recursive query: token-position rows join the merge table, each word's
leftmost pair of the least rank is contracted, and a word without a pair that merges is final. Ranks are ids, so the pair's rank
is the merged token. Ordered aggregation of the tokens' bytes, looked up by id, decodes the ids of all words, single tokens too.
A task keeps the words of its last texts in two generations of KEPT_BYTES each; a word that is met again moves to the younger
one, so frequent words stay and rare ones cost no memory for long.

Words of over LONG bytes go through the same query as overlapping windows, since its rounds grow with a word's length. Windows are joined only where
two of them have the same token before and behind a cut, which proves the cut: call two tokens compatible if their bytes together are encoded as just these two. Neighbours in any
encoding are compatible (no merge crossed them, and a merge depends on nothing but the bytes that it joins). And a row of tokens whose neighbours are all compatible is the encoding of its bytes: the first
merge to cross a cut would cross it for the two tokens at the cut alone, too. Where windows have no cut in common, as in repeated patterns that they begin
at different places of, the next one begins at a cut of the last; where that fails, all is done again with windows of twice the size. Time and memory grow with a word's length.

Defined cases: a null text is empty: no tokens, digests of the empty string. Repeated rows are encoded each; null ids
are kept; an empty table gives an empty result; other columns are ignored. DuckDB runs in memory with one thread
and a fixed limit and writes no files.
"""

from __future__ import annotations

import base64
import gc
import hashlib
import itertools
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

VOCABULARY = "byte_bpe_50k.tiktoken"
LONG = 256
#: Bytes of a window at first, and windows of one call.
WINDOW, CALL_WINDOWS = 64, 4096
#: Ids of one list that is decoded at once.
DECODE_IDS = 50_000
#: Bytes of a generation of kept words, as estimated from their lengths.
KEPT_BYTES = 40 << 20
#: Bytes of text that are encoded at once, and words of one call of the recursive query.
SLICE_BYTES, CALL_WORDS = 2 << 20, 60_000

_SHORT_SQL = """
WITH RECURSIVE s AS (
  SELECT wid, ids, false AS final FROM start
  UNION ALL
  (WITH p AS (SELECT wid, unnest(ids[:-2]) AS l, unnest(ids[2:]) AS r, unnest(range(1, len(ids))) AS pos FROM s WHERE NOT final),
   best AS (SELECT wid, min((merged::BIGINT << 32) | pos) AS k FROM p JOIN merges ON pair = ((l::BIGINT << 32) | r) GROUP BY wid)
   SELECT s.wid, CASE WHEN k IS NULL THEN ids ELSE ids[:(k & 4294967295) - 1] || [(k >> 32)::INTEGER] || ids[(k & 4294967295) + 2:] END, k IS NULL
   FROM s LEFT JOIN best USING (wid) WHERE NOT final)
), f AS (SELECT wid, ids FROM s WHERE final)
"""
_WHOLE_SQL = "WITH f AS (SELECT wid, ids FROM start)"
_OUT_SQL = """
, d AS (SELECT wid, string_agg(digits, '' ORDER BY pos) AS decoded FROM (SELECT wid, unnest(ids) AS id, unnest(range(len(ids))) AS pos FROM f) JOIN vocabulary USING (id) GROUP BY wid)
SELECT wid, len(ids)::INTEGER AS n, array_to_string(ids, ' ') AS ids, decoded FROM f JOIN d USING (wid)
"""


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class Window:
    """The encoding of a part of a word: ids, where each begins, and the end."""

    def __init__(self, start: int, ids: tuple[int, ...], length: dict[int, int]):
        self.start, self.ids, self.starts, at = start, ids, [], start
        for i in ids:
            self.starts.append(at)
            at += length[i]
        self.end = at

    def cut(self, following: "Window", least: int) -> tuple[int, int] | None:
        """(i, j): from its token j on, `following` can go on instead of this window's token i and all behind it; i is at least `least`."""
        place = {at: i for i, at in enumerate(self.starts)}
        for j, at in enumerate(following.starts):
            i = place.get(at, -1)
            # The same token behind the cut, and before it, too, where `following` has one there.
            if i >= max(least, 1) and self.ids[i] == following.ids[j] and (j == 0 or self.ids[i - 1] == following.ids[j - 1]):
                return i, j
        return None


class Encoder:
    """One worker's tables and the words that it has met."""

    def __init__(self, path: str, pattern: str):
        import duckdb
        import regex

        self.pattern = regex.compile(pattern)
        self.ranks = load_ranks(path)
        self.byte_id = np.array([self.ranks.get(bytes([i]), -1) for i in range(256)], np.int32)
        self.length = {rank: len(token) for token, rank in self.ranks.items()}
        left, right, merged = [], [], []
        for token, rank in self.ranks.items():
            for i in range(1, len(token)):
                u, v = self.ranks.get(token[:i]), self.ranks.get(token[i:])
                if u is not None and v is not None:
                    left.append(u), right.append(v), merged.append(rank)
        pairs = pa.table({"l": pa.array(left, pa.int64()), "r": pa.array(right, pa.int64()), "merged": pa.array(merged, pa.int32())})
        tokens = pa.table({"id": pa.array(list(self.ranks.values()), pa.int32()), "bytes": pa.array(list(self.ranks), pa.binary())})
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": "500MB", "temp_directory": ""})
        self.db.register("pairs", pairs)
        self.db.register("tokens", tokens)
        self.db.execute("CREATE TABLE merges AS SELECT (l << 32) | r AS pair, merged FROM pairs")
        self.db.execute("CREATE TABLE vocabulary AS SELECT id, hex(bytes) AS digits FROM tokens")
        self.db.unregister("pairs"), self.db.unregister("tokens")
        self.known: dict[str, tuple[int, str, bytes]] = {}
        self.older: dict[str, tuple[int, str, bytes]] = {}
        self.held = 0

    def forget(self) -> None:
        """Free the words; the tables stay."""
        self.known, self.older, self.held = {}, {}, 0
        trim()

    def _run(self, ids: np.ndarray, lengths: np.ndarray, sql: str) -> zip:
        """(place, number of ids, ids, decoded bytes as hexadecimal digits) of each word; ids: those that the words begin with, so many of each."""
        edges = np.zeros(len(lengths) + 1, np.int32)
        np.cumsum(lengths, out=edges[1:])
        lists = pa.ListArray.from_arrays(pa.array(edges), pa.array(ids, pa.int32()))
        self.db.register("start", pa.table({"wid": np.arange(len(lengths), dtype=np.int32), "ids": lists}))
        out = self.db.execute(sql + _OUT_SQL).fetchnumpy()
        self.db.unregister("start")
        return zip(out["wid"].tolist(), out["n"].tolist(), out["ids"].tolist(), out["decoded"].tolist())

    def _contract(self, words: list[bytes]) -> zip:
        return self._run(self.byte_id[np.frombuffer(b"".join(words), np.uint8)], np.fromiter(map(len, words), np.int64, len(words)), _SHORT_SQL)

    def learn(self, words: set[str]) -> None:
        """Make all of words known."""
        if self.held > KEPT_BYTES:
            self.known, self.older, self.held = {}, self.known, 0
        new = words.difference(self.known)
        again = new.intersection(self.older)
        for w in again:
            own = self.known[w] = self.older[w]
            self.held += 300 + 3 * len(own[2]) + len(own[1])
        left = list(new - again)
        own = [w.encode("utf-8", "surrogatepass") for w in left]
        ranks = list(map(self.ranks.get, own))
        whole = [(w, r) for w, r in zip(left, ranks) if r is not None]
        rest: dict[bool, list[tuple[str, bytes]]] = {False: [], True: []}
        for w, b, r in zip(left, own, ranks):
            if r is None:
                rest[len(b) > LONG].append((w, b))
        for at in range(0, len(whole), CALL_WORDS):
            part = whole[at : at + CALL_WORDS]
            self._keep([w for w, _ in part], self._run(np.array([r for _, r in part], np.int32), np.ones(len(part), np.int64), _WHOLE_SQL))
        short = rest[False]
        for at in range(0, len(short), CALL_WORDS):
            part = short[at : at + CALL_WORDS]
            self._keep([w for w, _ in part], self._contract([b for _, b in part]))
        for w, b in rest[True]:
            self._keep([w], self._decoded(self.encode_long(b)))

    def _decoded(self, ids: list[int]) -> list[tuple[int, int, str, str]]:
        """A long word as _run gives it, decoded in lists of bounded length."""
        texts, decoded = [], []
        for at in range(0, len(ids), DECODE_IDS):
            part = np.array(ids[at : at + DECODE_IDS], np.int32)
            ((_, _, text, own),) = self._run(part, np.array([len(part)]), _WHOLE_SQL)
            texts.append(text), decoded.append(own)
        return [(0, len(ids), " ".join(texts), "".join(decoded))]

    def encode_long(self, word: bytes, size: int = WINDOW) -> list[int]:
        """The ids of a word of any length."""
        while True:
            ids = self._spliced(word, size)
            if ids is not None:
                return ids
            size *= 2

    def _spliced(self, word: bytes, size: int) -> list[int] | None:
        """The ids by windows of this size; none if some of them can't be joined."""
        step, n, made, out = size // 2, len(word), {}, []

        def window(start: int) -> Window:
            text = word[start : start + size]
            if text not in made:
                # The windows that come next are contracted in the same call.
                if len(made) > 4 * CALL_WINDOWS:
                    made.clear()
                first = start // step * step
                wanted = list({text, *(word[i : i + size] for i in range(first, min(n, first + CALL_WINDOWS * step), step))}.difference(made) if start % step == 0 else {text})
                for wid, _, ids, _ in self._contract(wanted):
                    made[wanted[wid]] = tuple(map(int, ids.split()))
            return Window(start, made[text], self.length)

        now, at = window(0), 0
        while now.end < n:
            places = [(now.end - step) // step * step]
            middle = now.starts[len(now.starts) // 2 :]
            places += middle[:1]
            for start in places:
                if start > now.start and (cut := now.cut(following := window(start), at)):
                    out += now.ids[at : cut[0]]
                    now, at = following, cut[1]
                    break
            else:
                return None
        return [*out, *now.ids[at:]]

    def _keep(self, words: list[str], made: zip) -> None:
        known, held = self.known, 0
        for wid, n, ids, decoded in made:
            known[words[wid]] = (n, ids, bytes.fromhex(decoded))
            held += 300 + 2 * len(decoded) + len(ids)
        self.held += held

    def encode(self, texts: list[str]) -> list[tuple[int, str, bytes]]:
        """(number of ids, ids joined by a space, their decoded bytes) of each text."""
        collects = gc.isenabled()
        gc.disable()  # many tuples are made, and none in a cycle
        try:
            parted = [self.pattern.findall(t) for t in texts]
            edges = np.zeros(len(texts) + 1, np.int32)
            np.cumsum([len(p) for p in parted], out=edges[1:])
            flat = pa.array(itertools.chain.from_iterable(parted), pa.large_string(), size=int(edges[-1])).dictionary_encode()
            words = flat.dictionary.to_pylist()
            self.learn(set(words))
            # A word that was not encoded ends the task with a KeyError.
            n, ids, decoded = zip(*map(self.known.__getitem__, words)) if words else ((), (), ())
            lists = [pa.ListArray.from_arrays(pa.array(edges), pa.array(x, kind).take(flat.indices)) for x, kind in ((ids, pa.large_string()), (decoded, pa.large_binary()))]
            joined = [pc.binary_join(x, sign).to_pylist() for x, sign in zip(lists, (pa.scalar(" ", pa.large_string()), pa.scalar(b"", pa.large_binary())))]
            total = np.r_[0, np.cumsum(np.array(n, np.int64)[flat.indices.to_numpy()])] if words else np.zeros(1, np.int64)
            return list(zip((total[edges[1:]] - total[edges[:-1]]).tolist(), *joined))
        finally:
            if collects:
                gc.enable()


def trim() -> None:
    """Give freed memory back to the system, where the C library can."""
    import ctypes

    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        return


@lru_cache(maxsize=2)
def encoder(path: str, pattern: str) -> Encoder:
    return Encoder(path, pattern)


SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, round_trip boolean"


def encode(docs: DataFrame, path: str | None = None, pattern: str | None = None, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """One row for each row of docs; with_ids adds the ids as array<int> and the decoded bytes.

    path: a file of base64 tokens and ranks that executors can read; by default the installed package's VOCABULARY.
    """
    schema = SCHEMA + (", ids array<int>, decoded binary" if with_ids else "")

    def make():
        import public_tokenizers

        e = encoder(path or public_tokenizers.path(VOCABULARY), pattern or public_tokenizers.PATTERN)

        def f(batch: pa.RecordBatch) -> pa.RecordBatch:
            ids, texts = (common.column(batch, c).to_pylist() for c in ("id", "text"))
            done = e.encode(texts)
            columns = [
                pa.array(ids, pa.int64()),
                pa.array([n for n, *_ in done], pa.int64()),
                pa.array([hashlib.sha256(s.encode()).hexdigest() for _, s, _ in done]),
                pa.array([hashlib.sha256(b).hexdigest() for *_, b in done]),
                pa.array([b == t.encode("utf-8", "surrogatepass") for t, (*_, b) in zip(texts, done)]),
            ]
            if with_ids:
                columns += [pa.array([[int(x) for x in s.split()] for _, s, _ in done], pa.list_(pa.int32())), pa.array([b for *_, b in done], pa.binary())]
            return pa.RecordBatch.from_arrays(columns, [x.split()[0] for x in schema.split(", ")])

        f.close = e.forget
        return f

    return common.map_slices(docs.select(F.col(id_col).cast("long").alias("id"), common.text_of(text_col).alias("text")), make, schema, size=SLICE_BYTES)


def query(spark, sf_dir: str) -> DataFrame:
    return encode(common.table(spark, sf_dir, "documents"))
