"""Token counts by overlap resynchronisation.

A text of over CHUNK code points is encoded as chunks that overlap, with the tokens' offsets. Two neighbours are
spliced at a position inside the overlap where both have a token boundary and that is proven stable: a space that
follows a character other than a space. No token of the vocabulary holds a space after another character (checked
when the tokenizer is loaded; for tokenizers of the `tokenizers` library and for rank files, whose words are parted before
merging, the parting pattern must be the known one), so no merge crosses such a position and each side's tokens depend on that
side alone. Where an overlap has no such position (long unbroken runs) it is widened to twice its length, back to
the last splice if need be, and in the end the chunk itself grows. So counts are those of the whole text, while
memory is bounded by the chunk unless the text has no stable position. A tokenizer without the proof encodes whole texts.

Defined cases: a null text is empty and has 0 tokens; repeated rows are counted each; null ids are kept; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

TOKENIZER = "piece_bpe_32k.model"
CHUNK = 16_384
OVERLAP = 512
LIMIT = 4096
_SPACES = " ▁"  # sentencepiece writes a space as U+2581
_STABLE = re.compile(f"(?<=[^{_SPACES}])[{_SPACES}]")
_STABLE_WORDS = re.compile(r"(?<=\S) ")


class Tokenizer:
    """counts(texts) and starts(text): the code points at which tokens begin. proven: the pattern of stable positions, or None."""

    def __init__(self, path: str):
        self.path = path
        if path.endswith(".model"):
            import sentencepiece

            self.lib = sentencepiece.SentencePieceProcessor(model_file=path)
            size = self.lib.vocab_size()
            pieces = [self.lib.id_to_piece(i) for i in range(size)]
            # Code points that a piece stands for; of a character's bytes, the first one stands for it.
            self.points = np.array([int(not 0x80 <= int(p[1:-1], 16) < 0xC0) if self.lib.is_byte(i) else 0 if self.lib.is_unknown(i) else len(p) for i, p in enumerate(pieces)], np.int64)
            plain = "".join(self.lib.encode("ﬁ²  x", out_type=str)) == "▁ﬁ²▁▁x" or self._spelt("ﬁ²  x")
            # Without character rewriting, and with no piece that joins a space to what is before it.
            self.proven = _STABLE if plain and not any(re.search("[^▁]▁", p) for p in pieces) else None
        elif path.endswith(".json"):
            import json

            import tokenizers

            self.lib = tokenizers.Tokenizer.from_file(path)
            with open(path, encoding="utf-8") as f:
                made = json.load(f)
            spaced = any(re.search(r"\S\s", t["content"]) for t in made.get("added_tokens") or [])
            self.proven = _STABLE_WORDS if not spaced and not made.get("normalizer") and (made.get("pre_tokenizer") or {}).get("type") == "ByteLevel" else None
        elif path.endswith(".tiktoken"):
            import public_tokenizers
            import tiktoken

            from .bpe import load_ranks

            self.lib = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=load_ranks(path), special_tokens={})
            self.proven = _STABLE_WORDS
        else:
            raise ValueError(f"no library for {path}")

    def counts(self, texts: list[str]) -> list[int]:
        if self.path.endswith(".model"):
            return [len(x) for x in self.lib.encode(texts, num_threads=1)]
        if self.path.endswith(".json"):
            return [len(x.ids) for x in self.lib.encode_batch(texts, add_special_tokens=False)]
        return [len(self.lib.encode_ordinary(t)) for t in texts]

    def _spelt(self, text: str) -> bool:
        return int(self.points[np.array(self.lib.encode(text), np.int64)].sum()) == len(text) + 1

    def starts(self, text: str) -> np.ndarray | None:
        """Sorted; None where the tokens don't spell the text one to one."""
        if self.path.endswith(".model"):
            points = self.points[np.array(self.lib.encode(text, num_threads=1), np.int64)]
            ends = np.cumsum(points)
            # The first token has a space of its own, which is not in the text.
            return np.maximum(ends - points - 1, 0) if len(ends) and ends[-1] == len(text) + 1 else None
        if self.path.endswith(".json"):
            return np.array([a for a, _ in self.lib.encode(text, add_special_tokens=False).offsets], np.int64)
        return np.array(self.lib.decode_with_offsets(self.lib.encode_ordinary(text))[1], np.int64)


@lru_cache(maxsize=4)
def load(path: str) -> Tokenizer:
    return Tokenizer(path)


def count(tokenizer: Tokenizer, text: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> tuple[int, int, int]:
    """(tokens, chunks, times that an overlap was widened) of one text."""
    n = len(text)
    if n <= chunk or tokenizer.proven is None:
        return tokenizer.counts([text])[0], 1, 0
    total, chunks, widened = 0, 1, 0
    begin, end = 0, chunk  # the present chunk
    after = 0  # tokens before this position are counted
    have = tokenizer.starts(text[:end])
    while end < n:
        width, spots = min(overlap, end - begin), []
        while have is not None:
            first = end - width
            last = min(n, first + chunk + width)
            following = tokenizer.starts(text[first:last])
            if following is None:
                break
            mine, other = have[np.searchsorted(have, first - begin) :] + begin, following[: np.searchsorted(following, width)] + first
            both = set(mine.tolist()) & set(other.tolist())
            # Never at the following chunk's first position: its first token may have a begin of its own.
            spots = [m.start() for m in tokenizer.proven.finditer(text, first + 1, end) if m.start() > max(after, first + 1) and m.start() in both]
            if spots or first <= max(after, begin):
                break
            widened += 1
            width = min(2 * width, end - max(after, begin))
        if have is None or following is None:
            return tokenizer.counts([text])[0], 1, widened
        if not spots:  # no stable position in the whole chunk: it grows, twofold, so that the work stays in proportion
            widened += 1
            end = min(n, begin + 2 * (end - begin))
            have = tokenizer.starts(text[begin:end])
            continue
        at = spots[len(spots) // 2]
        total += int(np.searchsorted(have, at - begin) - np.searchsorted(have, after - begin))
        begin, end, after, have = first, last, at, following
        chunks += 1
    if have is None:
        return tokenizer.counts([text])[0], 1, widened
    return total + int(len(have) - np.searchsorted(have, after - begin)), chunks, widened


SCHEMA = "doc_id long, n_bytes long, n_tokens long, over_limit boolean, n_chunks long, n_widened long"


def token_counts(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text", limit: int = LIMIT, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """One row for each row of docs. path: a tokenizer's file that executors can read; by default the installed package's TOKENIZER."""

    def make():
        import public_tokenizers

        tokenizer = load(path or public_tokenizers.path(TOKENIZER))

        def f(batch: pa.RecordBatch) -> pa.RecordBatch:
            ids, texts = (common.column(batch, c).to_pylist() for c in ("id", "text"))
            short = [i for i, t in enumerate(texts) if len(t) <= chunk]
            found = dict(zip(short, ((c, 1, 0) for c in tokenizer.counts([texts[i] for i in short]))))
            rows = [found[i] if i in found else count(tokenizer, t, chunk, overlap) for i, t in enumerate(texts)]
            sizes = [len(t.encode("utf-8", "surrogatepass")) for t in texts]
            columns = [ids, sizes, [r[0] for r in rows], [r[0] > limit for r in rows], [r[1] for r in rows], [r[2] for r in rows]]
            types = [pa.int64()] * 3 + [pa.bool_()] + [pa.int64()] * 2
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], [x.split()[0] for x in SCHEMA.split(", ")])

        return f

    return common.map_slices(docs.select(F.col(id_col).cast("long").alias("id"), common.text_of(text_col).alias("text")), make, SCHEMA)


def query(spark, sf_dir: str) -> DataFrame:
    return token_counts(common.table(spark, sf_dir, "documents"))
