"""Toxicity by a noisy channel: disguised words are restored under a character language model, and the restored text is scored.

Language model: trigrams of 29 classes (a to z with accents folded away, other letters, digits, and one boundary for all else), counted over all documents, digits beside letters left out.
Its table has a fixed size, so only that reaches the driver; probabilities are interpolated with bigrams and unigrams and add up to one.

Channel: a writer may put a sign in place of a letter (LEET), stretch a letter (runs of three and more stand for one or two), or part a word's
letters by a separator (three single letters and more with the same sign between them). Each costs some nats. A span where any of these can have happened becomes a lattice, in which every
sign, run and separator has its literal reading too, and Viterbi's algorithm takes its likeliest path. All other text has one reading and is not touched. In a long span, paths
that have met are written out on the way, so memory doesn't grow with the span.

Scoring: features are the restored text's words and word beginnings of 4 to 6 letters, found by one automaton. A feature weighs its log odds between
toxic and other labelled documents if those differ beyond chance; a document's greatest weight, its five greatest, and how often and how densely weighty ones
occur are calibrated by logistic regression, on documents that the weights were not learnt from (halves take turns).

Labels are learnt from MAX_LABELLED documents at most (the documented bound; those with the least hashes of doc_id), and only from ids whose crc32 leaves a remainder mod HELD_OUT other than 0.
The language model and the scores cover all documents.

Defined cases: a null text is empty and scored as such; a null id is never held out nor learnt from; labels are taken once for an id (toxic if any of its rows is), null ones are ignored;
repeated documents are scored each; without labels of both classes each document's score is the share of toxic labels (0 without any); an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .quality import Logistic

#: What a sign can stand for.
LEET = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "€": "e", "£": "l",
}
#: Nats of a sign for a letter, of a stretched letter, of a separator put in.
SIGN_COST, RUN_COST, PART_COST = 2.0, 1.0, 1.0
#: A run of more signs than this is a number or a rule, not letters.
MAX_SIGNS = 6
HELD_OUT = 5
MAX_LABELLED = 20_000
#: Features that a model keeps at most: those in most toxic documents.
MAX_FEATURES = 50_000
#: Toxic documents that a feature needs, and twice the log of the likelihood ratio from which its share differs beyond chance.
LEAST_DOCS, LEAST_G = 3, 13.0
BEGINNINGS = (4, 5, 6)

#: Classes: 0 boundary, 1 to 26 letters, 27 other letters, 28 digits.
SIZE = 29
_FOLDED = 0x250


def _class(c: str) -> int:
    base = unicodedata.normalize("NFKD", c.lower())[:1]
    if "a" <= base <= "z":
        return ord(base) - 96
    return 28 if c.isdigit() else 27 if c.isalpha() else 0


CLASSES = np.array([_class(chr(i)) for i in range(_FOLDED)] + [27], np.int64)


def class_of(c: str) -> int:
    return int(CLASSES[min(ord(c), _FOLDED)])


def trigram_counts(texts: list[str]) -> np.ndarray:
    """Counts of all class trigrams; texts stand apart by two boundaries."""
    points = np.frombuffer("  ".join(["", *texts, ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
    c = CLASSES[np.minimum(points, _FOLDED)]
    return np.bincount((c[:-2] * SIZE + c[1:-1]) * SIZE + c[2:], minlength=SIZE**3)


def language_model(counts: np.ndarray, weight: float = 5.0) -> np.ndarray:
    """log p(c | a, b) at [a, b, c]: trigrams, smoothed by bigrams, these by unigrams, these by one more of each. The model is one of undisguised text: digits
    beside letters count for nothing, however many there are."""
    n3 = counts.reshape(SIZE, SIZE, SIZE).astype(np.float64)
    for letters, digits in ((slice(1, SIZE - 1), SIZE - 1), (SIZE - 1, slice(1, SIZE - 1))):
        n3[letters, digits, :] = 0
        n3[:, letters, digits] = 0
    n2, n1 = n3.sum(0), n3.sum((0, 1))
    p1 = (n1 + 1) / (n1.sum() + SIZE)
    p2 = (n2 + weight * p1) / (n2.sum(1, keepdims=True) + weight)
    return np.log((n3 + weight * p2) / (n3.sum(2, keepdims=True) + weight))


_SIGNS = "".join(LEET)
_S = re.escape(_SIGNS)
_LETTER = r"[^\W\d_]"
#: A token in which a sign stands before a letter, or after two letters; parted single letters; a stretched letter.
_SIGNED = re.compile(rf"(?<![\w{_S}])(?=(?:{_LETTER})*+(?:[{_S}])++{_LETTER}|{_LETTER}{{2,}}+[0-9@$€£])[\w{_S}]++")
_SINGLE = rf"(?:{_LETTER}|[{_S}])(?![^\W_]|[{_S}])"
_PARTED = re.compile(rf"(?<![\w{_S}.*-]){_SINGLE}([ ._*-]){_SINGLE}(?:\1{_SINGLE})++")
_STRETCHED = re.compile(rf"({_LETTER})\1\1++")
_WORD_END = re.compile(rf"[^\w{_S}]|\Z")


def spans(text: str) -> list[tuple[int, int]]:
    """Where a disguise can be, in order and apart from each other."""
    found = [m.span() for m in _SIGNED.finditer(text)] + [m.span() for m in _PARTED.finditer(text)]
    at = 0
    while m := _STRETCHED.search(text, at):
        begin = m.start()
        while begin > at and (text[begin - 1].isalnum() or text[begin - 1] in LEET):
            begin -= 1
        at = _WORD_END.search(text, m.end()).start()
        found.append((begin, at))
    out: list[tuple[int, int]] = []
    for a, b in sorted(found):
        if out and a < out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


_RUNS = re.compile(r"(.)\1*", re.S)


def lattice(span: str):
    """For each run of equal signs, its readings: (text, cost). Texts are lower-case letters where something was restored."""
    parted = _PARTED.fullmatch(span)
    separator = parted.group(1) if parted else None
    signs = 0
    for m in _RUNS.finditer(span):
        c, n = m.group(1), len(m.group())
        if c == separator and n == 1:
            yield [(c, 0.0), ("", PART_COST)]
            continue
        signs = signs + n if c in LEET else 0
        if c in LEET and signs <= MAX_SIGNS:
            out = [(m.group(), 0.0)]
            for letter in LEET[c]:
                out += [(letter * k, SIGN_COST * k if n < 3 else SIGN_COST + RUN_COST) for k in ((n,) if n < 3 else (1, 2))]
            yield out
        elif n >= 3 and c.isalpha():
            yield [(m.group(), 0.0), (c, RUN_COST), (c * 2, RUN_COST)]
        else:
            yield [(m.group(), 0.0)]


class Restorer:
    """Viterbi's algorithm under a language model: lp[(a * SIZE + b) * SIZE + c]."""

    #: Nodes after which paths that have met are written out.
    WINDOW = 1024

    def __init__(self, model: np.ndarray):
        self.lp = model.ravel().tolist()
        self.known: dict[str, str] = {}

    def _emit(self, state: int, text: str) -> tuple[float, int]:
        """Log probability of the text after a state (the last two classes), and the state then."""
        lp, total, n = self.lp, 0.0, len(text)
        if n > 3 and text[0] == text[-1]:  # a run, of which all but the first two have the same terms
            c = class_of(text[0])
            return sum((lp[state * SIZE + c], lp[(state % SIZE * SIZE + c) * SIZE + c])) + (n - 2) * lp[(c * SIZE + c) * SIZE + c], c * SIZE + c
        for x in text:
            c = class_of(x)
            total += lp[state * SIZE + c]
            state = state % SIZE * SIZE + c
        return total, state

    def decode(self, span: str) -> str:
        """The likeliest reading between two boundaries. Of equally likely ones the more literal stands, as it comes first."""
        if (known := self.known.get(span)) is not None:
            return known
        done, back, live = [], [], {0: 0.0}
        for node in lattice(span):
            step: dict[int, tuple[float, int, str]] = {}
            for state, score in live.items():
                for text, cost in node:
                    p, to = self._emit(state, text)
                    p += score - cost
                    if to not in step or p > step[to][0]:
                        step[to] = (p, state, text)
            back.append({to: (s, text) for to, (_, s, text) in step.items()})
            live = {to: p for to, (p, _, _) in step.items()}
            if len(live) == 1 or len(back) % self.WINDOW == 0:
                back = self._write_out(back, live, done)
        # A boundary ends the word.
        best = max(live, key=lambda s: live[s] + self.lp[s * SIZE])
        out = "".join(done) + "".join(self._path(back, best))
        if len(span) <= 64:
            if len(self.known) > 20_000:
                self.known.clear()
            self.known[span] = out
        return out

    @staticmethod
    def _path(back: list[dict], state: int) -> list[str]:
        out = []
        for step in reversed(back):
            state, text = step[state]
            out.append(text)
        return out[::-1]

    @staticmethod
    def _write_out(back: list[dict], live: dict[int, float], done: list[str]) -> list[dict]:
        """Write the part that all living paths have in common; the steps that are left."""
        ends, at = set(live), len(back)
        while at and len(ends) > 1:
            at -= 1
            ends = {back[at][s][0] for s in ends}
        if at and len(ends) == 1:
            done += Restorer._path(back[:at], ends.pop())
            return back[at:]
        return back

    def restore(self, text: str) -> tuple[str, int]:
        """The text with disguises undone, and how many spans changed."""
        parts, at, changed = [], 0, 0
        for a, b in spans(text):
            own = text[a:b]
            new = self.decode(own)
            if new != own:
                parts += [text[at:a], new]
                at, changed = b, changed + 1
        return ("".join([*parts, text[at:]]), changed) if changed else (text, 0)


_NO_LETTER = re.compile(r"[\W\d_]+")


def normal(text: str) -> str:
    """Words in lower case between single spaces, one at both ends."""
    return f" {_NO_LETTER.sub(' ', text.lower()).strip()} "


def all_features(text: str) -> set[str]:
    """Beginnings as ' abcd', whole words as ' abcd '."""
    out = set()
    for w in set(normal(text).split()):
        if len(w) >= 3:
            out.add(f" {w} ")
            out.update(f" {w[:k]}" for k in BEGINNINGS if len(w) >= k)
    return out


class Finder:
    """Finds features and sums up their weights."""

    def __init__(self, weights: dict[str, float]):
        import ahocorasick

        self.weights = list(weights.values())
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for i, f in enumerate(weights):
            self.automaton.add_word(f, i)
        if weights:
            self.automaton.make_automaton()

    def found(self, text: str) -> Counter:
        """How often each feature occurs in a normal text."""
        return Counter(i for _, i in self.automaton.iter(text)) if self.weights else Counter()

    def summary(self, text: str) -> list[float]:
        """Greatest weight, sum of the five greatest, log of weighty features' occurrences, and those for each word."""
        own, words = self.found(text), max(1, text.count(" ") - 1)
        if not own:
            return [0.0, 0.0, 0.0, 0.0]
        top = sorted((self.weights[i] for i in own), reverse=True)[:5]
        n = sum(own.values())
        return [top[0], sum(top), math.log1p(n), math.log1p(1000 * n / words)]


def weights_of(counts: dict[str, tuple[int, int]], toxic: int, other: int) -> dict[str, float]:
    """Log odds of the features whose share of toxic documents is higher beyond chance. counts: (toxic, other) documents."""
    out, n = {}, toxic + other
    for f, (t, c) in counts.items():
        if t < LEAST_DOCS or t * other <= c * toxic:
            continue
        parts = ((t, toxic * (t + c) / n), (c, other * (t + c) / n), (toxic - t, toxic * (n - t - c) / n), (other - c, other * (n - t - c) / n))
        if 2 * sum(o * math.log(o / e) for o, e in parts if o > 0) >= LEAST_G:
            out[f] = math.log((t + 0.5) / (toxic + 1)) - math.log((c + 0.5) / (other + 1))
    return out


class Model:
    """What scoring needs: the language model, the weights and their calibration, or one score for all."""

    def __init__(self, language: np.ndarray, weights: dict[str, float], calibration: Logistic | None, share: float):
        self.language, self.weights, self.calibration, self.share = language, weights, calibration, share

    def scores(self, rows: list[list[float]]) -> np.ndarray:
        if self.calibration is None:
            return np.full(len(rows), self.share)
        return 1 / (1 + np.exp(-self.calibration.odds(np.array(rows, np.float64).reshape(-1, 4))))


def remainder(id_col: str = "doc_id"):
    return F.crc32(F.col(id_col).cast("long").cast("string").cast("binary")) % HELD_OUT


def labelled(docs: DataFrame, labels: DataFrame, most: int) -> DataFrame:
    """(text, toxic, half) of the documents that are learnt from: `most` labels at most, each with one row of its id."""
    own = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    own = own.where(remainder() != 0).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), common.text_of().alias("text"))
    # `most` rows at most are broadcast.
    rows = texts.join(F.broadcast(own), "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))
    return rows.select("text", (F.col("toxic") > 0).alias("toxic"), (remainder() > 2).alias("half"))


def count_trigrams(docs: DataFrame) -> np.ndarray:
    def make():
        def f(batch: pa.RecordBatch) -> pa.RecordBatch:
            n = trigram_counts(common.column(batch, "text").to_pylist())
            at = np.flatnonzero(n)
            return pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(n[at], pa.int64())], ["k", "n"])

        return f

    out = np.zeros(SIZE**3, np.int64)
    made = common.map_slices(docs.select(common.text_of().alias("text")), make, "k int, n long").groupBy("k").agg(F.sum("n").alias("n")).toArrow()
    out[made.column("k").to_numpy()] = made.column("n").to_numpy()
    return out


def train(docs: DataFrame, labels: DataFrame, most: int = MAX_LABELLED) -> Model:
    scratch = common.Scratch(docs.sparkSession, "toxicity")
    language = language_model(count_trigrams(docs))

    def restored():
        r = Restorer(language)

        def f(batch: pa.RecordBatch) -> pa.RecordBatch:
            texts = [normal(r.restore(t)[0]) for t in common.column(batch, "text").to_pylist()]
            return pa.RecordBatch.from_arrays([pa.array(texts), common.column(batch, "toxic"), common.column(batch, "half")], ["text", "toxic", "half"])

        return f

    known = scratch.keep(common.map_slices(labelled(docs, labels, most), restored, "text string, toxic boolean, half boolean"))
    sizes = {(r["toxic"], r["half"]): r["n"] for r in known.groupBy("toxic", "half").agg(F.count("*").alias("n")).collect()}
    size = lambda toxic, half=None: sum(n for (t, h), n in sizes.items() if t == toxic and (half is None or h == half))
    toxic, other = size(True), size(False)
    if not toxic or not other:
        scratch.drop(known)
        return Model(language, {}, None, toxic / max(1, toxic + other))

    def candidates():
        def f(batch: pa.RecordBatch) -> pa.RecordBatch:
            # Documents of the slice are added up here, before the shuffle.
            n: dict[bool, Counter] = {False: Counter(), True: Counter()}
            for text, half in zip(common.column(batch, "text").to_pylist(), common.column(batch, "half").to_pylist()):
                n[half].update(all_features(text))
            rows = [(x, n[False][x], n[True][x]) for x in n[False].keys() | n[True].keys()]
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.string(), pa.int64(), pa.int64()))], ["f", "a", "b"])

        return f

    made = common.map_slices(known.where("toxic"), candidates, "f string, a long, b long").groupBy("f").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    chosen = made.where(F.col("a") + F.col("b") >= LEAST_DOCS).orderBy(F.desc(F.col("a") + F.col("b")), "f").limit(MAX_FEATURES).collect()
    names = [r["f"] for r in chosen]
    t_a, t_b = np.array([r["a"] for r in chosen], np.int64), np.array([r["b"] for r in chosen], np.int64)

    def others():
        finder = Finder(dict.fromkeys(names, 0.0))

        def f(batch: pa.RecordBatch) -> pa.RecordBatch:
            n: dict[bool, Counter] = {False: Counter(), True: Counter()}
            for text, half in zip(common.column(batch, "text").to_pylist(), common.column(batch, "half").to_pylist()):
                n[half].update(finder.found(text).keys())
            at = sorted(n[False].keys() | n[True].keys())
            return pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array([n[False][i] for i in at], pa.int64()), pa.array([n[True][i] for i in at], pa.int64())], ["i", "a", "b"])

        return f

    c_a, c_b = np.zeros(len(names), np.int64), np.zeros(len(names), np.int64)
    for r in common.map_slices(known.where("not toxic"), others, "i int, a long, b long").groupBy("i").agg(F.sum("a").alias("a"), F.sum("b").alias("b")).collect():
        c_a[r["i"]], c_b[r["i"]] = r["a"], r["b"]
    by_half = [dict(zip(names, zip(t.tolist(), c.tolist()))) for t, c in ((t_a, c_a), (t_b, c_b), (t_a + t_b, c_a + c_b))]
    learnt = [weights_of(by_half[0], size(True, False), size(False, False)), weights_of(by_half[1], size(True, True), size(False, True)), weights_of(by_half[2], toxic, other)]

    def summaries():
        # Each half is summed up by the weights of the other.
        finders = {False: Finder(learnt[1]), True: Finder(learnt[0])}

        def f(batch: pa.RecordBatch) -> pa.RecordBatch:
            rows = [finders[h].summary(t) for t, h in zip(common.column(batch, "text").to_pylist(), common.column(batch, "half").to_pylist())]
            return pa.RecordBatch.from_arrays([pa.array(rows, pa.list_(pa.float64())), common.column(batch, "toxic")], ["x", "toxic"])

        return f

    rows = common.map_slices(known, summaries, "x array<double>, toxic boolean").toArrow()
    x = np.array(rows.column("x").to_pylist(), np.float64).reshape(-1, 4)
    calibration = Logistic(x, rows.column("toxic").to_numpy().astype(np.float64))
    scratch.drop(known)
    return Model(language, learnt[2], calibration, toxic / (toxic + other))


SCHEMA = "doc_id long, held_out boolean, score double, predicted int, n_restored long"


def score(docs: DataFrame, model: Model, with_text: bool = False) -> DataFrame:
    """One row for each row of docs; with_text adds the restored text."""
    schema = SCHEMA + (", restored string" if with_text else "")

    def make():
        restorer, finder = Restorer(model.language), Finder(model.weights)

        def f(batch: pa.RecordBatch) -> pa.RecordBatch:
            done = [restorer.restore(t) for t in common.column(batch, "text").to_pylist()]
            p = model.scores([finder.summary(normal(t)) for t, _ in done])
            columns = [common.column(batch, "doc_id"), common.column(batch, "held_out"), pa.array(p, pa.float64()), pa.array((p >= 0.5).astype(np.int32)), pa.array([n for _, n in done], pa.int64())]
            return pa.RecordBatch.from_arrays(columns + ([pa.array([t for t, _ in done])] if with_text else []), [c.split()[0] for c in schema.split(", ")])

        return f

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(remainder() == 0, F.lit(False)).alias("held_out"), common.text_of().alias("text"))
    return common.map_slices(rows, make, schema)


def query(spark, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    return score(docs, train(docs, common.table(spark, sf_dir, "labels")))
