"""Quality classifier by co-training (Blum and Mitchell 1998): a view of the text's content, a view of the page's metadata.

Content: which word beginnings occur (of 4 and of 6 letters). Metadata: language, source, length and layout (lines, share of capitals,
signs, digits, repeated words), as buckets. Each view weighs the features whose share differs between the
classes beyond chance by their log odds; a document's greatest and mean weights are calibrated by logistic regression on labelled rows that the weights
have not been learnt from (halves of the labelled rows take turns). A document is bad if it is labelled as of quality 0 or toxic.

Round 0 learns from at most MAX_LABELLED labelled documents (those with the least hash of doc_id: the documented bound). In each of ROUNDS rounds,
all documents without a label are scored, and those that one view is confident of are counted, with its
label, in the other view's model. Pseudo-labels move the weights of all features of both views; those of a class weigh PSEUDO_SHARE of its labels together at most, however many they are,
so a view that can't see a kind of bad document (metadata: toxic ones) can't outvote the labels. At last both views are calibrated anew and joined by a logistic regression on their log
odds and the greater of them. All documents are scored; a document is rejected from REJECT on. Model.history holds each round's error on labelled documents
that its weights had not seen. A round that raises it is not kept, and ends the exchange.

Counting is distributed: tasks add up features, whose number is fixed (BINS), and only sums for each feature reach the driver.

Defined cases: a null text is empty; null metadata is a value of its own; labels are taken once for a doc_id (bad if any of its rows is),
without an id or with neither label they are ignored; repeated documents are scored, and counted, each, but of the rows of a labelled id one is learnt from (that with the least features); without labels of both classes every document has
the share of bad labels as score (0 without any) and is kept; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh32_intdigest

from . import common

BINS = 1 << 18
MAX_LABELLED = 20_000
ROUNDS = 2
#: Probabilities of being bad from which, and up to which, a view's judgement becomes a pseudo-label. A view that can't see a kind of bad document knows from its
#: calibration that some are left among those that look good, so it is seldom sure of these.
SURE_BAD, SURE_GOOD = 0.98, 0.05
#: Weight of all pseudo-labels of a class, in labels of that class, at most.
PSEUDO_SHARE = 0.1
REJECT = 0.5
#: Documents that a feature needs to count.
LEAST_DOCS = 4

_EDGES = ".,;:!?|\"'()[]{}<>*#-_`«»¿¡“”"
_UPPER, _SIGNS, _DIGITS = bytes(range(65, 91)), b"!|#@$%^*~<>{}[]_=+\\", b"0123456789"


class Beginnings(dict):
    """Bins of a token's content features, kept while they are few."""

    def __missing__(self, token: str) -> tuple[int, ...]:
        if len(self) > 200_000:
            self.clear()
        w = token.strip(_EDGES)
        own = () if len(w) < 3 else (xxh32_intdigest("4" + w[:4]) % BINS,) if len(w) <= 4 else (xxh32_intdigest("4" + w[:4]) % BINS, xxh32_intdigest("6" + w[:6]) % BINS)
        self[token] = own
        return own


def content(tokens: set[str], seen: Beginnings) -> np.ndarray:
    get = seen.__getitem__
    return np.unique(np.array([b for t in tokens for b in get(t)], np.int32))


def _share(part: int, whole: int) -> int:
    """Buckets: none, up to 1 %, 2 %, 5 %, 10 %, 20 %, 40 %, more."""
    r = part / whole if whole else 0.0
    return int(np.searchsorted([0.0, 0.01, 0.02, 0.05, 0.1, 0.2, 0.4], r, "left"))


def metadata(text: str, n_tokens: int, n_distinct: int, lang: str | None, source: str | None, n_chars: int | None) -> np.ndarray:
    b = text.encode("utf-8", "surrogatepass")
    n, lines = max(1, len(b)), text.count("\n") + 1
    made = (
        f"lang={lang}", f"source={source}", f"chars={None if n_chars is None else int(max(0, n_chars)).bit_length()}",
        f"lines={lines.bit_length()}", f"line={(n // lines).bit_length()}",
        f"upper={_share(n - len(b.translate(None, _UPPER)), n)}", f"signs={_share(n - len(b.translate(None, _SIGNS)), n)}", f"digits={_share(n - len(b.translate(None, _DIGITS)), n)}",
        f"distinct={int(10 * n_distinct / max(1, n_tokens))},{min(6, n_tokens.bit_length() // 2)}", f"word={min(20, n // max(1, n_tokens))}",
    )
    return np.unique(np.array([xxh32_intdigest("m" + m) % BINS for m in made], np.int32))


def features(batch: pa.RecordBatch, seen: Beginnings) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """(content, metadata) of each row."""
    content_of, metadata_of = [], []
    for text, lang, source, n in zip(*(common.column(batch, c).to_pylist() for c in ("text", "lang", "source", "n_chars"))):
        text = text or ""
        tokens = text.lower().split()
        distinct = set(tokens)
        content_of.append(content(distinct, seen))
        metadata_of.append(metadata(text, len(tokens), len(distinct), lang, source, n))
    return content_of, metadata_of


#: Of a document's weights, so many of the greatest are added up in its summary.
TOP = 5


def summary(rows: list[np.ndarray], weights: np.ndarray) -> np.ndarray:
    """Of each row: its greatest weight, the sum of its TOP greatest positive ones, and the mean of all."""
    out = np.zeros((len(rows), 3))
    for i, r in enumerate(rows):
        if len(r):
            w = weights[r]
            top = np.sort(w)[-TOP:]
            out[i] = max(0.0, top[-1]), np.maximum(top, 0.0).sum(), w.mean()
    return out


def _probability(odds: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-odds))


class Logistic:
    """Logistic regression on a few columns, by Newton's method with a little ridge."""

    def __init__(self, x: np.ndarray, y: np.ndarray):
        self.mean, self.scale = x.mean(0), np.maximum(x.std(0), 1e-6)
        z = np.c_[(x - self.mean) / self.scale, np.ones(len(x))]
        self.w = np.zeros(z.shape[1])
        self.w[-1] = math.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5))
        ridge = np.r_[np.full(z.shape[1] - 1, 0.5), 1e-6]
        loss = lambda w: np.logaddexp(0, z @ w).sum() - y @ (z @ w) + 0.5 * (ridge * w * w)[:-1].sum()
        now = loss(self.w)
        for _ in range(80):
            p = _probability(np.clip(z @ self.w, -30, 30))
            step = np.linalg.solve(z.T @ (z * (p * (1 - p) + 1e-9)[:, None]) + np.diag(ridge), z.T @ (p - y) + ridge * np.r_[self.w[:-1], 0.0])
            # A step that overshoots is halved until the loss falls.
            while np.abs(step).max() >= 1e-8 and (after := loss(self.w - step)) > now:
                step = step / 2
            if np.abs(step).max() < 1e-8:
                break
            self.w, now = self.w - step, after

    def odds(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale @ self.w[:-1] + self.w[-1], -30, 30)


class View:
    """Counts of documents by feature and class, and the weights that follow from them."""

    def __init__(self, of: "View | None" = None):
        self.has = of.has.copy() if of else np.zeros((2, BINS))
        self.docs = of.docs.copy() if of else np.zeros(2)

    def learn(self, rows: list[np.ndarray], bad: np.ndarray) -> "View":
        for c in (0, 1):
            own = [r for r, b in zip(rows, bad) if b == c]
            self.docs[c] += len(own)
            if own:
                self.has[c] += np.bincount(np.concatenate(own), minlength=BINS)
        return self

    def tested(self) -> np.ndarray:
        return self.has.sum(0) >= LEAST_DOCS

    def weights(self) -> np.ndarray:
        """Log odds of each feature; 0 where chance among as many features could have made its share."""
        good, bad = self.docs
        if not good or not bad:
            return np.zeros(BINS)
        both, share, tested = self.has.sum(0), bad / (good + bad), self.tested()
        least = math.sqrt(2 * math.log(max(2, tested.sum())))
        z = (self.has[1] - both * share) / np.sqrt(np.maximum(both, 1) * share * (1 - share))
        w = np.log((self.has[1] + 0.5) / (bad + 1)) - np.log((self.has[0] + 0.5) / (good + 1))
        return np.where(tested & (np.abs(z) >= least), w, 0.0)


class Model:
    """What scoring needs: each view's weights and calibration, and the stacked combination. None of it grows with the corpus."""

    def __init__(self, weights: list[np.ndarray], calibrations: list[Logistic], joint: Logistic, share: float):
        self.history: list[dict[str, float]] = []
        self.weights, self.calibrations, self.joint, self.share = [w.astype(np.float32) for w in weights], calibrations, joint, share

    def views(self, rows: tuple[list[np.ndarray], list[np.ndarray]]) -> list[np.ndarray]:
        return [c.odds(summary(r, w)) for r, w, c in zip(rows, self.weights, self.calibrations)]

    def bad(self, rows: tuple[list[np.ndarray], list[np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(P by content, P by metadata, P) of being bad."""
        a, b = self.views(rows)
        return _probability(a), _probability(b), _probability(self.joint.odds(_both(a, b)))


def _both(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.c_[a, b, np.maximum(a, b)]


def labelled(labels: DataFrame, bound: int) -> DataFrame:
    """(id, bad): the labels that are learnt from."""
    bad = F.when((F.col("quality") == 0) | (F.col("toxic") == 1), 1).when(F.col("quality").isNotNull() | F.col("toxic").isNotNull(), 0)
    known = labels.select(F.col("doc_id").cast("long").alias("id"), bad.alias("bad")).where("id is not null and bad is not null")
    return known.groupBy("id").agg(F.max("bad").alias("bad")).orderBy(F.xxhash64("id"), "id").limit(bound)


def _frame(docs: DataFrame) -> DataFrame:
    """The columns that features are made of, nulls where a column is absent."""
    have = {c.lower() for c in docs.columns}
    pick = lambda c, t: (F.col(c) if c in have else F.lit(None)).cast(t).alias(c)
    return docs.select(F.col("doc_id").cast("long").alias("id"), common.text_of().alias("text"), pick("lang", "string"), pick("source", "string"), pick("n_chars", "long"))


def _lists(a: pa.Array) -> list[np.ndarray]:
    flat, edges = a.flatten().to_numpy(zero_copy_only=False).astype(np.int32), np.r_[0, np.cumsum(np.array(a.value_lengths().to_pylist(), np.int64))]
    return [flat[i:j] for i, j in zip(edges[:-1], edges[1:])]


def extract(docs: DataFrame) -> DataFrame:
    """(id, content, metadata): the features of each row."""

    def make():
        seen = Beginnings()

        def f(batch: pa.RecordBatch) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([common.column(batch, "id"), *(pa.array(x, pa.list_(pa.int32())) for x in features(batch, seen))], ["id", "content", "metadata"])

        return f

    return common.map_slices(_frame(docs), make, "id long, content array<int>, metadata array<int>")


def _pseudo(rows: DataFrame, model: Model) -> DataFrame:
    """(view, bin, good, bad): of the documents that the other view is sure of, how many have each feature; bin -1 counts the documents."""
    sent = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        model, n = sent.value, np.zeros((2, 2, BINS + 1), np.int64)
        for batch in batches:
            x = _lists(common.column(batch, "content")), _lists(common.column(batch, "metadata"))
            p = [_probability(o) for o in model.views(x)]
            for view, other in ((0, 1), (1, 0)):
                for c, sure in ((0, p[other] <= SURE_GOOD), (1, p[other] >= SURE_BAD)):
                    own = [r for r, s in zip(x[view], sure) if s]
                    if own:
                        n[view, c, 1:] += np.bincount(np.concatenate(own), minlength=BINS)
                        n[view, c, 0] += len(own)
        for view in (0, 1):
            bins = np.flatnonzero(n[view].any(0))
            if len(bins):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(bins), view, np.int32)), pa.array((bins - 1).astype(np.int32)), pa.array(n[view, 0, bins]), pa.array(n[view, 1, bins])], ["view", "bin", "good", "bad"])

    return rows.mapInArrow(run, "view int, bin int, good long, bad long").groupBy("view", "bin").agg(F.sum("good").alias("good"), F.sum("bad").alias("bad"))


def _weights(rows: list[np.ndarray], bad: np.ndarray, more: View) -> np.ndarray:
    """Weights by the labelled rows and, weighing less, the pseudo-labelled ones."""
    own = View().learn(rows, bad)
    for c in (0, 1):
        if more.docs[c]:
            share = PSEUDO_SHARE * min(1.0, own.docs[c] / more.docs[c])
            own.has[c] += share * more.has[c]
            own.docs[c] += share * more.docs[c]
    return own.weights()


def _fit(rows: tuple[list[np.ndarray], list[np.ndarray]], bad: np.ndarray, more: list[View]) -> Model:
    """Views learnt from all labelled rows and `more`; calibrations on halves that the scoring half did not learn from."""
    half = np.arange(len(bad)) % 2
    weights, calibrations, odds = [], [], []
    for x, extra in zip(rows, more):
        made = np.zeros((len(bad), 3))
        for h in (0, 1):
            part = _weights([r for r, k in zip(x, half) if k != h], bad[half != h], extra)
            made[half == h] = summary([r for r, k in zip(x, half) if k == h], part)
        weights.append(_weights(x, bad, extra))
        calibrations.append(Logistic(made, bad))
        odds.append(calibrations[-1].odds(made))
    joint = Logistic(_both(*odds), bad)
    model = Model(weights, calibrations, joint, float(bad.mean()))
    wrong = lambda o: float(((_probability(o) >= REJECT) != (bad == 1)).mean())
    model.history = [{"content": wrong(odds[0]), "metadata": wrong(odds[1]), "both": wrong(joint.odds(_both(*odds)))}]
    return model


class _Constant(Model):
    """Without labels of both classes."""

    def __init__(self, share: float):
        self.share, self.history = share, []

    def bad(self, rows):
        p = np.full(len(rows[0]), self.share)
        return p, p, p


def train(extracted: DataFrame, labels: DataFrame, rounds: int = ROUNDS, max_labelled: int = MAX_LABELLED) -> Model:
    """The co-trained model of a table of features."""
    chosen = labelled(labels, max_labelled)
    # One row for each of max_labelled ids at most.
    one = extracted.join(F.broadcast(chosen), "id").groupBy("id", "bad").agg(F.min(F.struct("content", "metadata")).alias("x"))
    known = one.select("id", "bad", "x.content", "x.metadata").orderBy("id").toArrow()
    bad = known.column("bad").to_numpy().astype(np.int64)
    if not len(bad) or bad.min() == bad.max():
        return _Constant(float(min(bad.mean(), REJECT / 2)) if len(bad) else 0.0)
    rows = tuple(_lists(known.column(c).combine_chunks()) for c in ("content", "metadata"))
    more = [View(), View()]
    model = _fit(rows, bad, more)
    unlabelled = extracted.join(F.broadcast(chosen.select("id")), "id", "left_anti")
    for _ in range(rounds):
        more = [View(), View()]
        for view, bin_, good, ill in _pseudo(unlabelled, model).toArrow().to_pandas()[["view", "bin", "good", "bad"]].itertuples(index=False):
            if bin_ < 0:
                more[view].docs += (good, ill)
            else:
                more[view].has[:, bin_] += (good, ill)
        made = _fit(rows, bad, more)
        if made.history[0]["both"] > model.history[-1]["both"]:
            break  # the next round would begin from the same model
        made.history = model.history + made.history
        model = made
    return model


def scores(docs: DataFrame, labels: DataFrame, rounds: int = ROUNDS, max_labelled: int = MAX_LABELLED) -> DataFrame:
    """(doc_id, p_content, p_metadata, p_bad, kept) of each row of docs."""
    scratch = common.Scratch(docs.sparkSession, "quality")
    extracted = scratch.keep(extract(docs))
    sent = docs.sparkSession.sparkContext.broadcast(train(extracted, labels, rounds, max_labelled))

    def run(batches):
        for batch in batches:
            a, b, p = sent.value.bad((_lists(common.column(batch, "content")), _lists(common.column(batch, "metadata"))))
            yield pa.RecordBatch.from_arrays([common.column(batch, "id"), pa.array(a), pa.array(b), pa.array(p), pa.array(p < REJECT)], ["doc_id", "p_content", "p_metadata", "p_bad", "kept"])

    return extracted.mapInArrow(run, "doc_id long, p_content double, p_metadata double, p_bad double, kept boolean")


def query(spark, sf_dir: str) -> DataFrame:
    return scores(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels"))


def good_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs that are not rejected, scored as they pass, so that texts are never shuffled."""
    scratch = common.Scratch(docs.sparkSession, "quality")
    extracted = scratch.keep(extract(docs))
    sent = docs.sparkSession.sparkContext.broadcast(train(extracted, labels))
    scratch.drop(extracted)

    # Places for names, which may be any.
    at = {c.lower(): i for i, c in enumerate(docs.columns)}
    plain = docs.toDF(*[f"_{i}" for i in range(len(docs.columns))])

    def make():
        seen, model = Beginnings(), sent.value

        def f(batch: pa.RecordBatch) -> pa.RecordBatch:
            none = pa.nulls(batch.num_rows)
            view = pa.RecordBatch.from_arrays([batch.column(at[c]) if c in at else none for c in ("text", "lang", "source", "n_chars")], ["text", "lang", "source", "n_chars"])
            return batch.filter(pa.array(model.bad(features(view, seen))[2] < REJECT))

        return f

    return common.map_slices(plain, make, plain.schema, column=f"_{at['text']}").toDF(*docs.columns)
