"""LM scores against exact counts in dictionaries, and the filter and its packing alone."""

import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from cyclespan.llm import lm_score as lm


def frame(spark, rows):
    """Rows (doc_id, text), with further columns whose names the operator uses inside."""
    return spark.createDataFrame([(i, t, "k", 1, 2, "s") for i, t in rows], "doc_id long, text string, id string, block long, n long, held string")


def words(rng, n):
    return " ".join("".join(rng.choice("abcd") for _ in range(rng.randrange(1, 4))) for _ in range(n))


def brute(rows, order):
    """By row: (doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score), counts quantised as stated but exact."""
    texts = [(i, ["<s>"] * (order - 1) + (t or "").lower().split(" ") * bool(t) + ["</s>"], zlib.crc32(("" if i is None else str(i)).encode()) % 5 == 1) for i, t in rows]
    counts = [Counter() for _ in range(order + 1)]
    for _, ts, held in texts:
        if not held:
            for k in range(1, order + 1):
                counts[k].update(tuple(ts[j - k + 1 : j + 1]) for j in range(order - 1, len(ts)))
    n, v = sum(counts[1].values()), len(counts[1])
    whole = n + 0.5 * (v + 1)

    def value(c):
        if not c:
            return 0.0
        least = 1
        while (after := max(least + 1, math.ceil(1.25 * least))) <= c:
            least = after
        return math.sqrt(least * (after - 1))

    start = value(counts[1][("</s>",)])
    out = []
    for i, ts, held in texts:
        base = score = known = 0
        for j in range(order - 1, len(ts)):
            c = counts[1][(ts[j],)]
            known += c > 0
            base += math.log10((c + 0.5) / whole)
            p = (value(c) + 0.5) / whole
            for k in range(2, order + 1):
                gram = tuple(ts[j - k + 1 : j + 1])
                both, context = value(counts[k][gram]), start if j == order - 1 else value(counts[k - 1][gram[:-1]])
                p = (both + lm.MU * p) / (max(both, context) + lm.MU)
            score += math.log10(min(1.0, p))
        out.append((str(i), held, len(ts) - order + 1, known, n, round(base, 6), round(score, 6)))
    return sorted(out)


def result(df):
    return sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6), round(r.score, 6)) for r in df.collect())


@pytest.mark.parametrize("order,block,per_range", [(3, 1 << 20, 700_000), (3, 50, 40), (2, 200, 100), (1, 64, 30)])
def test_scores_like_brute_force(spark, order, block, per_range):
    # Sizes of blocks and ranges change nothing; with many bits an entry there are no false positives.
    rng = random.Random(1)
    rows = [(i, words(rng, rng.randrange(1, 30))) for i in range(80)] + [(3, "twice a"), (3, "twice a"), (None, None), (200, ""), (201, words(rng, 3000)), (202, words(rng, 9))]
    rows += [(300 + i, rows[i][1]) for i in range(10)]
    got = result(lm.scores(frame(spark, rows), order=order, block_tokens=block, range_tokens=per_range, bits_per_entry=96))
    assert got == brute(rows, order)


def test_false_positives_change_scores_little(spark):
    rng = random.Random(2)
    rows = [(i, words(rng, 200)) for i in range(60)]
    exact, got = brute(rows, 3), result(lm.scores(frame(spark, rows)))
    assert [r[:6] for r in got] == [r[:6] for r in exact]
    # Ten bits an entry: about one absent n-gram in a hundred seems to be there.
    assert max(abs(a[6] - b[6]) / abs(b[6]) for a, b in zip(got, exact)) < 0.03


def test_part_never_underestimates():
    rng = np.random.default_rng(1)
    keys, other = rng.integers(0, 2**63, 3000).astype(np.uint64), rng.integers(0, 2**63, 3000).astype(np.uint64)
    level = lm.level_of(rng.integers(1, 5000, 3000))
    part = lm.Part(keys, level)
    got = part.levels(keys)
    assert (got >= level).all() and (got == level).mean() > 0.97
    assert (part.levels(other) > 0).mean() < 0.02
    assert (lm.Part(keys[:0], level[:0]).levels(other) == 0).all()


def test_levels_ascend():
    c = np.arange(1, 3000, dtype=np.uint64)
    level = lm.level_of(c).astype(int)
    assert level[:5].tolist() == [1, 2, 3, 4, 5] and (np.diff(level) >= 0).all() and lm.level_of(np.array([0, 1 << 61])).tolist()[0] == 0
    assert (np.abs(np.log(lm.VALUES[level] / c)) < 0.25).all()


def test_packing_round_trips():
    rng = np.random.default_rng(3)
    for top, n in ((1 << 48, 1000), (5000, 900), (1 << 48, 0), (1 << 48, 1)):
        q = np.unique(rng.integers(0, top, n).astype(np.uint64))
        assert (lm.unpack_sorted(lm.pack_sorted(q)) == q).all()
    for top, n in ((2, 50), (300, 50), (70_000, 50), (1 << 40, 50), (9, 0)):
        c = rng.integers(0, top, n).astype(np.uint64)
        assert (lm.unpack(lm.pack(c)) == c).all()


def test_copies_score_above_single_texts(spark):
    # A text that occurs twice is likelier, a token, under a model of the whole corpus.
    rng = random.Random(4)
    once = [" ".join("".join(rng.choice("abcdefghij") for _ in range(5)) for _ in range(60)) for _ in range(60)]
    rows = [(5 * i, t) for i, t in enumerate(once)] + [(1000 + 5 * i, t) for i, t in enumerate(once[:20])]
    got = {r.doc_id: r.score / r.n_tokens for r in lm.scores(frame(spark, [r for r in rows if zlib.crc32(str(r[0]).encode()) % 5 != 1])).collect()}
    twice = {d for d, t in rows if d in got and sum(t == u and e in got for e, u in rows) == 2}
    assert min(got[d] for d in twice) > max(s for d, s in got.items() if d not in twice)


def test_empty_and_unlearnt(spark):
    assert lm.scores(frame(spark, [])).count() == 0
    held = [i for i in range(50) if zlib.crc32(str(i).encode()) % 5 == 1]
    rows = [(i, "a b") for i in held]
    assert result(lm.scores(frame(spark, rows))) == brute(rows, 3)


def test_probabilities_add_up_to_about_one():
    # The formulas over exact counts put into levels, as the filter gives them back: the vocabulary and one unknown word, after every kind of context.
    rng, size = np.random.default_rng(1), 60
    p = 1 / np.arange(1, size + 1)
    docs = [[*rng.choice(size, rng.integers(5, 60), p=p / p.sum()).tolist(), size] for _ in range(400)]
    start, counts = -1, [{}, {}, {}]
    for d in docs:
        for i, w in enumerate(d):
            u, t = (d[i - 1] if i else start), (d[i - 2] if i > 1 else start)
            for n, key in enumerate([(w,), (u, w), (t, u, w)][: 3 if i else 2]):
                counts[n][key] = counts[n].get(key, 0) + 1
    value = lambda *key: float(lm.VALUES[lm.level_of(np.array([c]))[0]]) if (c := counts[len(key) - 1].get(key, 0)) else 0.0
    whole = sum(counts[0].values()) + 0.5 * (len(counts[0]) + 1)
    one = lambda w: (value(w) + 0.5) / whole
    context = lambda u: value(size) if u == start else value(u)
    two = lambda u, w: (value(u, w) + lm.MU * one(w)) / (max(context(u), value(u, w)) + lm.MU)
    three = lambda t, u, w: (value(t, u, w) + lm.MU * two(u, w)) / (max(value(t, u), value(t, u, w)) + lm.MU)
    words = [*range(size + 1), size + 1]
    sums = [sum(two(u, w) for w in words) for u in [start, *range(size)]] + [sum(three(t, u, w) for w in words) for t in range(0, size, 3) for u in range(0, size, 3)] + [sum(map(one, words))]
    assert 0.85 < min(sums) and max(sums) < 1.2 and abs(np.mean(sums) - 1) < 0.02
