"""Centroid clustering, toxicity and conversation repair."""

import hashlib
import itertools
import random
import zlib
from functools import lru_cache

import duckdb
import numpy as np
import pytest

from cyclespan.llm import centroids, toxicity, turns

DATA = "/root/testdata/sf0.001"

# Centroid clustering


def brute_clusters(rows, k, rounds, dims, scale):
    """rows: (id, list of floats or None)."""
    kept = [(i, tuple(int(np.floor(scale * float(x))) for x in v)) for i, v in rows if v is not None and len(v) == dims and all(x is not None and np.isfinite(x) for x in v)]
    first = sorted((hashlib.sha256(f"1:{i}".encode()).hexdigest(), v) for i, v in kept if i is not None) + sorted(("", v) for i, v in kept if i is None)
    c = [v for _, v in first[:k]]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, x)), j) for j, x in enumerate(c))
    for _ in range(rounds):
        own = {}
        for _, v in kept:
            own.setdefault(near(v)[1], []).append(v)
        c = [tuple(sum(x) // len(own[j]) for x in zip(*own[j])) if j in own else x for j, x in enumerate(c)]
    found = [(i, *near(v)) for i, v in kept]
    inertia = {j: sum(d for _, d, n in found if n == j) for j in range(len(c))}
    fit = lambda x: x if x < 1 << 63 else None
    digest = lambda j: hashlib.sha256(",".join(map(str, c[j])).encode()).hexdigest()
    return sorted(((i, j, fit(d), fit(inertia[j]), fit(sum(inertia.values())), digest(j)) for i, d, j in found), key=repr)


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, "x", i) for i, v in rows], "vec_id long, embedding array<double>, id string, v long")


def random_rows(rng, n, dims, spread):
    return [(int(i), [float(x) for x in rng.normal(0, spread, dims)]) for i in range(n)]


@pytest.mark.parametrize("spread", [0.05, 2.0, 5e5, 1e14])
def test_clusters_like_brute_force(spark, spread):
    rng = np.random.default_rng(5)
    rows = random_rows(rng, 60, 6, spread)
    rows += [(7, rows[7][1]), (None, rows[3][1]), (90, None), (91, [1.0] * 5), (92, [1.0] * 5 + [None]), (93, [float("nan")] * 6), (94, [float("inf")] + [0.0] * 5), (95, [0.0] * 6), (95, [0.1] * 6)]
    got = centroids.cluster(vectors(spark, rows).repartition(5), k=5, rounds=3, dims=6, scale=64.0).collect()
    assert sorted((tuple(r) for r in got), key=repr) == brute_clusters(rows, 5, 3, 6, 64.0)


def test_ties_take_the_lowest_number(spark):
    rows = [(i, [float(x), 0.0]) for i, x in enumerate([0, 2, 1, 1, 1, 0, 2] * 4)]
    got = centroids.cluster(vectors(spark, rows), k=6, rounds=2, dims=2, scale=1.0).collect()
    assert sorted((tuple(r) for r in got), key=repr) == brute_clusters(rows, 6, 2, 2, 1.0)


def test_few_vectors_and_none(spark):
    rows = random_rows(np.random.default_rng(1), 3, 4, 1.0)
    got = centroids.cluster(vectors(spark, rows), k=16, rounds=3, dims=4).collect()
    assert sorted((tuple(r) for r in got), key=repr) == brute_clusters(rows, 16, 3, 4, 64.0)
    assert centroids.cluster(vectors(spark, []), dims=4).count() == 0
    assert centroids.cluster(vectors(spark, [(1, None)]), dims=4).columns == [c.split()[0] for c in centroids.SCHEMA.split(", ")]


def test_too_large_is_an_error(spark):
    with pytest.raises(Exception, match="too large"):
        centroids.cluster(vectors(spark, [(1, [1e300, 0.0])]), dims=2).collect()


@pytest.mark.parametrize("spread", [3, 200, 40_000, 10**8, 10**12])
def test_screening_never_loses_the_nearest(spread):
    rng = np.random.default_rng(spread)
    c = rng.integers(-spread, spread + 1, (12, 64))
    c[5] = c[2]  # ties
    c[7] = c[3] + (np.arange(64) == 0)
    x = np.concatenate([rng.integers(-spread, spread + 1, (200, 64)), c, (c[2] + c[9]) // 2 + rng.integers(0, 2, (50, 64)), c[3][None] + rng.integers(-1, 2, (50, 64))])
    model = centroids.Centroids([tuple(map(int, r)) for r in c], 64)
    number, distance, several = model.nearest(x)
    exact = [[sum((int(a) - int(b)) ** 2 for a, b in zip(v, w)) for w in c] for v in x]
    assert [(int(d), int(n)) for d, n in zip(distance, number)] == [min((d, j) for j, d in enumerate(row)) for row in exact]
    assert 0 < several < len(x)  # most rows need one product alone


def test_query_like_sql(spark):
    got = centroids.query(spark, DATA)
    con = duckdb.connect()
    con.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{DATA}/embeddings.parquet'")
    want = con.sql(centroids.ORACLE)
    assert sorted(tuple(r) for r in got.select(*want.columns).collect()) == sorted(want.fetchall())


# Toxicity

WORDS = "the idiot said that stupid clown was a pathetic loser and the moron did not see his own good little hill in the sun"


def model_of(text):
    return toxicity.language_model(toxicity.trigram_counts([text] * 200))


def test_language_model_adds_up_to_one():
    p = np.exp(model_of(WORDS + " é 12 ж ss$"))
    assert np.allclose(p.sum(2), 1)


@pytest.mark.parametrize("bad,good", [
    ("1d10t", "idiot"), ("l0s3r", "loser"), ("p4th3t1c", "pathetic"), ("$tupid", "stupid"), ("cl0wn", "clown"), ("m0r0n", "moron"),
    ("iiiidiot", "idiot"), ("looooser", "loser"), ("stuuuupid", "stupid"), ("i d i o t", "idiot"), ("l.o.s.e.r", "loser"), ("m-o-r-o-n", "moron"), ("m 0 r 0 n", "moron"), ("s_t_u_p_i_d", "stupid"),
])
def test_disguises_are_undone(bad, good):
    r = toxicity.Restorer(model_of(WORDS))
    assert r.restore(f"He is, {bad} and so.")[0] == f"He is, {good} and so."


@pytest.mark.parametrize("text", ["", "the good little hill", "Hill!! sun?! UNE!! 1995, 12:30 3.14", "a b", "x" * 2, "été über ñandú", "日本語 text", "a1b2c3d4e5f6" * 3])
def test_other_text_stays(text):
    assert toxicity.Restorer(model_of(WORDS)).restore(text)[0] == text or any(c.isdigit() for c in text)
    if not any(c.isdigit() for c in text):
        assert toxicity.Restorer(model_of(WORDS)).restore(text) == (text, 0)


@pytest.mark.parametrize("window", [1, 3, 1024])
def test_viterbi_like_all_paths(window, monkeypatch):
    monkeypatch.setattr(toxicity.Restorer, "WINDOW", window)
    rng, r = random.Random(3), toxicity.Restorer(model_of(WORDS))
    for _ in range(150):
        span = "".join(rng.choice("1d10tl0s3r$$aaa!o") for _ in range(rng.randint(1, 8)))
        nodes = list(toxicity.lattice(span))

        def value(path):
            state, total = 0, 0.0
            for text, cost in path:
                p, state = r._emit(state, text)
                total += p - cost
            return total + r.lp[state * toxicity.SIZE]

        best = max(value(p) for p in itertools.product(*nodes))
        out = r.decode(span)
        assert any("".join(t for t, _ in p) == out and value(p) == pytest.approx(best) for p in itertools.product(*nodes))


def test_long_words_take_linear_time():
    r = toxicity.Restorer(model_of(WORDS))
    assert r.decode("o" * 2_000_000) in ("o", "oo")
    rng = random.Random(1)
    word = "".join(rng.choice("abcdeo013$") for _ in range(100_000))
    assert len(r.restore(word)[0]) <= len(word)
    assert toxicity.spans("a" * 1_000_000 + "b" * 10 + " x") == [(0, 1_000_010)]


def corpus(spark, disguise=lambda w: w):
    rng = random.Random(8)
    syllables = ["ka", "lo", "mi", "ren", "tas", "vol", "du", "per", "sin", "ga"]
    word = lambda: "".join(rng.choice(syllables) for _ in range(rng.randint(1, 4)))
    docs, labels = [], []
    for i in range(900):
        words = [word() for _ in range(rng.randint(5, 60))]
        toxic = i % 6 == 0
        if toxic:
            for w in rng.sample(["idiot", "moron", "stupid"], 2):
                words.insert(rng.randrange(len(words)), disguise(w) if zlib.crc32(str(i).encode()) % 5 == 0 else w)
        docs.append((i, " ".join(words), "en", "s"))
        labels.append((i, 1, int(toxic)))
    docs += [(900, None, None, None), (901, "", "en", "s"), (None, "an idiot", "en", "s"), (0, "repeated idiot", "en", "s")]
    labels += [(901, 1, None), (None, 0, 1)]
    d = spark.createDataFrame([(*r, "z", 0.5) for r in docs], "doc_id long, text string, lang string, source string, toxic string, score double")
    return d, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


@pytest.mark.parametrize("disguise", [lambda w: w, lambda w: w.replace("i", "1").replace("o", "0"), lambda w: ".".join(w), lambda w: w[0] * 4 + w[1:]])
def test_held_out_accuracy_with_disguises(spark, disguise):
    docs, labels = corpus(spark, disguise)
    rows = toxicity.score(docs, toxicity.train(docs, labels)).collect()
    assert len(rows) == docs.count()
    held = [r for r in rows if r.held_out and r.doc_id < 900]
    assert {r.doc_id for r in held} == {i for i in range(900) if zlib.crc32(str(i).encode()) % 5 == 0}
    right = [r.predicted == int(r.doc_id % 6 == 0) for r in held]
    assert sum(right) >= 0.97 * len(right)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in rows)
    assert not [r for r in rows if r.doc_id is None and r.held_out]


def test_labels_of_one_class_and_empty_tables(spark):
    docs, labels = corpus(spark)
    assert {r.score for r in toxicity.score(docs, toxicity.train(docs, labels.where("toxic = 1"))).collect()} == {1.0}
    assert {r.score for r in toxicity.score(docs, toxicity.train(docs, labels.where("false"))).collect()} == {0.0}
    assert toxicity.score(docs.where("false"), toxicity.train(docs.where("false"), labels)).count() == 0


def test_labels_and_other_columns_are_no_inputs(spark):
    docs, labels = corpus(spark)
    model = toxicity.train(docs, labels)
    a = {(r.doc_id, r.score) for r in toxicity.score(docs, model).collect()}
    b = {(r.doc_id, r.score) for r in toxicity.score(docs.drop("lang", "source", "toxic", "score"), model).collect()}
    assert a == b


# Conversation repair


def brute_repair(rows):
    """The digest of one conversation's rows (turn, role, text), by a search over whole edit strings."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
    seen, faults = set(), []
    white = " \t\n\v\f\r"
    for _, role, text in rows:
        kept = text.strip(white)
        faults.append("blank" if not kept else "duplicate" if (role, text) in seen else "truncated" if kept[-1] not in ".!?" else "")
        seen.add((role, text))
    following = {"": {"s": "S", "u": "U"}, "S": {"u": "U"}, "U": {"a": "A"}, "A": {"u": "U"}}
    name = {"u": "user", "a": "assistant"}

    @lru_cache(None)
    def best(i, q, inserted):
        """(cost, letters, turns)"""
        found = []
        if i == len(rows) and q in ("", "A"):
            found.append((0, "", ()))
        if inserted < 4:
            for c in "ua":
                if c in following[q]:
                    cost, letters, out = best(i, following[q][c], inserted + 1)
                    found.append((cost + 2, "I" + letters, ((name[c], ""), *out)))
        if i < len(rows):
            _, role, text = rows[i]
            cost, letters, out = best(i + 1, q, 0)
            found.append((cost + 3, "D" + letters, out))
            if faults[i] not in ("blank", "duplicate"):
                more = int(faults[i] == "truncated")
                if role[:1] and role[:1] in following[q]:
                    cost, letters, out = best(i + 1, following[q][role[:1]], 0)
                    found.append((cost + more, "K" + letters, ((role, text), *out)))
                for c in "ua":
                    if c in following[q]:
                        cost, letters, out = best(i + 1, following[q][c], 0)
                        found.append((cost + 2 + more, "R" + letters, ((name[c], text), *out)))
        return min(found, key=lambda f: f[:2], default=(10**9, "", ()))

    cost, letters, out = best(0, "", 0)
    known = [t for t, *_ in rows if t is not None]
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
    return (gaps, faults.count("blank"), faults.count("duplicate"), faults.count("truncated"), illegal, cost, letters, hashlib.sha256("\n".join(f"{r}:{t}" for r, t in out).encode()).hexdigest())


def damage(rows):
    out = {}
    for conv, turn, role, text in rows:
        own = out.setdefault(conv, [])
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if kind == 1:
            text = ""
        elif kind == 2:
            text = text.translate(str.maketrans("", "", ".!?"))
        elif kind == 4:
            role = "user"
        own += [(turn, role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    return out


def conversation_rows(n, seed):
    rng = random.Random(seed)
    roles = ["system", "user", "assistant", "user", "assistant", "tool", "", "User", None]
    texts = ["Yes.", "No!", "so what?", "cut off", "", " \t", None, "Long. " * 5, "ß…", "x.\n", "Yes."]
    return [(rng.choice([None, *range(n)]), rng.choice([None, *range(6)]), rng.choice(roles), rng.choice(texts)) for _ in range(5 * n)]


def conversations(spark, rows):
    return spark.createDataFrame([(*r, "x", 0) for r in rows], "conv_id long, turn long, role string, text string, place string, fault int")


@pytest.mark.parametrize("seed", range(3))
def test_repair_like_brute_force(spark, seed):
    rows = conversation_rows(60, seed)
    # Conversations of some length, and one whose rows are all dropped.
    rng = random.Random(seed)
    rows += [(1000 + c, t, rng.choice(["user", "assistant"]), rng.choice(["Yes.", "Well.", "cut", "Go on!"]) + str(t) * (t % 3) + ".") for c in range(5) for t in range(40)]
    gone = next(t for t in range(10**4) if zlib.crc32(f"5000:{t}".encode()) % 20 == 0)
    rows.append((5000, gone, "user", "Hello."))
    want = {(c, *brute_repair(own)) for c, own in damage(rows).items()}
    got = turns.digests(turns.repaired_turns(turns.damaged(conversations(spark, rows)))).collect()
    assert len(got) == len(want)
    assert {tuple(r) for r in got} == want
    assert (5000, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest()) in want


def test_repair_without_damage(spark):
    rows = [(c, t, "user" if r is None else r, "." if x is None else x) for c, t, r, x in conversation_rows(40, 9)]
    own = {}
    for c, *r in rows:
        own.setdefault(c, []).append(tuple(r))
    assert {tuple(r) for r in turns.repair(conversations(spark, rows)).collect()} == {(c, *brute_repair(v)) for c, v in own.items()}


def test_repaired_turns_are_legal_and_keep_their_order(spark):
    rows = [(1, t, r, x) for t, (r, x) in enumerate([("assistant", "Late."), ("user", "One."), ("user", "Two."), ("assistant", "A."), ("assistant", " "), ("user", "Last")])]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    out = turns.repaired_turns(frame).collect()
    kept = [(r.role, r.text) for r in out if r.edit != "D"]
    assert "".join(r[0] for r, _ in kept) == "ua" * (len(kept) // 2)
    assert "".join(r.edit for r in out) == brute_repair([r[1:] for r in rows])[6]


def test_a_long_conversation_and_a_long_text(spark):
    rows = [(1, t, "user" if t % 2 == 0 else "assistant", f"Turn {t}.") for t in range(3000)] + [(2, 0, "user", "x" * 3_000_000 + "."), (2, 1, "assistant", "y.")]
    got = {r.conv_id: r for r in turns.repair(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert got[1].audit == "K" * 3000 and got[1].cost == 0 and got[1].illegal == 0
    assert got[2].repaired_sha256 == hashlib.sha256(("user:" + "x" * 3_000_000 + ".\nassistant:y.").encode()).hexdigest()


def test_no_conversations(spark):
    assert turns.repair(conversations(spark, [])).count() == 0
