import random

import pytest
from pyspark.sql import functions as F

from cyclespan.llm import line_dedup as ld


def distance(a, b):
    row = list(range(len(a) + 1))
    for j, y in enumerate(b, 1):
        before, row[0] = row[0], j
        for i, x in enumerate(a, 1):
            before, row[i] = row[i], min(row[i] + 1, row[i - 1] + 1, before + (x != y))
    return row[-1]


def edited(s, rng):
    p = rng.randrange(len(s))
    return rng.choice([s[:p] + "zé"[rng.randrange(2)] + s[p:], s[:p] + s[p + 1 :], s[:p] + "q" + s[p + 1 :]])


def brute(rows):
    """(id, line_no) -> (class place, links, kept)."""
    places = [(i, n, x) for i, t in rows for n, x in enumerate((t or "").split("\n"))]
    texts = sorted({x for *_, x in places if x})
    near = {a: {b for b in texts if a != b and min(len(a), len(b)) >= ld.MIN_CHARS and abs(len(a) - len(b)) <= 1 and distance(a, b) <= 1} for a in texts}
    root = {}
    for t in texts:
        if t not in root:
            todo = [t]
            while todo:
                x = todo.pop()
                if x not in root:
                    root[x] = t
                    todo += near[x]
    first = {}
    for i, n, x in sorted(places, key=lambda p: p[:2]):
        if x in root:
            first.setdefault(root[x], (i, n))
    return {(i, n): (first[root[x]], len(near[x]), first[root[x]] == (i, n)) if x in root else (None, 0, True) for i, n, x in places}


def check(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r.id, r.line_no): ((r.class_id, r.class_line) if r.class_id is not None else None, r.n_links, r.kept) for r in ld.line_classes(df).collect()}
    assert got == brute(rows)


@pytest.mark.parametrize("tau", [1, 2, 3])
def test_banded_distance(spark, tau):
    rng, rows = random.Random(tau), []
    for _ in range(1500):
        a = "".join(rng.choice("ab") for _ in range(rng.randrange(14)))
        b = a
        for _ in range(rng.randrange(5)):
            p = rng.randrange(len(b) + 1)
            b = rng.choice([b[:p] + rng.choice("ab") + b[p:], b[:p] + b[p + 1 :], b[:p] + rng.choice("ab") + b[p + 1 :]])
        a, b = sorted((a, b), key=len)
        if len(b) - len(a) <= tau:
            rows.append((a, b, distance(a, b)))
    df = spark.createDataFrame(rows, "a string, b string, d int")
    chars = lambda c: F.filter(F.split(c, ""), lambda x: x != "")
    df = df.withColumn("_a", chars("a")).withColumn("_b", chars("b")).withColumn("got", ld.banded_distance(F.col("a"), F.col("b"), tau))
    assert df.where(f"(d <= {tau} and got != d) or (d > {tau} and got <= {tau})").count() == 0


def test_like_brute_force(spark):
    rng = random.Random(5)
    base = ["".join(rng.choice("abcde fgh") for _ in range(rng.randrange(18, 60))) for _ in range(40)]
    lines = base + [edited(b, rng) for b in base for _ in range(2)] + [edited(edited(b, rng), rng) for b in base]
    rows = [(i, "\n".join(rng.choice(lines) for _ in range(rng.randrange(1, 6)))) for i in range(60)]
    check(spark, rows)


def test_large_group_is_split_not_paired(spark):
    # Far more lines with a segment in common than SMALL_GROUP: links are found all the same.
    rng = random.Random(6)
    base = "the quick brown fox jumps over the lazy dog while it rains all day long"
    rows = [(0, base)] + [(i, edited(base, rng)) for i in range(1, 4 * ld.SMALL_GROUP)]
    check(spark, rows)


@pytest.mark.parametrize("at", [0, 30, 40])
def test_lines_that_differ_in_one_sign(spark, at):
    # Each is linked to each, which is counted and not written out; longer ones by one sign are linked too.
    rng = random.Random(at)
    base = "one template line with a number in the m"
    signs = [chr(0x4E00 + i) for i in range(90)]
    lines = [base[:at] + c + base[at:] for c in signs] + [base] + [base[:at] + rng.choice(signs) + rng.choice(signs) + base[at:] for _ in range(40)] + [base[:at] + signs[0] + base[at:-1] + "Q"]
    rows = [(i, x) for i, x in enumerate(lines)]
    check(spark, rows)
    scratch = ld.common.Scratch(spark, "test")
    pairs, counts = ld.links(ld.lines(spark.createDataFrame(rows, "doc_id long, text string")), scratch)
    assert pairs.count() < 6 * len(lines) and counts.agg(F.sum("n_links")).first()[0] > 90 * 89


def test_short_lines_are_classed_with_equal_ones(spark):
    check(spark, [(1, "All rights reserved\nown"), (2, "x\nAll rights reserved\n"), (3, "All rights reserve\n\n"), (4, "x")])


def test_odd_rows(spark):
    check(spark, [(1, None), (2, ""), (3, "\n\n"), (4, "x" * 3000), (5, "x" * 3001), (6, "short"), (7, "short")])
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert ld.line_classes(empty).count() == 0


def test_stage_keeps_rows_and_columns(spark):
    a, b = "a line that stands in several documents", "a line that stands in several document"
    rows = [(1, f"{a}\nown words of the first", 9, "k1", 1), (2, f"x\n{b}\ny", 9, "k2", 2), (2, f"x\n{b}\ny", 9, "k2", 2), (3, None, None, None, 3), (None, a, 5, "k", 4)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_chars int, th string, gone int").withColumn("a.dotted `name`", F.lit(1))
    out = ld.without_repeated_lines(df)
    assert out.columns == df.columns and out.dtypes == df.dtypes
    got = sorted((r.doc_id is not None, r.doc_id or 0, r.text, r.n_chars, r.th, r.gone) for r in out.collect())
    # The row without an id comes first in the order, so its line is the one that stays.
    assert got == [(False, 0, a, 5, "k", 4), (True, 1, "own words of the first", 22, "k1", 1), (True, 2, "x\ny", 3, "k2", 2), (True, 2, "x\ny", 3, "k2", 2), (True, 3, None, None, None, 3)]
    assert {r.doc_id: r.text for r in out.collect()} == {None: a, 1: "own words of the first", 2: "x\ny", 3: None}


def test_few_links_take_no_rounds_and_no_pairs_no_comparison(spark, monkeypatch):
    """The driver's memory grows with the plans that it makes."""
    from cyclespan.llm import simhash, similar
    from cyclespan.operators import components

    base = " ".join(f"w{i}" for i in range(60))
    docs = spark.createDataFrame([(1, base), (2, base + " x"), (3, "other text of its own"), (4, base)], "doc_id long, text string")
    found = lambda out: sorted((r.id, r.component_id) for r in out.collect())
    for module in (simhash, similar):
        with monkeypatch.context() as m:
            m.setattr(module, "LOCAL_EDGES", 0)
            by_rounds = found(module.near_duplicates(docs))
        with monkeypatch.context() as m:
            m.setattr(components, "_large_star", lambda edges: pytest.fail("a round for a few links"))
            assert found(module.near_duplicates(docs)) == by_rounds
    with monkeypatch.context() as m:
        m.setattr(ld, "banded_distance", lambda *a: pytest.fail("a comparison without pairs"))
        assert ld.line_classes(docs).where("kept").count() == 3
