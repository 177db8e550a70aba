"""Line dedup by a segment-partition edit join (Pass-Join, Li et al. 2011), with DataFrame functions only.

All lines (parted at \\n) that are not empty take part: equal lines are one node. Those of MIN_CHARS code points or more are also joined at an edit distance
of THRESHOLD = 1; an edit more or less is no likeness in shorter ones. A line of length l is split
into THRESHOLD + 1 = 2 segments. One edit leaves a segment whole, and then the shared one is aligned with a line's
begin or end, so the index of length l is probed by lines of length l and l + 1 with exactly one substring for each segment.

1. All lines' index and probe keys (hashes of length, segment number and substring) are aggregated by key; those that different lines
   share set a bit in a bitmap of fixed size (BITMAP_WORDS), which is broadcast.
2. Only rows whose key's bit is set are shuffled with what is left of the line beside the segment.
3. What is left of a key's lines is split into two segments again, and so on; each round halves the rest, so groups fall apart by where
   the lines differ. A key of up to SMALL_GROUP lines with a short rest gives its pairs; a larger one is never paired.
4. Pairs are verified on their rests by a banded bit-parallel edit distance (Hyyro 2003), a fold over the characters.
5. A larger group whose rest is one code point or none holds lines that differ in one sign at one place. Those of the same length are all linked: they are counted, and
   each is linked to the least. A longer one is linked to those whose sign it holds there, at most two, by an equi-join. Two lines of
   the same length meet in one group only, so the counts add up.
6. Links give classes by connected components. The first line of a class (by doc_id, the
   text's hash, line number) is kept.

Defined cases: a null text is empty; empty lines are always kept and have no class; shorter lines than MIN_CHARS are classed with equal ones; of repeated rows (same id and
text) lines of the same place count as one place, so all copies of it are kept or none is; a null id comes first in the
order; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.components import connected_components
from . import common

THRESHOLD = 1
#: Code points from which a line is joined at the threshold; shorter ones are joined if they are equal.
MIN_CHARS = 20
#: Lines of a key that are paired at once; larger groups are split further.
SMALL_GROUP = 24
#: Longest rest, on the index's side, that is compared before SPLIT_ROUNDS rounds of splitting: most candidates fall apart sooner and cheaper.
SHORT_REST, SPLIT_ROUNDS = 16, 6
#: 64-bit words of the bitmap of shared keys: 2^20 words are 16 MB, broadcast, at any input size.
BITMAP_WORDS = 1 << 20


def lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, th, line_no, line): th tells texts of a repeated id apart."""
    text = common.text_of(text_col)
    base = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text).alias("th"), text.alias("text"))
    return base.select("id", "th", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))


def _halves(rest: Column, m: Column) -> list[tuple[Column, Column, Column]]:
    """(substring that must be equal, rest beside it, its length on the index's side) for both segments of m code points."""
    first = F.floor(m / 2).cast("int")
    n = F.length(rest)
    return [
        (F.substring(rest, F.lit(1), first), F.substring(rest, first + 1, n), (m - first)),
        (F.substring(rest, n - (m - first) + 1, m), F.substring(rest, F.lit(1), n - (m - first)), first),
    ]


def _entries(prefix: Column, rest: Column, m: Column, delta: Column) -> Column:
    return F.array(
        *[
            F.struct(F.xxhash64(prefix, F.lit(i), part).alias("key"), delta.alias("delta"), left.cast("int").alias("m"), other.alias("rest"))
            for i, (part, other, left) in enumerate(_halves(rest, m))
        ]
    )


def _sized(occurrences: DataFrame) -> DataFrame:
    """(line, n, f0, f1): lines that the edit join takes, with their length and that of the first segment in their own index and in the next shorter length's."""
    long = occurrences.select("line", F.length("line").alias("n")).where(F.col("n") >= MIN_CHARS)
    return long.withColumns({"f0": F.floor(F.col("n") / 2).cast("int"), "f1": F.floor((F.col("n") - 1) / 2).cast("int")})


def _keys(with_rest: bool) -> Column:
    """The keys of a row of _sized: those of its own length's index (delta 0), and its probes of the next shorter one's (delta 1)."""
    line, n, f0, f1 = (F.col(c) for c in ("line", "n", "f0", "f1"))
    first, end = F.lit(1), n
    parts = [  # length in the index, delta, segment, its text, the rest beside it, the rest's length in the index
        (n, 0, 0, F.substring(line, first, f0), F.substring(line, f0 + 1, end), n - f0), (n, 0, 1, F.substring(line, f0 + 1, end), F.substring(line, first, f0), f0),
        (n - 1, 1, 0, F.substring(line, first, f1), F.substring(line, f1 + 1, end), n - 1 - f1), (n - 1, 1, 1, F.substring(line, f1 + 2, end), F.substring(line, first, f1 + 1), f1),
    ]
    made = []
    for length, delta, i, text, rest, m in parts:
        more = [m.cast("int").alias("m"), rest.alias("rest")] if with_rest else []
        made.append(F.struct(F.xxhash64(length, F.lit(i), text).alias("key"), F.lit(delta).alias("delta"), *more))
    return F.array(*made)


def banded_distance(a: Column, b: Column, tau: int) -> Column:
    """Edit distance of a and b if it is at most tau, else more than tau; length(a) <= length(b) <= length(a) + tau is required.

    Row i of the matrix, at b's character i, is kept for the columns i - tau to i + tau only, as bits of one word: vp and vn hold where
    the value grows or falls by one from column to column of a. dist follows the band's lower end until the last
    column of a, and then that column.
    """
    w = 2 * tau + 2
    full, top = (1 << w) - 1, 1 << (w - 1)
    m, n = F.size("_a"), F.size("_b")

    def step(s: Column, i: Column) -> Column:
        ch = F.get(F.col("_b"), i)
        match = None
        for bit in range(w):
            q = i + (tau + 1 - w + bit)
            same = F.when((q >= 0) & (F.get(F.col("_a"), F.greatest(q, F.lit(0))) == ch), 1 << bit).otherwise(0)
            match = same if match is None else match + same
        vp, vn = s["vp"], s["vn"]
        # One step of the carry-free recurrence; names follow the paper.
        d0 = ((((match.bitwiseAND(vp) + vp).bitwiseXOR(vp)).bitwiseOR(match)).bitwiseOR(vn)).bitwiseAND(F.lit(full))
        return F.struct(d0.alias("d0"), vp.alias("vp"), vn.alias("vn"), s["dist"].alias("dist"), i.alias("i"))

    def finish(s: Column) -> Column:
        d0, vp, vn, i = s["d0"], s["vp"], s["vn"], s["i"]
        hp = vn.bitwiseOR(F.lit(full).bitwiseXOR(d0.bitwiseOR(vp)))
        hn = d0.bitwiseAND(vp)
        last = i - (m - tau)  # 0 and up: the band's end has left a's last column, which is `last` + 1 bits below the top
        bit = F.call_function("shiftright", F.lit(top), (F.greatest(last, F.lit(0)) + 1).cast("int"))
        down = F.when(d0.bitwiseAND(F.lit(top)) == 0, 1).otherwise(0)
        along = F.when(hp.bitwiseAND(bit) != 0, 1).otherwise(0) - F.when(hn.bitwiseAND(bit) != 0, 1).otherwise(0)
        shifted = F.shiftright(d0, 1)
        return F.struct(
            hn.bitwiseOR(F.lit(full).bitwiseXOR(shifted.bitwiseOR(hp))).alias("vp"),
            shifted.bitwiseAND(hp).alias("vn"),
            (s["dist"] + F.when(last < 0, down).otherwise(along)).alias("dist"),
        )

    start = F.struct(F.lit(full ^ ((1 << (w - tau - 1)) - 1)).alias("vp"), F.lit(0).alias("vn"), F.lit(tau).alias("dist"))
    rounds = F.when(n > 0, F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0)))).otherwise(F.array().cast("array<int>"))
    # The array of one lets the row's d0 be evaluated once.
    folded = F.aggregate(rounds, start, lambda s, i: F.get(F.transform(F.array(step(s, i)), finish), F.lit(0)), lambda s: s["dist"])
    # Shorter than the band: the last column is met before the first row.
    return F.when(m <= tau, F.levenshtein(a, b)).otherwise(folded)


def _one_sign(group: DataFrame, scratch: common.Scratch) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Of large groups whose rests are one code point or none: stars (a, b) of the lines of the index's length, how many others each of these is linked to (lid, n_links),
    and the pairs (a, b) with lines that are longer by one."""
    index, probe = group.where("delta = 0"), group.where("delta = 1")
    heads = scratch.keep(index.groupBy("key").agg(F.min("lid").alias("head"), F.count("*").alias("n0")).where("n0 > 1"))
    own = scratch.keep(index.select("key", "lid").join(heads, "key"))
    stars = own.where("lid != head").select(F.col("head").alias("a"), F.col("lid").alias("b"))
    counts = own.select("lid", (F.col("n0") - 1).alias("n_links"))
    # A key and a rest are one line.
    asked = probe.select("key", F.col("lid").alias("b"), F.explode(F.when(F.col("m") == 0, F.array(F.lit(""))).otherwise(F.array_distinct(F.filter(F.split("rest", ""), lambda c: c != "")))).alias("rest"))
    longer = asked.join(index.select("key", "rest", F.col("lid").alias("a")), ["key", "rest"]).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    return stars, counts, longer


def links(occurrences: DataFrame, scratch: common.Scratch) -> tuple[DataFrame, DataFrame]:
    """(a, b): links between different lines (by MD5), enough to connect all pairs within the threshold; (lid, n_links): the number of lines within it."""
    long = _sized(occurrences)
    keyed = long.select(F.xxhash64("line").alias("h"), F.inline(_keys(False)))
    shared = (
        keyed.groupBy("key").agg(F.min("h").alias("low"), F.max("h").alias("high"), F.min("delta").alias("least"))
        .where("low != high and least = 0").select("key")
    )
    word = F.shiftright("key", 6).bitwiseAND(F.lit(BITMAP_WORDS - 1))
    bitmap = shared.select(word.alias("word"), F.expr("shiftleft(1L, cast(key & 63 as int))").alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("bits"))
    bitmap = scratch.keep(bitmap)
    rows = long.select(F.md5("line").alias("lid"), F.inline(_keys(True)))
    rows = rows.withColumn("word", word).join(F.broadcast(bitmap), "word").where("bit_get(bits, cast(key & 63 as int)) = 1")
    rows = scratch.keep(rows.select("key", "delta", "m", "lid", "rest").distinct())
    found, stars, counts, parts, at = None, None, None, int(scratch.spark.conf.get("spark.sql.shuffle.partitions")), 0
    parts = max(1, min(parts, 2 * scratch.spark.sparkContext.defaultParallelism))  # all cores compare, without a host of small files
    while True:
        # Written before the join, whose sides then come straight from exchanges, which adaptive execution can split at a hot key.
        sizes = scratch.keep(rows.groupBy("key").agg(F.count("*").alias("n"), F.min("delta").alias("least")).where("n > 1 and least = 0").select("key", "n"))
        sized = scratch.keep(rows.join(sizes, "key"))
        # Short rests are compared; so are longer ones once splitting has had its rounds. Large groups are split until nothing is left to split.
        small = (F.col("n") <= SMALL_GROUP) & ((F.col("m") <= SHORT_REST) | F.lit(at >= SPLIT_ROUNDS))
        last = (F.col("n") > SMALL_GROUP) & (F.col("m") <= 1)
        left = ~small & ~last
        # One pass tells what there is, so no plan is made for nothing.
        any_small, any_last, any_left = sized.agg(*[F.coalesce(F.bool_or(x), F.lit(False)) for x in (small, last, left)]).first()
        near = []
        if any_small:
            index, probe = (sized.where(small).select("key", "delta", "lid", "rest").toDF("key", f"{x}_delta", f"{x}_lid", f"{x}_rest") for x in "ab")
            pairs = index.where("a_delta = 0").join(probe, "key").where("a_lid != b_lid and (b_delta = 1 or a_lid < b_lid)")
            pairs = pairs.select("a_lid", "b_lid", "a_rest", "b_rest").repartition(parts)
            pairs = pairs.withColumn("_a", F.filter(F.split("a_rest", ""), lambda c: c != "")).withColumn("_b", F.filter(F.split("b_rest", ""), lambda c: c != ""))
            close = pairs.where(banded_distance(F.col("a_rest"), F.col("b_rest"), THRESHOLD) <= THRESHOLD)
            near.append(close.select(F.least("a_lid", "b_lid").alias("a"), F.greatest("a_lid", "b_lid").alias("b")))
        if any_last:
            star, count, longer = _one_sign(sized.where(last), scratch)
            near.append(longer)
            stars, counts = (star, count) if stars is None else (stars.union(star), counts.union(count))
        for x in near:
            x = scratch.keep(x)
            found = x if found is None else found.union(x)
        if not any_left:
            break
        rows = scratch.keep(sized.where(left).select("lid", F.inline(_entries(F.col("key"), F.col("rest"), F.col("m"), F.col("delta")))).select("key", "delta", "m", "lid", "rest").distinct())
        if stars is None:
            scratch.drop(sized)
        at += 1
    none = rows.select(F.col("lid").alias("a"), F.col("lid").alias("b")).where("false")
    found = scratch.keep(none if found is None else found.distinct())
    each = found.select(F.col("a").alias("lid")).union(found.select("b")).groupBy("lid").agg(F.count("*").alias("n_links"))
    if stars is None:
        return found, each
    return found.union(stars), each.union(counts).groupBy("lid").agg(F.sum("n_links").alias("n_links"))


def line_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, th, line_no, class_id, class_line, n_links, kept) of each line; class_id and class_line are the place of the class's first line."""
    scratch = common.Scratch(docs.sparkSession, "lines")
    every = lines(docs, id_col, text_col)
    pairs, counts = links(every, scratch)
    labels = connected_components(pairs.select(F.col("a").alias("src"), F.col("b").alias("dst")), keep=scratch.keep, drop=scratch.drop)
    labels = scratch.keep(labels.select(F.col("node").alias("lid"), "component").join(counts, "lid"))
    places = every.select("id", "th", "line_no", F.when(F.col("line") != "", F.md5("line")).alias("lid"))
    # Lines without a class, and with it a key to meet on, stay out of the joins.
    placed = places.where("lid is not null").join(labels, "lid", "left").select("id", "th", "line_no", F.coalesce("component", "lid").alias("class"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))
    placed = scratch.keep(placed)
    # Most lines are alone in their class and their own first place; a table of the others is all that a hot class's places are joined with.
    first = scratch.keep(placed.groupBy("class").agg(F.min(F.struct("id", "th", "line_no")).alias("f"), F.count("*").alias("n")).where("n > 1").select("class", "f"))
    own = F.struct("id", "th", "line_no")
    known = placed.join(first, "class", "left").withColumn("f", F.coalesce("f", own)).select(
        "id", "th", "line_no", F.col("f.id").alias("class_id"), F.col("f.line_no").alias("class_line"), "n_links",
        (F.col("id").eqNullSafe(F.col("f.id")) & (F.col("th") == F.col("f.th")) & (F.col("line_no") == F.col("f.line_no"))).alias("kept"),
    )
    none = F.lit(None)
    blank = places.where("lid is null").select("id", "th", "line_no", none.cast("long").alias("class_id"), none.cast("int").alias("class_line"), F.lit(0).cast("long").alias("n_links"), F.lit(True).alias("kept"))
    return known.unionByName(blank)


def query(spark, sf_dir: str) -> DataFrame:
    out = line_classes(common.table(spark, sf_dir, "documents"))
    return out.select(F.col("id").alias("doc_id"), F.col("line_no").cast("long").alias("line_no"), F.col("class_id").alias("class_doc"), F.col("class_line").cast("long").alias("class_line"), "n_links", "kept")


def without_repeated_lines(docs: DataFrame) -> DataFrame:
    """docs with the lines that are not kept taken out of text, and n_chars counted anew; all rows stay."""
    text = F.coalesce(F.col("d.text"), F.lit(""))
    gone = line_classes(docs).where("not kept").select("id", "th", "line_no").distinct().groupBy("id", "th").agg(F.collect_set("line_no").alias("gone"))
    left = docs.alias("d").join(gone.alias("g"), F.col("d.doc_id").eqNullSafe(F.col("g.id")) & (F.xxhash64(text) == F.col("g.th")), "left")
    lost = F.col("g.gone")
    cut = F.array_join(F.filter(F.split(text, "\n"), lambda line, i: ~F.array_contains(lost, i)), "\n")
    changed = {"text": cut, "n_chars": F.length(cut).cast(docs.schema["n_chars"].dataType)} if "n_chars" in docs.columns else {"text": cut}
    columns = {c: F.col(f"d.{common.quoted(c)}") for c in docs.columns}
    return left.select(*[(F.when(lost.isNull(), x).otherwise(changed[c]) if c in changed else x).alias(c) for c, x in columns.items()])


ORACLE = f"""
WITH RECURSIVE o AS (
  SELECT doc_id, unnest(range(len(l))) AS line_no, unnest(l) AS line FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents)),
d AS (SELECT line, length(line) AS n FROM o WHERE line <> '' GROUP BY line),
e AS (SELECT a.line AS a, b.line AS b FROM d a JOIN d b ON b.n = a.n AND a.line < b.line WHERE a.n >= {MIN_CHARS} AND levenshtein(a.line, b.line) <= {THRESHOLD}
      UNION ALL SELECT a.line, b.line FROM d a JOIN d b ON b.n = a.n + 1 WHERE a.n >= {MIN_CHARS} AND levenshtein(a.line, b.line) <= {THRESHOLD}),
s AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
r AS (SELECT a, b FROM s UNION SELECT r.a, s.b FROM r JOIN s ON r.b = s.a),
c AS (SELECT line, least(line, coalesce(m, line)) AS class, coalesce(k, 0) AS n_links FROM d
      LEFT JOIN (SELECT a AS line, min(b) AS m FROM r GROUP BY a) USING (line) LEFT JOIN (SELECT a AS line, count(*) AS k FROM s GROUP BY a) USING (line)),
f AS (SELECT class, min((doc_id, line_no)) AS f FROM o JOIN c USING (line) GROUP BY class)
SELECT doc_id, line_no, f[1] AS class_doc, f[2] AS class_line, coalesce(n_links, 0) AS n_links, coalesce((doc_id, line_no) = f, true) AS kept
FROM o LEFT JOIN c USING (line) LEFT JOIN f USING (class)
"""
