"""Conversation structure repair: a backward cost-to-go program over turn and grammar state, then a greedy walk forward.

A conversation's role initials have to read `(s?(ua)+)?`. Four states follow from it: B nothing yet, S after the system turn, U after the user, A after the assistant; B and A may end.
From each state at most one role comes next, but for B, where a system turn may too: so Rerole and Insert always make the user's or the assistant's turn,
whichever is due, and an edit's letter alone says what it does. Going backward, a row's cost-to-go in each state is the least of Delete (3), Keep (0, if its
initial is due) and Rerole (2), the last two with 1 more if the row is truncated, and of an Insert (2) before it. Blank and duplicate rows can only be deleted. Going forward
from B, the letter that is least in ASCII among those whose cost and cost-to-go add up to the present one is taken (D, I, K, R), so among all cheapest
edits the walk gives the least string.

Rows are dealt out by conversation once; all else is sorting within partitions. Repeats are numbered by a window over (conversation, role, text); the backward pass streams
a conversation from its last row to its first and adds to each row the costs to go; the forward pass streams it back and writes the turns. Both hold one row and four numbers, so
a conversation of any length takes constant memory, and sorts spill. It is one task's stream, since a digest over its ordered turns is
sequential anyway.

Defined cases: a null role or text is one space; a null conversation is one of its own, a null turn comes first (and counts in no gap); rows of equal turn are ordered by role, then text, by code points, and
repeated rows count each; roles count by their first sign, of which only s, u and a are in the grammar; empty tables give empty results; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common

#: Costs: Delete, Insert and Rerole, and what a truncated row adds that stays.
DELETE, INSERT, REROLE, TRUNCATED = 3, 2, 2, 1
#: No way to an end.
NEVER = 1 << 40
#: The states B, S, U, A: their number after the turn that is due, and that turn's role.
_NEXT, _DUE = (2, 2, 3, 2), ("user", "user", "assistant", "user")
_LEGAL = {"su", "ua", "au"}
#: Turns of an output batch, and bytes of text in it.
BATCH_ROWS, BATCH_BYTES = 5_000, 4 << 20


def damaged(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, gone): each row's damage is set by a checksum of conversation and turn. Rows that are dropped stay, marked, so that no conversation is lost."""
    id_, turn = F.col("conv_id").cast("long"), F.col("turn").cast("long")
    space = F.lit(" ")
    kind = F.crc32(F.concat(F.coalesce(id_.cast("string"), space), F.lit(":"), F.coalesce(turn.cast("string"), space)).cast("binary")) % 20
    rows = conversations.select(id_.alias("conv_id"), turn.alias("turn"), F.coalesce(F.col("role").cast("string"), space).alias("role"), F.coalesce(F.col("text").cast("string"), space).alias("text"), kind.alias("_kind"))
    text = F.when(F.col("_kind").isin(0, 1), "").when(F.col("_kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("_kind") == 4, "user").otherwise(F.col("role"))
    out = rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), (F.col("_kind") == 0).alias("gone"), "_kind")
    return out.withColumn("_copy", F.explode(F.when(F.col("_kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))).drop("_kind", "_copy")


def with_faults(rows: DataFrame) -> DataFrame:
    """rows (conv_id, turn, role, text, and gone where rows stand for nothing) by conversation, with `fault`: blank, duplicate, truncated or empty, and `place`, their order in the conversation."""
    if "gone" not in rows.columns:
        rows = rows.withColumn("gone", F.lit(False))
    dealt = rows.repartition("conv_id")
    order = [F.asc_nulls_first("turn"), "role", "text"]
    again = F.row_number().over(Window.partitionBy("conv_id", "gone", "role", "text").orderBy(F.asc_nulls_first("turn"))) > 1
    sign = "[^\\x20\\x09-\\x0D]"
    fault = (
        F.when(F.col("gone"), "").when(~F.col("text").rlike(sign), "blank").when(F.col("again"), "duplicate")
        .when(~F.col("text").rlike("[.!?][\\x20\\x09-\\x0D]*\\z"), "truncated").otherwise("")
    )
    # Of equal rows that stand together the first is the one that isn't a repeat.
    place = F.row_number().over(Window.partitionBy("conv_id").orderBy("gone", *order, "again"))
    return dealt.withColumn("again", again).withColumn("fault", fault).withColumn("place", place).drop("again")


def step_back(costs: tuple[int, ...], initial: str, fault: str) -> tuple[int, ...]:
    """Costs to go before a row in the states B, S, U, A, from those after it."""
    if fault in ("blank", "duplicate"):
        own = [DELETE + c for c in costs]
    else:
        extra, own = TRUNCATED if fault == "truncated" else 0, []
        for q in range(4):
            least = min(DELETE + costs[q], REROLE + extra + costs[_NEXT[q]])
            if initial and initial == _DUE[q][0]:
                least = min(least, extra + costs[_NEXT[q]])
            elif initial == "s" and q == 0:
                least = min(least, extra + costs[1])
            own.append(least)
    return with_inserts(own)


def with_inserts(own: list[int]) -> tuple[int, ...]:
    """The same once turns may be put in: the ways round the states U and A cost more each time, so two steps are enough."""
    u, a = min(own[2], INSERT + own[3]), min(own[3], INSERT + own[2])
    return min(own[0], INSERT + u), min(own[1], INSERT + u), u, a


#: Costs to go at a conversation's end.
END = with_inserts([0, NEVER, NEVER, 0])


def step_ahead(q: int, before: tuple[int, ...], after: tuple[int, ...] | None, initial: str, fault: str) -> tuple[str, int, int]:
    """(letter, its cost, next state) in state q: the least letter that keeps to the cheapest way. before: costs to go here; after: those behind the row, None at the end."""
    due = _NEXT[q]
    if after is not None and before[q] == DELETE + after[q]:
        return "D", DELETE, q
    if before[q] == INSERT + before[due]:
        return "I", INSERT, due
    extra = TRUNCATED if fault == "truncated" else 0
    to = due if initial == _DUE[q][0] else 1
    if (initial == _DUE[q][0] or (initial == "s" and q == 0)) and before[q] == extra + after[to]:
        return "K", extra, to
    return "R", REROLE + extra, due


def _rows(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[tuple]:
    for batch in batches:
        for at in range(0, batch.num_rows, 1000):
            piece = batch.slice(at, 1000)
            yield from zip(*(common.column(piece, n).to_pylist() for n in names))


class _Out:
    """Rows that go on as batches of bounded size."""

    def __init__(self, schema: str):
        kinds = {"long": pa.int64(), "string": pa.string(), "boolean": pa.bool_(), "array<long>": pa.list_(pa.int64())}
        self.schema = pa.schema([(c.split()[0], kinds[c.split()[1]]) for c in schema.split(", ")])
        self.rows, self.held = [], 0

    def add(self, row: tuple, size: int) -> Iterator[pa.RecordBatch]:
        self.rows.append(row)
        self.held += size
        if len(self.rows) >= BATCH_ROWS or self.held >= BATCH_BYTES:
            yield from self.flush()

    def flush(self) -> Iterator[pa.RecordBatch]:
        if self.rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*self.rows), self.schema)], schema=self.schema)
            self.rows, self.held = [], 0


_COSTED = "conv_id long, place long, turn long, role string, text string, fault string, gone boolean, before array<long>, after array<long>"


def costed(rows: DataFrame) -> DataFrame:
    """rows with the costs to go before and behind each, by a stream from every conversation's last row to its first."""

    def run(batches):
        out, now, costs, known = _Out(_COSTED), None, END, False
        for conv, place, turn, role, text, fault, gone in _rows(batches, ["conv_id", "place", "turn", "role", "text", "fault", "gone"]):
            if not known or conv != now:
                now, costs, known = conv, END, True
            after = costs
            if not gone:
                costs = step_back(after, role[:1], fault)
            yield from out.add((conv, place, turn, role, text, fault, gone, costs, after), len(text) + len(role))
        yield from out.flush()

    return rows.sortWithinPartitions("conv_id", F.desc("place")).mapInArrow(run, _COSTED)


_TURNS = "conv_id long, turn long, edit string, role string, text string, old_role string, fault string, cost long, gone boolean"


def repaired_turns(rows: DataFrame) -> DataFrame:
    """The edited conversations, each one's turns in order within a partition: edit K or R with the turn as it is now, I with one put in, D with one that goes (its role and text as they were).
    rows: (conv_id, turn, role, text). Rows marked `gone` come out as such, without an edit."""

    def run(batches):
        out, now, known, q, last = _Out(_TURNS), None, False, 0, END

        def inserts(conv, before, after, initial, fault):
            """Turns that are put in before a row, or at the end, and the edit that comes then."""
            nonlocal q
            while after is not None or q not in (0, 3):
                letter, cost, to = step_ahead(q, before, after, initial, fault)
                if letter != "I":
                    return letter, cost, to
                yield from out.add((conv, None, "I", _DUE[q], "", None, "", cost, False), 0)
                q = to

        for conv, _, turn, role, text, fault, gone, before, after in _rows(batches, [c.split()[0] for c in _COSTED.split(", ")]):
            if not known or conv != now:
                if known:
                    yield from inserts(now, END, None, "", "")
                now, known, q = conv, True, 0
            if gone:
                yield from out.add((conv, turn, None, role, text, role, fault, 0, True), len(text))
                continue
            letter, cost, to = yield from inserts(conv, before, after, role[:1], fault)
            kept = role if letter != "R" else _DUE[q]
            yield from out.add((conv, turn, letter, kept, text, role, fault, cost, False), len(text))
            q = to
        if known:
            yield from inserts(now, END, None, "", "")
        yield from out.flush()

    return costed(with_faults(rows)).sortWithinPartitions("conv_id", "place").mapInArrow(run, _TURNS)


_DIGEST = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def digests(turns: DataFrame) -> DataFrame:
    """One row for each conversation of repaired_turns, whose order it goes by."""

    def run(batches):
        out, now, known = _Out(_DIGEST), None, False
        low = high = seen = None
        turns_, faults, illegal, cost, audit, digest, first, initial = 0, {}, 0, 0, [], hashlib.sha256(), True, None

        def done():
            gaps = high - low + 1 - turns_ if high is not None else 0
            return now, gaps, faults["blank"], faults["duplicate"], faults["truncated"], illegal, cost, "".join(audit), digest.hexdigest()

        names = [c.split()[0] for c in _TURNS.split(", ")]
        for conv, turn, edit, role, text, old, fault, own, gone in _rows(batches, names):
            if not known or conv != now:
                if known:
                    yield from out.add(done(), len(audit))
                now, known, low, high, seen = conv, True, None, None, None
                turns_, faults, illegal, cost, audit, digest, first, initial = 0, {"blank": 0, "duplicate": 0, "truncated": 0}, 0, 0, [], hashlib.sha256(), True, None
            if gone:
                continue
            audit.append(edit)
            cost += own
            if edit != "I":
                if fault:
                    faults[fault] += 1
                if initial is not None and initial + old[:1] not in _LEGAL:
                    illegal += 1
                initial = old[:1]
                if turn is not None:
                    # Turns ascend, so a new one differs from the last.
                    turns_, low, high = turns_ + (turn != seen), turn if low is None else low, turn
                    seen = turn
            if edit != "D":
                digest.update(f"{'' if first else chr(10)}{role}:{text}".encode("utf-8", "surrogatepass"))
                first = False
        if known:
            yield from out.add(done(), len(audit))
        yield from out.flush()

    return turns.mapInArrow(run, _DIGEST)


def repair(conversations: DataFrame) -> DataFrame:
    """Faults, cheapest repair and digest of each conversation as it stands, without damage."""
    kept = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), *[F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c) for c in ("role", "text")])
    return digests(repaired_turns(kept))


def query(spark, sf_dir: str) -> DataFrame:
    return digests(repaired_turns(damaged(common.table(spark, sf_dir, "conversations"))))


ORACLE = """
WITH RECURSIVE tab AS (SELECT list(t ORDER BY i) AS t FROM (SELECT i, list_reduce(list_concat([i], range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS t FROM range(256) x(i))),
raw AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS k FROM conversations),
keyed AS (SELECT raw.*, xor(list_reduce(list_concat([4294967295], list_transform(string_split(k, ''), lambda c: CAST(ascii(c) AS BIGINT))), lambda c, b: xor(c >> 8, tab.t[(xor(c, b) & 255) + 1])), 4294967295) % 20 AS kind FROM raw CROSS JOIN tab),
d AS (SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role, CASE WHEN kind = 1 THEN '' WHEN kind = 2 THEN translate(text, '.!?', '') ELSE text END AS text, unnest(CASE WHEN kind = 3 THEN [0, 1] ELSE [0] END) AS copy FROM keyed WHERE kind <> 0),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, again) AS p FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST) > 1 AS again FROM d)),
r AS MATERIALIZED (SELECT coalesce(CAST(conv_id AS VARCHAR), 'none') AS c, turn, role, text, p, role[1:1] AS i, lag(role[1:1]) OVER (PARTITION BY conv_id ORDER BY p) AS before,
  CASE WHEN NOT regexp_matches(text, '[^\\x20\\x09-\\x0D]') THEN 'blank' WHEN again THEN 'duplicate' WHEN NOT regexp_matches(text, '[.!?][\\x20\\x09-\\x0D]*\\z') THEN 'truncated' ELSE '' END AS fault FROM o),
bk AS MATERIALIZED (WITH RECURSIVE walk AS (
  SELECT c, max(p) + 1 AS p, 0 AS b, 4 AS s, 2 AS u, 0 AS a FROM r GROUP BY c
  UNION ALL
  SELECT c, p, least(ob, 2 + least(ou, 2 + oa)), least(os, 2 + least(ou, 2 + oa)), least(ou, 2 + oa), least(oa, 2 + ou) FROM (
    SELECT c, p, least(3 + b, kept + 2 + u, kept + CASE i WHEN 'u' THEN u WHEN 's' THEN s ELSE 1000000 END) AS ob, least(3 + s, kept + 2 + u, kept + CASE i WHEN 'u' THEN u ELSE 1000000 END) AS os,
      least(3 + u, kept + 2 + a, kept + CASE i WHEN 'a' THEN a ELSE 1000000 END) AS ou, least(3 + a, kept + 2 + u, kept + CASE i WHEN 'u' THEN u ELSE 1000000 END) AS oa
    FROM (SELECT r.c, r.p, r.i, w.b, w.s, w.u, w.a, CASE r.fault WHEN 'truncated' THEN 1 WHEN '' THEN 0 ELSE 1000000 END AS kept FROM walk w JOIN r ON r.c = w.c AND r.p = w.p - 1)))
  SELECT * FROM walk),
st AS MATERIALIZED (SELECT x.c, x.p, x.b, x.s, x.u, x.a, y.b AS nb, y.s AS ns, y.u AS nu, y.a AS na, r.role, r.text, r.i, CASE r.fault WHEN 'truncated' THEN 1 ELSE 0 END AS e
  FROM bk x LEFT JOIN bk y ON y.c = x.c AND y.p = x.p + 1 LEFT JOIN r ON r.c = x.c AND r.p = x.p),
fw AS (
  SELECT c, CAST(1 AS BIGINT) AS p, 'b' AS q, '' AS audit, CAST([] AS VARCHAR[]) AS turns, 0 AS cost FROM (SELECT DISTINCT c FROM r)
  UNION ALL
  SELECT c, CASE WHEN edit = 'I' THEN p ELSE p + 1 END, CASE edit WHEN 'D' THEN q WHEN 'K' THEN i ELSE due END, audit || edit,
    CASE edit WHEN 'D' THEN turns WHEN 'I' THEN list_append(turns, dn || ':') WHEN 'K' THEN list_append(turns, role || ':' || text) ELSE list_append(turns, dn || ':' || text) END,
    cost + CASE edit WHEN 'D' THEN 3 WHEN 'I' THEN 2 WHEN 'K' THEN e ELSE 2 + e END FROM (
    SELECT *, CASE WHEN now = 3 + same THEN 'D' WHEN now = 2 + there THEN 'I' WHEN i IS NULL THEN NULL WHEN (i = due OR (i = 's' AND q = 'b')) AND now = e + CASE i WHEN 's' THEN ns ELSE further END THEN 'K' ELSE 'R' END AS edit FROM (
      SELECT fw.*, st.role, st.text, st.i, st.e, st.ns, CASE fw.q WHEN 'u' THEN 'a' ELSE 'u' END AS due, CASE fw.q WHEN 'u' THEN 'assistant' ELSE 'user' END AS dn,
        CASE fw.q WHEN 'b' THEN st.b WHEN 's' THEN st.s WHEN 'u' THEN st.u ELSE st.a END AS now, CASE fw.q WHEN 'b' THEN st.nb WHEN 's' THEN st.ns WHEN 'u' THEN st.nu ELSE st.na END AS same,
        CASE fw.q WHEN 'u' THEN st.a ELSE st.u END AS there, CASE fw.q WHEN 'u' THEN st.na ELSE st.nu END AS further
      FROM fw JOIN st ON st.c = fw.c AND st.p = fw.p))
  WHERE edit IS NOT NULL),
done AS (SELECT c, arg_max(audit, len(audit)) AS audit, arg_max(cost, len(audit)) AS cost, arg_max(array_to_string(turns, chr(10)), len(audit)) AS text FROM fw GROUP BY c),
sums AS (SELECT c, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
  count(*) FILTER (p > 1 AND before || i NOT IN ('su', 'ua', 'au')) AS illegal FROM r GROUP BY c)
SELECT x.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, CAST(coalesce(cost, 0) AS BIGINT) AS cost,
  coalesce(audit, '') AS audit, sha256(coalesce(text, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id, coalesce(CAST(conv_id AS VARCHAR), 'none') AS c FROM conversations) x LEFT JOIN sums USING (c) LEFT JOIN done USING (c)
"""
