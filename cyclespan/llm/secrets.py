"""Secret scans: three base patterns, and an assignment-aware lexer that adds literals of sensitive names.

The lexer parses source and configuration syntax (name = "x", name: x, "name": "x", name => x, NAME=x, keyword
arguments, <name>x</name>) into tokens and name-literal pairs, joins adjacent or +-concatenated literals (in parentheses over several lines), and propagates
constants: a name bound to a literal, or to a name so bound, carries that literal to the names it is assigned to. A
literal's score is the sensitivity of the most sensitive name it reaches plus marks for length, mixed character
classes and entropy; at MIN_SCORE its span is reported as kind `literal`. Base spans always stay.

A text with a part of a sensitive name in it is lexed whole, so comments hide what they hold however far above they began. An
unquoted value is a constant's name if the text binds it, else the literal itself.

Spans are start:end in code points, end exclusive; of a base match the whole match. The SHA-256 is of the joined base
spans (of the empty string where there is none).

Defined cases: a null text is empty and gives zero counts; repeated rows are scanned each; null ids are kept; an empty
table gives an empty result; other columns are ignored. All work is linear in the text but for the chains of
constants, each name of which is resolved once.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
#: Whole runs are what [..]+ matches, so asking for the least length at once finds the same spans.
ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")
HEX = re.compile(r"[0-9a-f]{32,}")
KINDS = ("assign", "access", "hex", "literal")

#: Sensitivity of a target name by the parts that it is made of.
SENSITIVE = {"password": 3.0, "passwd": 3.0, "pwd": 2.5, "passphrase": 3.0, "secret": 3.0, "token": 2.5, "apikey": 3.0, "api_key": 3.0, "access_key": 3.0, "private_key": 3.0, "credential": 2.5, "auth": 1.5, "signing_key": 3.0, "encryption_key": 3.0}
MIN_SCORE = 4.0
MIN_LENGTH = 8
_TOKEN = re.compile(
    r"""(?P<comment>(?<!:)//[^\n]*|(?<!\S)\#[^\n]*)|(?P<open>/\*)"""
    r"""|(?P<string>"(?:[^"\\\n]|\\.)*"|(?<![A-Za-z0-9])'(?:[^'\\\n]|\\.)*'|`[^`\n]*`)"""
    r"""|(?P<op>=>|:=|==|!=|<=|>=|[=:+,;(){}\[\]<>])"""
    r"""|(?P<word>(?:[A-Za-z0-9_$.+@%&*~!?-]|/(?![/*]))+)|(?P<nl>\n)""",
    re.S,
)
_ELEMENT = re.compile(r"<([A-Za-z_][A-Za-z0-9_.:-]*)(?:\s[^<>]*)?>([^<>]*)</\1\s*>")
#: Parts of sensitive names as they may be written, for a first look at a text.
_PARTS = tuple(sorted({p for part in SENSITIVE for p in (part, part.replace("_", ""), part.replace("_", "-"))}))
_NAME = re.compile(r"[A-Za-z_$][A-Za-z0-9_$.-]*$")


def sensitivity(name: str) -> float:
    """The greatest weight of a part of the name, camelCase and dashes folded to underscores."""
    flat = re.sub(r"(?<=[a-z0-9])(?=[A-Z])", "_", name).replace("-", "_").replace(".", "_").lower()
    return max((w for part, w in SENSITIVE.items() if part in flat), default=0.0)


def entropy(value: str) -> float:
    n = len(value)
    return -sum(c / n * math.log2(c / n) for c in Counter(value).values()) if n else 0.0


def strength(value: str) -> float:
    """How much a value looks like a secret, 0 to 2.5: classes of characters, entropy, no words or placeholders."""
    if len(value) < MIN_LENGTH or re.search(r"\s", value) or re.fullmatch(r"(.)\1*|[<{$%].*|.*(example|changeme|placeholder|xxxx).*", value, re.I | re.S):
        return 0.0
    classes = sum(bool(re.search(p, value)) for p in ("[a-z]", "[A-Z]", "[0-9]", r"[^A-Za-z0-9]"))
    return 0.5 * min(classes, 3) + (1.0 if entropy(value) >= 3.0 else 0.5 if entropy(value) >= 2.5 else 0.0)


def lex(text: str) -> list[tuple[str, str, int, int]]:
    """(kind, text, start, end) of each token outside comments; a string's span and text leave out its quotes."""
    out, at, closed, search = [], 0, True, _TOKEN.search
    while m := search(text, at):
        kind, a, at = m.lastgroup, m.start(), m.end()
        if kind == "open":
            # One that is never closed is no comment, and then none behind it is closed either.
            end = text.find("*/", at) if closed else -1
            closed = end >= 0
            at = end + 2 if closed else at
        elif kind == "string":
            out.append((kind, text[a + 1 : at - 1], a + 1, at - 1))
        elif kind != "comment":
            out.append((kind, m[0], a, at))
    return out


def _value(tokens: list[tuple[str, str, int, int]], j: int) -> tuple[list[tuple], str | None]:
    """(literal tokens, source name) of the value that begins at token j. An unquoted word may be either."""
    n, depth, parts = len(tokens), 0, []

    def after(j: int, lines: bool) -> int:
        while lines and j < n and tokens[j][0] == "nl":
            j += 1
        return j

    # A string may stand on the next line; parentheses may hold several lines.
    k = after(j, True)
    if k < n and tokens[k][0] == "string":
        j = k
    while j < n and tokens[j][:2] == ("op", "("):
        depth, j = depth + 1, after(j + 1, True)
    while j < n:
        kind, t, *_ = tokens[j]
        if kind == "string":
            parts.append(tokens[j])
        elif kind == "word" and not parts:
            named = bool(_NAME.match(t))
            ends = j + 1 == n or tokens[j + 1][0] == "nl"
            return [tokens[j]] if not named or ends or re.search(r"\d", t) else [], t if named else None
        else:
            break
        j = after(j + 1, depth > 0)
        if j < n and tokens[j][:2] == ("op", "+"):
            j = after(j + 1, True)
        elif j >= n or tokens[j][0] != "string":
            break
    return parts, None


def pairs(tokens: list[tuple[str, str, int, int]]) -> list[tuple[str, list[tuple], str | None]]:
    """(target name, literal tokens, source name): one for each assignment; a source name stands for a constant."""
    out = []
    for i, (kind, op, *_) in enumerate(tokens):
        if kind != "op" or op not in ("=", ":", ":=", "=>") or not i:
            continue
        name = tokens[i - 1]
        if name[0] == "string" and op == "=" or name[0] not in ("word", "string") or not _NAME.match(name[1]):
            if not (name[0] == "op" and name[1] == "]" and i >= 3 and tokens[i - 2][0] == "string"):
                continue
            name = tokens[i - 2]  # config["name"] = ...
        parts, source = _value(tokens, i + 1)
        if parts or source:
            out.append((name[1], parts, source))
    return out


def elements(text: str) -> list[tuple[str, list[tuple], None]]:
    """As pairs: the elements <name>x</name> that hold no others."""
    out = []
    for m in _ELEMENT.finditer(text):
        value = m[2].strip()
        if value:
            a = m.start(2) + m[2].index(value)
            out.append((m[1], [("string", value, a, a + len(value))], None))
    return out


def literals(text: str) -> set[tuple[int, int]]:
    """Spans of literals whose score reaches MIN_SCORE."""
    found = pairs(lex(text)) + (elements(text) if "</" in text else [])
    bound = {name for name, parts, _ in found if parts}
    # An unquoted word that the text binds elsewhere is that constant; one that it doesn't is a literal or nothing.
    found = [(name, [] if source in bound and source != name else parts, source if source in bound else None) for name, parts, source in found]
    # From each target, along names bound to names, to the literal: the best sensitivity seen on the way.
    best = [sensitivity(name) for name, *_ in found]
    uses: dict[str, float] = {}
    by_name: dict[str, list[str]] = {}
    for (name, _, source), s in zip(found, best):
        if source:
            uses[source] = max(uses.get(source, 0.0), s)
            by_name.setdefault(name, []).append(source)
    pending = [x for x, s in uses.items() if s > 0]
    while pending:
        name = pending.pop()
        for source in by_name.get(name, ()):
            if uses[name] > uses.get(source, 0.0):
                uses[source] = uses[name]
                pending.append(source)
    out = set()
    for (name, parts, _), own in zip(found, best):
        s = max(own, uses.get(name, 0.0))
        if parts and s > 0:
            held = strength("".join(p[1] for p in parts))
            if held > 0 and s + held >= MIN_SCORE:
                out.update((p[2], p[3]) for p in parts if p[3] > p[2])
    return out


def scan(text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """(base spans, all spans): (start, place of the kind, end), sorted."""
    base, extra = [], set()
    low = text.lower()
    if any(part in low for part in _PARTS):
        base += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
        extra = literals(text)
    if "AKIA" in text:
        base += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    base += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(base), sorted(base + [(a, 3, b) for a, b in extra])


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


SCHEMA = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_literal long"


def secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of docs."""

    def make():
        def f(batch: pa.RecordBatch) -> pa.RecordBatch:
            rows = []
            for i, text in zip(common.column(batch, "id").to_pylist(), common.column(batch, "text").to_pylist()):
                base, spans = scan(text)
                n = Counter(k for _, k, _ in spans)
                rows.append((i, n[0], n[1], n[2], hashlib.sha256(joined(base).encode()).hexdigest(), joined(spans), n[3]))
            types = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows), types)], [x.split()[0] for x in SCHEMA.split(", ")])

        return f

    return common.map_slices(docs.select(F.col(id_col).cast("long").alias("id"), common.text_of(text_col).alias("text")), make, SCHEMA)


def query(spark, sf_dir: str) -> DataFrame:
    return secrets(common.table(spark, sf_dir, "documents"))
