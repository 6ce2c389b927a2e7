"""Secret scan by assignment-aware lexing.

A text is lexed into name-literal pairs (``name = "literal"``, ``"name": literal``, ``name := 'a' + 'b'``,
``export NAME=literal``). A literal is scored by the name it ends up under: a name that is assigned another name
takes over that name's literals (constants propagate, also along chains), so ``K = "x1..."; api_key = K`` reports the
literal at K. The shapes every scan looks for (``assign``, ``access``, ``hex``) are findings of their own.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.llm.common import give_back, table, texts
from gleaner.llm.registry import query

#: Kinds in report order; ``pair`` is what lexing adds.
KINDS = ["assign", "access", "hex", "pair"]
BASE_KINDS = KINDS[:3]

ASSIGN = re.compile(
    r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.ASCII | re.IGNORECASE,
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")

#: A name with its operator; what follows is read by ``LITERAL`` or ``REFERENCE``.
TARGET = re.compile(r"(?<![\w$.-])([A-Za-z_$][\w$.-]*+)[\"'\]]*+[ \t]*+(?::=|=>|=(?![=~])|:(?![:/]))[ \t]*+")
LITERAL = re.compile(r"\"((?:[^\"\\\n]|\\.)*+)\"|'((?:[^'\\\n]|\\.)*+)'|`([^`\n]*+)`")
BARE = re.compile(r"[A-Za-z0-9+/_.=~!@#%^&*-]++")
DIGIT = re.compile(r"\d")
REFERENCE = re.compile(r"\$?\{?([A-Za-z_$][\w$.-]*+)\}?")
PLUS = re.compile(r"[ \t]*+(?:\+|\.\.?|\|\|)[ \t]*+")

#: Words of a target name and how strongly they mark its literal as a secret.
NAME_WEIGHTS = {
    "password": 1.0, "passwd": 1.0, "passphrase": 1.0, "pwd": 0.9, "pass": 0.7, "secret": 1.0, "token": 0.9, "apikey": 1.0,
    "credential": 0.9, "credentials": 0.9, "auth": 0.6, "bearer": 0.8, "signature": 0.6, "private": 0.6, "access": 0.5,
    "key": 0.6, "salt": 0.6, "cert": 0.5, "dsn": 0.6,
}
#: Name words that say the literal is about a secret, not one.
NAME_DAMPERS = {"name": 0.5, "file": 0.5, "path": 0.5, "url": 0.4, "hint": 0.6, "type": 0.6, "length": 0.7, "id": 0.3, "public": 0.6}
PLACEHOLDERS = re.compile(
    r"(?i)^(?:x+|\*+|\.+|none|null|nil|true|false|undefined|changeme|change_me|example|placeholder|redacted|todo|your[_-].*"
    r"|<.*>|\$\{.*\}|\{\{.*\}\}|%\(.*\)s)$"
)
PARTS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|\d+")

#: Start, end, and whether the literal stands without quotes.
Span = tuple[int, int, bool]
FINDING = pa.struct([
    ("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("name", pa.string()), ("score", pa.float64()),
])


def name_score(name: str) -> float:
    parts = [p.lower() for p in PARTS.findall(name)]
    joined = [a + b for a, b in zip(parts, parts[1:])]
    weight = max((NAME_WEIGHTS.get(p, 0.0) for p in parts + joined), default=0.0)
    return max(0.0, weight - max((NAME_DAMPERS.get(p, 0.0) for p in parts[-1:]), default=0.0))


def literal_score(value: str, bare: bool) -> float:
    """0 for short, placeholder or prose-like values; grows with the entropy of the characters and their variety."""
    if len(value) < 8 or PLACEHOLDERS.match(value) or " " in value.strip():
        return 0.0
    n = len(value)
    entropy = -sum(c / n * math.log2(c / n) for c in Counter(value).values())
    return weighed(entropy, value, bare)


def weighed(entropy: float, characters: str, bare: bool) -> float:
    """The score of a value by its entropy and the kinds of its characters; a bare word without a digit is none."""
    classes = sum(bool(re.search(p, characters)) for p in ("[a-z]", "[A-Z]", "[0-9]", "[^A-Za-z0-9]"))
    if bare and not re.search("[0-9]", characters):
        return 0.0
    return min(1.0, entropy / 3.0) * (0.4 + 0.2 * classes if classes < 3 else 1.0)


class Lexer:
    """Reads the values of one text; its runs of bare characters are found once, however many names stand inside them."""

    def __init__(self, text: str):
        self.text = text
        self.starts: list[int] | None = None
        self.ends: list[int] = []

    def bare_end(self, at: int) -> int:
        """Where the bare run that holds ``at`` ends; ``at`` itself if none does."""
        if self.starts is None:
            runs = [m.span() for m in BARE.finditer(self.text, at)]  # values are asked in ascending order: none before this one
            self.starts, self.ends = [r[0] for r in runs], [r[1] for r in runs]
        i = bisect_right(self.starts, at) - 1
        return max(at, self.ends[i]) if i >= 0 else at

    def value(self, at: int, stop: int) -> tuple[list[Span], list[str]]:
        """Literal spans (start, end, bare) and referenced names of the value that starts at ``at``.

        Only its first operand may reach past ``stop``, where the next name stands: what is added there is not its own.
        """
        text, spans, names = self.text, [], []
        while True:
            if m := LITERAL.match(text, at):
                group = m.lastindex
                if group:
                    spans.append((m.start(group), m.end(group), False))
                at = m.end()
            elif (end := self.bare_end(at)) > at:
                if (r := REFERENCE.fullmatch(text, at, end)) and not DIGIT.search(text, at, end):
                    names.append(r.group(1))
                else:
                    spans.append((at, end, True))
                at = end
            elif (r := REFERENCE.match(text, at)) and r.end() > at:
                names.append(r.group(1))
                at = r.end()
            else:
                return spans, names
            p = PLUS.match(text, at)
            if not p or p.end() >= stop:
                return spans, names
            at = p.end()


def lex(text: str) -> list[tuple[str, list[Span], list[str]]]:
    """Every assignment of the text: (name, literal spans, referenced names)."""
    out, lexer, targets = [], Lexer(text), list(TARGET.finditer(text))
    for m, after in zip(targets, [*[t.start() for t in targets[1:]], len(text)]):
        spans, names = lexer.value(m.end(), after)
        if spans or names:
            out.append((m.group(1), spans, names))
    return out


def propagated(pairs: list) -> Iterator[tuple[str, Span]]:
    """(target name, literal span): own literals and those of the constants a value names.

    A reference takes the last assignment of its name before it, so cycles can't arise. An assignment keeps its own spans
    and the assignments it refers to, nothing is copied along a chain. A chain is walked again only for a name that counts
    more than all names before: each assignment is met as often as there are name scores at most.
    """
    last: dict[str, int] = {}
    refers: list[list[int]] = []
    walked = [0.0] * len(pairs)
    for k, (name, _, names) in enumerate(pairs):
        refers.append([last[other] for other in names if other in last])
        last[name] = k
        rank = name_score(name)
        work = [k] if rank else []
        while work:
            at = work.pop()
            if walked[at] < rank:
                walked[at] = rank
                for span in pairs[at][1]:
                    yield name, span
                work += refers[at]


def bare_scores(text: str, spans: set[Span]) -> dict[Span, float]:
    """Scores of bare spans; those that end together are read once, from their end backwards."""
    by_end: dict[int, list[int]] = {}
    for start, end, _ in spans:
        by_end.setdefault(end, []).append(start)
    out = {}
    for end, starts in by_end.items():
        seen, total, asked = Counter(), 0.0, set(starts)
        for at in range(end - 1, min(starts) - 1, -1) if len(starts) > 1 else ():
            c = seen[text[at]]
            total += (c + 1) * math.log2(c + 1) - (c * math.log2(c) if c else 0.0)
            seen[text[at]] += 1
            n = end - at
            if at in asked and n > 64:
                one = len(seen) == 1 and text[at] in "xX*."
                blank = one or text[at : at + 5].lower() in ("your_", "your-")
                joined = "".join(seen)
                out[at, end, True] = 0.0 if blank else weighed(math.log2(n) - total / n, joined, True)
        for start in starts:
            if (start, end, True) not in out:
                out[start, end, True] = literal_score(text[start:end], True)
    return out


def findings(text: str | None, threshold: float = 0.5) -> list[tuple[str, int, int, str | None, float]]:
    """(kind, start, end, name, score) by start, then kind; positions in code points, end exclusive."""
    if not text:
        return []
    out: list[tuple[str, int, int, str | None, float]] = []
    if ":" in text or "=" in text:
        out += [("assign", m.start(), m.end(), m.group(1), 1.0) for m in ASSIGN.finditer(text) if len(m.group(2)) >= 8]
        covered = sorted((f[1], f[2]) for f in out)
        starts = [s for s, _ in covered]
        seen = set()
        named = list(propagated(lex(text)))
        bare_ones = bare_scores(text, {span for _, span in named if span[2]})
        for name, span in named:
            start, end, bare = span
            score = name_score(name) * (bare_ones[span] if bare else literal_score(text[start:end], False))
            i = bisect_right(starts, start) - 1
            inside = i >= 0 and end <= covered[i][1]
            if score >= threshold and not inside and (start, end) not in seen:
                seen.add((start, end))
                out.append(("pair", start, end, name, round(score, 4)))
    if "AKIA" in text:
        out += [("access", m.start(), m.end(), None, 1.0) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    out += [("hex", m.start(), m.end(), None, 1.0) for m in HEX.finditer(text)]
    out.sort(key=lambda f: (f[1], KINDS.index(f[0]), f[2]))
    return out


def scan_secrets(df: DataFrame, text: str = "text", out: str = "secrets", threshold: float = 0.5) -> DataFrame:
    """Add ``out``: array of (kind, start, end, name, score) found in the whole text, by start, then kind.

    A null or empty text has none. Equal texts have equal findings; no other column is read, whatever its name or
    nulls. Long texts are scanned whole, each character a bounded number of times. Rows never meet, so nothing is shuffled.
    """

    @F.arrow_udf("array<struct<kind:string,start:bigint,end:bigint,name:string,score:double>>")
    def scan(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        give_back()
        for batch in batches:
            rows = [[dict(zip(("kind", "start", "end", "name", "score"), f)) for f in findings(t, threshold)] for t in texts(batch)]
            yield pa.array(rows, pa.list_(FINDING))

    return df.withColumn(out, scan(F.col(text)))


def redact(df: DataFrame, text: str = "text", mask: str = "[secret]", threshold: float = 0.5) -> DataFrame:
    """The same rows and columns with every found span, overlaps merged, replaced by ``mask``; nulls stay null."""

    @F.arrow_udf("string")
    def clean(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        give_back()
        for batch in batches:
            yield pa.array([masked(t, mask, threshold) for t in texts(batch)], pa.string())

    return df.withColumn(text, clean(F.col(text)))


def masked(text: str | None, mask: str, threshold: float) -> str | None:
    if not text:
        return text
    parts, at, end = [], 0, -1
    for _, start, stop, _, _ in findings(text, threshold):
        if start >= end:
            if end >= 0:
                parts.append(mask)
                at = end
            parts.append(text[at:start])
            end = stop
        else:
            end = max(end, stop)
    if end < 0:
        return text
    return "".join([*parts, mask, text[end:]])


def count_of(kind: str) -> Column:
    return F.size(F.filter("secrets", lambda f: f["kind"] == kind)).cast("bigint")


def spans_of(found: Column) -> Column:
    return F.array_join(
        F.transform(found, lambda f: F.concat_ws(":", f["kind"], f["start"].cast("string"), f["end"].cast("string"))), ",",
    )


@query("op1_secret_scan")
def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_secrets(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "secrets")
    base = F.filter("secrets", lambda f: f["kind"].isin(BASE_KINDS))
    count = [count_of(kind).alias(f"n_{kind}") for kind in BASE_KINDS]
    return found.select("doc_id", *count, F.sha2(spans_of(base), 256).alias("base_sha256"), spans_of(F.col("secrets")).alias("spans"))
