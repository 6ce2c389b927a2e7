"""Text columns: cleaning, normal forms, language. Everything stays in JVM expressions except
Unicode composition, which only the rows that can need it are sent through."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from gleaner import fixed

WS = fixed.WS


def _column(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def text_or_blank(c) -> Column:
    return F.coalesce(_column(c), F.lit(""))


def once(c: Column, use: Callable[[Column], Column]) -> Column:
    """``use(c)`` with ``c`` evaluated a single time, however often ``use`` mentions it."""
    return F.element_at(F.transform(F.array(c), use), 1)


def squeeze(c) -> Column:
    """One space between words, none at the ends."""
    return F.trim(F.regexp_replace(text_or_blank(c), f"{WS}+", " "))


def one_line(c) -> Column:
    return squeeze(F.regexp_replace(text_or_blank(c), fixed.CONTROL_AND_BIDI, " "))


def clip(c, n: int) -> Column:
    return F.left(squeeze(c), F.lit(n))


def _unicode_form(form: str):
    @F.pandas_udf(StringType())
    def convert(s: pd.Series) -> pd.Series:
        out = s.copy()
        used = s.notna()
        out[used] = [unicodedata.normalize(form, v) for v in s[used]]
        return out

    return convert


# Characters that are their own composed form and take no part in composing others.
_NFC_STABLE = r"\x{0000}-\x{02FF}\x{0400}-\x{0482}\x{048A}-\x{04FF}"
_NFKC_STABLE = (
    r"\x{0000}-\x{009F}\x{00A1}-\x{00A7}\x{00A9}\x{00AB}-\x{00AE}\x{00B0}\x{00B1}\x{00B6}\x{00B7}\x{00BB}"
    r"\x{00BF}-\x{0131}\x{0134}-\x{013E}\x{0141}-\x{0148}\x{014A}-\x{017E}\x{0400}-\x{0482}\x{048A}-\x{04FF}"
)


def nfc(c) -> Column:
    """Canonical composition; Latin and Cyrillic rows without combining marks stay in the JVM."""
    c = _column(c)
    needs = c.rlike(f"[^{_NFC_STABLE}]")
    return F.when(needs, _unicode_form("NFC")(F.when(needs, c))).otherwise(c)


def nfkc(c) -> Column:
    """Compatibility composition; rows of stable Latin and Cyrillic letters stay in the JVM."""
    c = _column(c)
    needs = c.rlike(f"[^{_NFKC_STABLE}]")
    return F.when(needs, _unicode_form("NFKC")(F.when(needs, c))).otherwise(c)


def normalize_title(c) -> Column:
    """Lower case, letters, digits, + and # only. Expects composed text (see ``nfc``, applied once at intake)."""
    kept = F.regexp_replace(F.lower(text_or_blank(c)), r"[^\p{L}\p{N}+#\s]+", " ")
    return F.trim(F.regexp_replace(kept, r"\s+", " "))


def normalize_company(c) -> Column:
    """Company name without its legal forms; a name made only of them keeps its first token."""
    raw = text_or_blank(c)
    tokens = F.split(normalize_title(F.when(raw == fixed.BLANK_FIELD, "").otherwise(raw)), " ")
    named = F.filter(tokens, lambda t: (t != "") & ~t.isin(fixed.LEGAL_FORMS))
    return F.when(F.size(named) > 0, F.array_join(named, " ")).otherwise(F.element_at(tokens, 1))


def compose_text(title, company, location, description) -> Column:
    at = F.when(text_or_blank(company) != "", F.concat(F.lit(" at "), text_or_blank(company))).otherwise("")
    return F.trim(
        F.concat(text_or_blank(title), at, F.lit(". "), text_or_blank(location), F.lit(". "), text_or_blank(description))
    )


def _count_of(c: Column, letters: str) -> Column:
    return F.length(F.regexp_replace(c, f"[^{letters}]++", ""))  # what lies between is taken out a stretch at a time


def detect_lang(c) -> Column:
    """uk / ru / en. Cyrillic needs at least one letter in three; Russian-only letters weigh three times."""

    def judge(t: Column) -> Column:
        cyrillic = _count_of(t, fixed.CYRILLIC)
        latin = _count_of(t, "a-z")
        russian = _count_of(t, fixed.RUSSIAN_ONLY) * 3 > _count_of(t, fixed.UKRAINIAN_ONLY)
        return (
            F.when(~t.rlike(f"[{fixed.CYRILLIC}]"), "en")
            .when(cyrillic * 2 < latin, "en")
            .when(russian, "ru")
            .otherwise("uk")
        )

    return once(F.lower(text_or_blank(c)), judge)


def looks_like_job(c) -> Column:
    hay = F.lower(text_or_blank(c))
    found = F.lit(False)
    for signal in fixed.JOB_SIGNALS:
        found = found | hay.contains(signal)
    return found


def first_excluded_term(title, terms: list[str]) -> Column:
    """The first excluded whole word of the title, in list order; NULL when none."""
    t = F.lower(text_or_blank(title))
    hits = [
        F.when(t.rlike(rf"(^|[^\p{{L}}\p{{N}}]){re.escape(term.lower())}($|[^\p{{L}}\p{{N}}])"), F.lit(term))
        for term in terms
    ]
    return F.coalesce(*hits) if hits else F.lit(None).cast("string")


def iso_stamp(c, zone: str = "UTC") -> Column:
    """A stored date, strictly: starts with a real calendar day, or NULL. A bare day is that day's local midnight."""
    s = F.trim(text_or_blank(c))
    day = F.regexp_extract(s, r"^([0-9]{4}-[0-9]{2}-[0-9]{2})", 1)
    real = F.try_to_timestamp(day, F.lit("yyyy-MM-dd")).isNotNull() & (day != "")
    bare = F.to_utc_timestamp(F.try_to_timestamp(day, F.lit("yyyy-MM-dd")), zone)
    full = F.try_to_timestamp(s)
    return F.when(real & (F.length(s) == 10), bare).when(real, full)


def whole_number(c, fallback=None) -> Column:
    s = text_or_blank(c)
    return F.when(s.rlike(r"^[0-9]{1,18}$"), s.cast("bigint")).otherwise(F.lit(fallback).cast("bigint"))


def score_band(c) -> Column:
    c = _column(c)
    return F.when(c >= fixed.BAND_HIGH, "hi").when(c >= fixed.BAND_MID, "mid").otherwise("lo")


def of_each(one: Callable, *columns: pa.Array, rows: int = 64) -> pa.Array:
    """``one`` of the values of every row; null where the first is. Few rows at a time are held as Python values."""
    found = []
    for i in range(0, len(columns[0]), rows):
        values = zip(*(c.slice(i, rows).to_pylist() for c in columns))
        found.append(pa.array([None if v[0] is None else one(*v) for v in values], pa.string()))
    return pa.concat_arrays(found) if found else pa.array([], pa.string())


@F.arrow_udf(StringType())
def _without_tags(texts: pa.Array) -> pa.Array:
    return of_each(strip_block_tags, texts)


def strip_block_tags(text: str) -> str:
    """The text without data-block tags, also those that a removal puts together: one pass with a stack of kept parts.

    After a removal only the joint can hold a new tag, and it starts at the last "<" that is still open in front of it.
    """
    tag = re.compile(fixed.BLOCK_TAG)
    kept, rest = "", text
    while m := tag.search(rest):
        front = kept + rest[: m.start()]
        open_at = front.rfind("<")
        if open_at < 0:
            kept, rest = front, rest[m.end() :]
        else:
            kept, rest = front[:open_at], front[open_at:] + rest[m.end() :]
    return kept + rest


def sanitize_block(c, cap: int | None = None) -> Column:
    """Drop format characters, then the data-block tag until none is left; cut at ``cap`` only if one is given.

    Removing a tag can join the halves of another one. Two passes settle all but deliberately nested texts; those go
    through one scan each.
    """
    settled = _settled(_two_passes(c))
    return settled if cap is None else F.left(settled, F.lit(cap))


def _two_passes(c) -> Column:
    t = F.regexp_replace(text_or_blank(c), fixed.FORMAT_CHARS, "")
    for _ in range(2):
        t = F.regexp_replace(t, fixed.BLOCK_TAG, "")
    return t


def _settled(t: Column) -> Column:
    nested = t.rlike(fixed.BLOCK_TAG)
    return F.when(nested, _without_tags(F.when(nested, t))).otherwise(t)


def with_sanitized(df: DataFrame, column: str, out: str) -> DataFrame:
    """Adds ``out``, the ``sanitize_block`` of a column. The two passes are a column of their own, so they are made once a
    row and not again on each side of the Python step."""
    return df.withColumn(f"_{out}", _two_passes(column)).withColumn(out, _settled(F.col(f"_{out}"))).drop(f"_{out}")


def screening_block(title, company, location, text, cap: int | None = None, field_cap: int | None = None) -> Column:
    """The exact text an external scorer is shown; ``cap`` and ``field_cap`` cut the description and the fields."""

    def field(c):
        whole = squeeze(sanitize_block(c))
        return whole if field_cap is None else F.left(whole, F.lit(field_cap))

    return _block(field(title), field(company), field(location), sanitize_block(text, cap))


def _block(title: Column, company: Column, location: Column, text: Column) -> Column:
    unknown = lambda c: F.coalesce(F.nullif(c, F.lit("")), F.lit("unknown"))
    return F.concat(
        F.lit("Title: "), title, F.lit("\nCompany: "), unknown(company),
        F.lit("\nLocation: "), unknown(location), F.lit("\nDescription:\n"), text,
    )


def with_screening_block(df: DataFrame, out: str) -> DataFrame:
    """Adds ``out``, the ``screening_block`` of title, company, location and text; each is sanitized once a row."""
    for name in ("title", "company", "location", "text"):
        df = with_sanitized(df, name, f"_{out}_{name}")
    title, company, location, text = (F.col(f"_{out}_{name}") for name in ("title", "company", "location", "text"))
    block = _block(squeeze(title), squeeze(company), squeeze(location), text)
    return df.withColumn(out, block).drop(*(f"_{out}_{name}" for name in ("title", "company", "location", "text")))


# Substrings of lower-cased text, one of each group, without which a pattern cannot match: tested before it.
_MARKER_NEEDS = [
    [["ignore"], ["instruction"]], [["disregard"]], [["you", "act"], ["ai", "assistant", "language"]], [["system"], ["prompt"]], [["score"]], [["score"]], [["fit"]],
    [["інструкц", "инструкц", "правил"]], [["системн"]], [["оцінк", "оценк", "бал"]],
]


def injection_markers(c, unicode_fold: bool = True) -> Column:
    """Indexes of the patterns that address the screener, on the text as written or with look-alikes folded."""
    s = text_or_blank(c)
    if unicode_fold:
        s = nfkc(s)
    s = F.regexp_replace(F.regexp_replace(s, fixed.FORMAT_CHARS, ""), fixed.INVISIBLE_FILLERS, " ")
    s = F.regexp_replace(s, f"{WS}{{2,}}+|(?! ){WS}", " ")  # a single space stays as it is

    def possible(low: Column, groups: list[list[str]]) -> Column:
        found = F.lit(True)
        for group in groups:
            one = F.lit(False)
            for word in group:
                one = one | low.contains(word)
            found = found & one
        return found

    def hits(spellings: Column) -> Column:
        return F.array_compact(F.array(*[
            F.when(F.exists(spellings, lambda x: possible(x["low"], needs) & x["text"].rlike(p)), F.lit(i))
            for i, (p, needs) in enumerate(zip(fixed.INJECTION_PATTERNS, _MARKER_NEEDS))
        ]))

    with_lower = lambda x: F.struct(x.alias("text"), F.lower(x).alias("low"))
    folded = lambda x: F.array(x, F.translate(x, fixed.LOOKALIKE_FROM, fixed.LOOKALIKE_TO))
    both = once(s, lambda x: F.when(x.rlike(f"[{fixed.LOOKALIKE_FROM}]"), folded(x)).otherwise(F.array(x)))
    return once(F.transform(both, with_lower), hits)


def extract_salary(c) -> Column:
    """First money expression of the whole text: dashed range, worded range, ceiling, single value; NULL when none."""
    s = text_or_blank(c)
    found = [F.nullif(F.trim(F.regexp_extract(s, p, 0)), F.lit("")) for p in fixed.SALARY_PATTERNS]
    # A digit is needed by every pattern: texts without one skip all four scans.
    return F.when(s.rlike("[0-9]"), F.coalesce(*found))


def split_posting_title(c) -> Column:
    """struct(title, company, location) of "Role в Company, [legal form], [salary], city, city"."""
    raw = text_or_blank(c)
    has = raw.contains(" в ")
    title = F.when(has, F.trim(F.regexp_extract(raw, r"(?s)^(.*) в .*$", 1))).otherwise(raw)
    rest = F.regexp_extract(raw, r"(?s)^.* в (.*)$", 1)
    parts = F.filter(F.transform(F.split(rest, r",\s*"), lambda p: F.trim(p)), lambda p: p != "")
    legal = F.coalesce(F.try_element_at(parts, F.lit(2)), F.lit("")).rlike(fixed.LEGAL_FORM_TOKEN)
    first = F.coalesce(F.try_element_at(parts, F.lit(1)), F.lit(""))
    company = F.when(legal, F.concat(first, F.lit(", "), F.try_element_at(parts, F.lit(2)))).otherwise(first)
    places = F.filter(
        F.when(legal, F.slice(parts, 3, 1000000)).otherwise(F.slice(parts, 2, 1000000)),
        lambda p: ~p.rlike(fixed.SALARY_LIKE_PART),
    )
    return F.struct(
        title.alias("title"),
        F.when(has, company).otherwise("").alias("company"),
        F.when(has, F.array_join(places, ", ")).otherwise("").alias("location"),
    )
