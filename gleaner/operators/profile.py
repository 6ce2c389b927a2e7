"""Term profiles: cleaning many raw profiles as a table, and compiling one into literal pattern columns."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleaner import fixed
from gleaner.functions.text import squeeze
from gleaner.operators.skew import first_rows


@dataclass(frozen=True)
class Profile:
    """One cleaned profile, as job parameters."""

    roles: list[str]
    skills: dict[str, int]
    synonyms: dict[str, list[str]] = field(default_factory=dict)
    penalties: dict[str, int] = field(default_factory=dict)
    max_skills: int = fixed.MAX_SKILLS
    relevant: int = fixed.THRESHOLD_RELEVANT
    maybe: int = fixed.THRESHOLD_MAYBE


# ---- many profiles as tables -------------------------------------------------
# raw terms: (profile_id, kind, pos, term, value, parent)   kind: role | skill | anti | synonym

def clean_terms(raw: DataFrame) -> DataFrame:
    """Lower, squeezed, cut to the kind's length; first spelling wins; the first N of a kind per profile stay.

    Weights keep their magnitude under the kind's own sign, clamped to its range. A value that is no
    weight drops the term but not its turn in the order; a synonym needs a skill that was kept.
    """
    lim = fixed.PROFILE_LIMITS
    by_kind = lambda i: F.expr(
        "CASE kind " + " ".join(f"WHEN '{k}' THEN {lim[k][i]}" for k in ("role", "skill", "anti", "synonym")) + " END"
    )
    term = F.left(F.lower(squeeze("term")), by_kind(1))
    size = F.abs(F.col("value").try_cast("double"))
    magnitude = F.floor(F.when(size.isNotNull(), F.least(size, F.lit(1e6))) + 0.5).cast("int")
    lo, hi = lim["weight"]
    anti_lo, anti_hi = lim["anti_weight"]
    weight = (
        F.when(F.col("kind") == "skill", F.least(F.lit(hi), F.greatest(F.lit(lo), magnitude)))
        .when(F.col("kind") == "anti", F.least(F.lit(anti_hi), F.greatest(F.lit(anti_lo), -magnitude)))
    )
    usable = F.col("kind").isin("role", "synonym") | (magnitude > 0)
    spelled = (
        raw.withColumn("term", term)
        .withColumn("parent", F.left(F.lower(squeeze("parent")), F.lit(lim["skill"][1])))
        .withColumn("weight", weight)
        .filter((F.length("term") >= 2) & F.coalesce(usable, F.lit(False)))
    )
    unique = first_rows(spelled, ["profile_id", "kind", "parent", "term"], [F.col("pos")])
    rank = F.row_number().over(Window.partitionBy("profile_id", "kind", "parent").orderBy("pos"))
    # The literal limit is the largest cap: each task keeps that many per group before the shuffle.
    most = max(lim[k][0] for k in ("role", "skill", "anti", "synonym"))
    capped = unique.withColumn("ord", rank).filter(F.col("ord") <= most).filter(F.col("ord") <= by_kind(0))
    main = capped.filter("kind <> 'synonym'")
    skills = main.filter("kind = 'skill'").select("profile_id", F.col("term").alias("parent"))
    synonyms = capped.filter("kind = 'synonym' AND term <> parent").join(skills, ["profile_id", "parent"], "left_semi")
    cols = ["profile_id", "kind", "parent", "ord", "term", "weight"]
    return main.select(*cols).unionByName(synonyms.select(*cols))


def clean_settings(raw: DataFrame) -> DataFrame:
    """(profile_id, max_skills, relevant, maybe): numbers clamped, anything else the default, maybe below relevant."""
    def number(name: str, lo: int, hi: int, default: int) -> Column:
        value = F.col(name).try_cast("double")
        clamped = F.floor(F.least(F.lit(float(hi)), F.greatest(F.lit(float(lo)), value)) + 0.5).cast("int")
        return F.when(value.isNotNull(), clamped).otherwise(default)  # least and greatest skip NULL

    lo, hi = fixed.PROFILE_LIMITS["max_skills"]
    out = raw.select(
        "profile_id",
        number("max_skills", lo, hi, fixed.MAX_SKILLS).alias("max_skills"),
        number("relevant", 2, 100, fixed.THRESHOLD_RELEVANT).alias("relevant"),
        number("maybe", 1, 100, fixed.THRESHOLD_MAYBE).alias("maybe"),
    )
    lowered = F.greatest(F.lit(1), F.col("relevant") - 1)
    return out.withColumn("maybe", F.when(F.col("maybe") >= F.col("relevant"), lowered).otherwise(F.col("maybe")))


def profile_issues(profiles: DataFrame, terms: DataFrame) -> DataFrame:
    """(profile_id, issues): no roles, fewer than five skills, no phrase. ``profiles``: profile_id, phrase."""
    counts = terms.groupBy("profile_id").agg(
        F.count_if(F.col("kind") == "role").alias("roles"), F.count_if(F.col("kind") == "skill").alias("skills"),
    )
    both = profiles.join(counts, "profile_id", "left").fillna(0, ["roles", "skills"])
    problems = F.array_compact(F.array(
        F.when(F.col("roles") == 0, "no roles"),
        F.when(F.col("skills") < 5, F.concat(F.lit("only "), F.col("skills").cast("string"), F.lit(" skills (need 5+)"))),
        F.when(squeeze("phrase") == "", "no English specialization phrase"),
    ))
    return both.select("profile_id", F.array_join(problems, "; ").alias("issues"))


# ---- one profile as patterns ---------------------------------------------------

_HAS_CYRILLIC = re.compile("[Ѐ-ӿ]")


def stem_cyrillic(word: str) -> str:
    """A Cyrillic word without one ending, longest ending first, never shorter than four letters."""
    w = word.lower()
    if _HAS_CYRILLIC.search(w):
        for ending in fixed.CYRILLIC_ENDINGS:
            if w.endswith(ending) and len(w) - len(ending) >= fixed.MIN_STEM:
                return w[: -len(ending)]
    return w


def stem_column(c) -> Column:
    """``stem_cyrillic`` over a table of terms."""
    w = F.lower(F.col(c) if isinstance(c, str) else c)
    stems = [
        F.when(w.endswith(e) & (F.length(w) >= len(e) + fixed.MIN_STEM), F.substring(w, F.lit(1), F.length(w) - len(e)))
        for e in fixed.CYRILLIC_ENDINGS
    ]
    return F.when(w.rlike(f"[{fixed.CYRILLIC}]"), F.coalesce(*stems, w)).otherwise(w)


def term_pattern(phrase: str) -> str:
    """Whole-word pattern of a term: spaces are flexible, "++" and "#" end no word, Cyrillic words match by stem."""
    words = phrase.strip().lower().split()
    cyrillic = bool(_HAS_CYRILLIC.search(phrase))
    letters = "a-z0-9" + (fixed.CYRILLIC if cyrillic else "")
    parts = []
    for w in words:
        part = re.escape(stem_cyrillic(w) if cyrillic else w)
        parts.append(part + (f"[{fixed.CYRILLIC}]*" if _HAS_CYRILLIC.search(w) else ""))
    body = r"\s+".join(parts)
    return rf"(?<![{letters}])(?:{body})(?![{letters}])(?!\+\+|#)"


_PLAIN_WORD = re.compile("[a-z0-9]+")


def is_plain_word(term: str) -> bool:
    return bool(_PLAIN_WORD.fullmatch(term.lower()))


def words_found(hay: Column, words: list[str]) -> Column:
    """The distinct plain words of the list that lower-cased text mentions, in one pass over the text.

    A plain word only matches where a whole run of letters and digits equals it, so two of them never
    compete for the same place and one alternation finds exactly what one pattern per word would.
    """
    listed = "|".join(sorted({w.lower() for w in words}, key=len, reverse=True))
    pattern = rf"(?<![a-z0-9])(?:{listed})(?![a-z0-9])(?!\+\+|#)"
    return F.array_distinct(F.regexp_extract_all(hay, F.lit(pattern), F.lit(0)))


def mentions(hay: Column, phrase: str) -> Column:
    """Does lower-cased text mention the term. A plain substring test of its longest word runs first: it is
    cheap and rejects most texts before the pattern is tried."""
    words = phrase.strip().lower().split()
    longest = max((stem_cyrillic(w) for w in words), key=len)
    return hay.contains(longest) & hay.rlike(term_pattern(phrase))
