"""Relevance of a text for a profile: first role, top-k skill weights, uncapped penalties, verdict."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner import fixed
from gleaner.functions.text import once, text_or_blank
from gleaner.operators.profile import Profile, is_plain_word, mentions, words_found

Scorer = Callable[[DataFrame], DataFrame]


def _hits(terms: list[tuple[str, Column, int]]) -> Column:
    """array<struct<term,weight>> of the terms found, in profile order."""
    if not terms:
        return F.array().cast("array<struct<term:string,weight:int>>")
    return F.array_compact(F.array(*[
        F.when(found, F.struct(F.lit(term).alias("term"), F.lit(weight).alias("weight")))
        for term, found, weight in terms
    ]))


def _total(weights: Column) -> Column:
    return F.aggregate(weights, F.lit(0), lambda acc, w: acc + w)


def relevance(text: Column, profile: Profile) -> Column:
    """struct(matched_role, matched_skills, penalties, points, score) of a text, as one expression.

    The profile becomes literal patterns: one pass finds all plain words, and phrases, Cyrillic and symbol
    terms take one test each. It is one expression so that a filter on a part of it (a minimum score), which
    the optimizer copies below the projection, costs one more evaluation and not one per term.
    """
    terms = [*profile.roles, *profile.skills, *profile.penalties, *[t for ts in profile.synonyms.values() for t in ts]]
    plain = sorted({t for t in terms if is_plain_word(t)})

    def read(hay: Column) -> Column:
        words = words_found(hay, plain) if plain else F.array().cast("array<string>")
        return F.struct(hay.alias("hay"), words.alias("words"))

    def find(x: Column) -> Column:
        def mentioned(term: str) -> Column:
            return F.array_contains(x["words"], term.lower()) if is_plain_word(term) else mentions(x["hay"], term)

        def concept(term: str) -> Column:
            found = mentioned(term)
            for synonym in profile.synonyms.get(term, []):
                found = found | mentioned(synonym)
            return found

        roles = [F.when(mentioned(role), F.lit(role)) for role in profile.roles]
        return F.struct(
            (F.coalesce(*roles) if roles else F.lit(None).cast("string")).alias("role"),
            _hits([(t, concept(t), w) for t, w in profile.skills.items()]).alias("skills"),
            _hits([(t, mentioned(t), w) for t, w in profile.penalties.items()]).alias("anti"),
        )

    def add_up(f: Column) -> Column:
        top = F.slice(F.reverse(F.array_sort(F.transform(f["skills"], lambda s: s["weight"]))), 1, profile.max_skills)
        bonus = F.when(f["role"].isNotNull(), fixed.ROLE_BONUS).otherwise(0)
        points, penalty = _total(top), _total(F.transform(f["anti"], lambda s: s["weight"]))
        return F.struct(
            f["role"].alias("matched_role"), F.transform(f["skills"], lambda s: s["term"]).alias("matched_skills"),
            F.transform(f["anti"], lambda s: s["term"]).alias("penalties"), points.alias("points"), (bonus + points + penalty).alias("score"),
        )

    return once(once(once(F.lower(text_or_blank(text)), read), find), add_up)


def score_text(df: DataFrame, profile: Profile, text: str = "text") -> DataFrame:
    """Adds matched_role, matched_skills, penalties, points, score, verdict."""
    parts = ["matched_role", "matched_skills", "penalties", "points", "score"]
    found = df.withColumn("_r", relevance(F.col(text), profile))
    return found.withColumns({p: F.col(f"_r.{p}") for p in parts}).drop("_r").withColumn(
        "verdict", verdict_of("score", profile.relevant, profile.maybe)
    )


def verdict_of(score: str, relevant: int, maybe: int) -> Column:
    return F.when(F.col(score) >= relevant, "relevant").when(F.col(score) >= maybe, "maybe").otherwise("ignore")


def profile_scorer(profile: Profile) -> Scorer:
    return lambda df: score_text(df, profile)
