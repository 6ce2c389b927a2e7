"""Identity of a posting: the strict key for the seen store, the loose key for matching across boards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner import fixed
from gleaner.functions.text import nfc, normalize_company, normalize_title
from gleaner.functions.urls import link_key, url_key


def identity_key(title, company, url) -> Column:
    named = F.nullif(normalize_company(company), F.lit(""))
    return F.concat(F.coalesce(named, url_key(url)), F.lit("::"), normalize_title(title))


def legacy_spelling(key) -> Column:
    """The older spelling of a key, without + and #."""
    key = F.col(key) if isinstance(key, str) else key
    return F.trim(F.regexp_replace(F.regexp_replace(key, r"[+#]+", " "), r"\s+", " "))


def canonical_key(title, company, url) -> Column:
    """First company token :: the distinct title tokens in order, requisition numbers dropped, aliases expanded."""
    t = normalize_title(title)
    for phrase, short in fixed.TITLE_PHRASES:
        t = F.regexp_replace(t, rf"(?<![a-z0-9_]){phrase}(?![a-z0-9_])", short)
    tokens = F.filter(F.split(t, " "), lambda w: (w != "") & ~w.rlike(fixed.REQUISITION_TOKEN))
    for alias, words in fixed.TITLE_ALIASES.items():
        expansion = F.array(*[F.lit(w) for w in words])
        tokens = F.flatten(F.transform(tokens, lambda w: F.when(w == alias, expansion).otherwise(F.array(w))))
    first = F.nullif(F.split_part(normalize_company(company), F.lit(" "), F.lit(1)), F.lit(""))
    return F.concat(
        F.coalesce(first, url_key(url)), F.lit("::"), F.array_join(F.array_sort(F.array_distinct(tokens)), " ")
    )


def compose_unicode(postings: DataFrame, columns=("title", "company")) -> DataFrame:
    """Composed text, once, at intake: every key below relies on it."""
    return postings.withColumns({c: nfc(c) for c in columns})


def with_chars(postings: DataFrame) -> DataFrame:
    """Adds chars, the text length: what the resolution needs to know of a text."""
    return postings.withColumn("chars", F.length(F.coalesce("text", F.lit(""))))


def with_keys(postings: DataFrame) -> DataFrame:
    """Adds id, canonical, link and title_norm.

    The keys are never NULL and say so: joins on them then need no NULL filter, which the optimizer would
    otherwise push below the projection together with a second copy of the whole key expression.
    """
    never_null = lambda c: F.coalesce(c, F.lit(""))
    return postings.withColumns({
        "id": never_null(identity_key("title", "company", F.col("url"))),
        "canonical": never_null(canonical_key("title", "company", F.col("url"))),
        "link": never_null(link_key(F.col("url"))),
        "title_norm": never_null(normalize_title("title")),
    })
