"""Dashboard data: collapsed cards, order, tabs, facets, marks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner import fixed
from gleaner.functions.location import names_country
from gleaner.functions.text import text_or_blank
from gleaner.operators.skew import first_rows, ranked


def collapse_latest(packages: DataFrame) -> DataFrame:
    """The latest package per identity, the first one on a tie."""
    return first_rows(packages, ["id"], [F.col("generated").desc_nulls_last(), F.col("seq")])


def card_order() -> list[Column]:
    """Verdict first, then keyword score, then arrival."""
    return [F.col("llm_score").desc_nulls_last(), F.col("score").desc(), F.col("seq")]


def placed(cards: DataFrame, span: int = 1 << 16) -> DataFrame:
    """Every card with its place in the order: numbered inside chunks of one verdict, score and range of ``span`` arrivals.

    Only the chunks' sizes meet in one task, never the cards, so a score that a third of them share stays spread.
    """
    chunk = F.struct(F.coalesce(-F.col("llm_score"), F.lit(1)).alias("a"), (-F.col("score")).alias("b"), F.floor(F.col("seq") / span).alias("c"))
    return ranked(cards, [], chunk, [F.col("seq")], "place")


def tab_of() -> Column:
    """An unseen borderline card waits under its own tab."""
    return F.when((F.col("tier") == "borderline") & (F.col("status") == "new"), "borderline").otherwise(F.col("status"))


def card_matches(statuses: list[str], sources: list[str], query: str) -> Column:
    """Source, search and tab together; nothing selected means all; an open card stays under any tab."""
    found = F.lit(True)
    if sources:
        found = found & F.col("source").isin(sources)
    if query:
        found = found & F.col("search").contains(query.lower())
    if statuses:
        found = found & (tab_of().isin(statuses) | F.coalesce("details_open", F.lit(False)))
    return found


def tab_counts(cards: DataFrame) -> DataFrame:
    return cards.groupBy(tab_of().alias("tab")).agg(F.count(F.lit(1)).alias("cards"))


def facet_sources(cards: DataFrame, statuses: list[str]) -> DataFrame:
    """Boards with a card under the tabs alone."""
    return cards.filter(card_matches(statuses, [], "")).select("source").distinct()


def visited_up_to(visits: DataFrame, shown: DataFrame, now: Column) -> DataFrame:
    """(viewer, visited): the newest card shown, never from the future, never backwards.

    visits: viewer, stored. shown: viewer, generated.
    """
    limit = now + F.make_interval(mins=F.lit(fixed.FUTURE_SLACK_MINUTES))
    newest = shown.filter(F.col("generated") <= limit).groupBy("viewer").agg(F.max("generated").alias("newest"))
    kept = F.when(F.col("stored") <= limit, F.col("stored"))
    epoch = F.lit("1970-01-01 00:00:00").cast("timestamp")
    return visits.join(newest, "viewer", "full").select(
        "viewer", F.coalesce(F.greatest(kept, F.col("newest")), epoch).alias("visited")
    )


def is_new(generated, visited) -> Column:
    """No earlier visit means nothing is new."""
    return F.coalesce(F.col(generated) > F.col(visited), F.lit(False))


def card_marks(cards: DataFrame) -> DataFrame:
    """Adds unverified (no verdict while some card has one) and listed (a country-list board names the country)."""
    in_use = cards.agg(F.max(F.col("llm_score").isNotNull())).scalar()
    boards = [b[0] for b in fixed.BOARDS if b[2]]
    return cards.withColumns({
        "unverified": F.col("llm_score").isNull() & F.coalesce(in_use, F.lit(False)),
        "listed": F.col("source").isin(boards) & names_country("location", fixed.CANDIDATE_COUNTRY),
    })


def card_feed(packages: DataFrame) -> DataFrame:
    """Facet-ready card rows: collapsed, with tier, lower-cased search text and a JSON body."""
    cards = collapse_latest(packages).withColumns({
        "tier": F.when(F.col("tier") == "borderline", "borderline").otherwise("match"),
        "search": F.lower(F.concat_ws(" ", "title", "company", "location")),
    })
    fields = [c for c in ("source", "title", "company", "url", "location", "score", "llm_score", "tier", "generated") if c in cards.columns]
    return cards.withColumn("card", F.to_json(F.struct(*fields)))
