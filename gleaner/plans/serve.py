"""Card data for a dashboard."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.operators import cards as cd
from gleaner.operators import lifecycle as lc
from gleaner.plans import sqlviews as s
from gleaner.plans.registry import query
from gleaner.plans.views import NOW, Tables, shown, stamp

_COLLAPSED = "SELECT * FROM packages QUALIFY row_number() OVER (PARTITION BY id ORDER BY generated DESC, seq) = 1"
_CARDS = "SELECT l.*, coalesce(j.status, 'new') AS status FROM listings l LEFT JOIN job_state j ON j.url = l.url"


@query("win_01_collapse_latest", s.sql("SELECT seq, id FROM collapsed", "packages", collapsed=_COLLAPSED))
def collapse(t: Tables) -> DataFrame:
    return cd.collapse_latest(t.packages).select("seq", "id")


@query("srt_01_card_order", s.sql("SELECT seq, llm_score, score, row_number() OVER (ORDER BY llm_score DESC NULLS LAST, score DESC, seq) AS place FROM collapsed", "packages", collapsed=_COLLAPSED))
def order(t: Tables) -> DataFrame:
    """Every card with its place."""
    return cd.placed(cd.collapse_latest(t.packages)).select("seq", "llm_score", "score", "place")


@query("snk_08_card_feed", s.sql("""
SELECT seq, CASE WHEN tier = 'borderline' THEN 'borderline' ELSE 'match' END AS tier, lower(concat_ws(' ', title, company, location)) AS search, length(title) + length(url) AS shown FROM collapsed""", "packages", collapsed=_COLLAPSED))
def feed(t: Tables) -> DataFrame:
    cards = cd.card_feed(t.packages)
    shown_chars = F.length(F.get_json_object("card", "$.title")) + F.length(F.get_json_object("card", "$.url"))
    return cards.select("seq", "tier", "search", shown_chars.cast("bigint").alias("shown"))


def status_cards(t: Tables) -> DataFrame:
    return lc.with_status(t.listings, t.job_state)


@query("agg_10_tab_counts", s.sql("SELECT CASE WHEN tier = 'borderline' AND status = 'new' THEN 'borderline' ELSE status END AS tab, count(*) AS cards FROM cards GROUP BY 1", "listings", "job_state", cards=_CARDS))
def tabs(t: Tables) -> DataFrame:
    return cd.tab_counts(status_cards(t))


@query("agg_10_facets", s.sql("SELECT DISTINCT source FROM cards WHERE status = 'new' AND tier = 'borderline'", "listings", "job_state", cards=_CARDS))
def facets(t: Tables) -> DataFrame:
    return cd.facet_sources(status_cards(t).withColumn("details_open", F.lit(False)), ["borderline"])


@query("fil_06_card_filter", s.sql("""
SELECT seq FROM cards WHERE source IN ('dou', 'linkedin') AND contains(lower(url), '7') AND ((CASE WHEN tier = 'borderline' AND status = 'new' THEN 'borderline' ELSE status END) IN ('new', 'viewed') OR seq % 50 = 0)""", "listings", "job_state", cards=_CARDS))
def filtered(t: Tables) -> DataFrame:
    cards = status_cards(t).withColumns({"search": F.lower("url"), "details_open": F.col("seq") % 50 == 0})
    return cards.filter(cd.card_matches(["new", "viewed"], ["dou", "linkedin"], "7")).select("seq")


@query("agg_11_visited_up_to", s.sql(f"""
SELECT viewer, {s.shown("coalesce(greatest(CASE WHEN stored <= TIMESTAMP '2000-06-01 00:05:00' THEN stored END, newest), TIMESTAMP '1970-01-01')")} AS visited FROM (
  SELECT c_custkey AS viewer, CASE c_custkey % 4 WHEN 0 THEN NULL WHEN 1 THEN TIMESTAMP '2030-01-01' ELSE TIMESTAMP '1999-01-01' END AS stored, newest
  FROM customer LEFT JOIN (SELECT o_custkey, max(o_orderdate) AS newest FROM orders WHERE o_orderdate <= TIMESTAMP '2000-06-01 00:05:00' GROUP BY 1) ON o_custkey = c_custkey)"""))
def visited(t: Tables) -> DataFrame:
    k = F.col("c_custkey")
    visits = t.table("customer").select(k.alias("viewer"), F.when(k % 4 == 1, stamp("2030-01-01 00:00:00")).when(k % 4 != 0, stamp("1999-01-01 00:00:00")).alias("stored"))
    shown_cards = t.table("orders").select(F.col("o_custkey").alias("viewer"), F.col("o_orderdate").cast("timestamp").alias("generated"))
    return cd.visited_up_to(visits, shown_cards, stamp("2000-06-01 00:00:00")).select("viewer", shown("visited").alias("visited"))


@query("agg_11_is_new", s.sql("SELECT seq, coalesce(generated > CASE WHEN seq % 3 <> 0 THEN TIMESTAMP '2023-12-01' END, false) AS is_new FROM packages", "packages"))
def new_cards(t: Tables) -> DataFrame:
    visited_at = F.when(F.col("seq") % 3 != 0, stamp("2023-12-01 00:00:00"))
    return t.packages.withColumn("visited", visited_at).select("seq", cd.is_new("generated", "visited").alias("is_new"))


@query("win_08_card_marks", s.sql("SELECT seq, llm_score IS NULL AND (SELECT count(llm_score) FROM packages) > 0 AS unverified, board IN ('himalayas', 'tgchannels') AND location = 'Remote · Ukraine' AS listed FROM packages", "packages"))
def marks(t: Tables) -> DataFrame:
    return cd.card_marks(t.packages.withColumn("source", F.col("board"))).select("seq", "unverified", "listed")
