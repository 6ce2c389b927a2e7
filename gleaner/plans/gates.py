"""Known-sets, the keyword gate, stamps, location."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner import fixed
from gleaner.functions.location import eligible, keeps_location, names_country
from gleaner.functions.text import first_excluded_term
from gleaner.functions.urls import link_key
from gleaner.operators import dedup, gate
from gleaner.operators.scoring import profile_scorer
from gleaner.plans import sqlviews as s
from gleaner.plans.registry import query
from gleaner.plans.resolve import GROUPS, MERGED_SQL, Resolution
from gleaner.plans.views import EXCLUDED_PLACES, EXCLUDED_TITLES, MIN_SCORE, NOW, PROFILE, Tables, shown, stamp
from gleaner.session import cut_lineage


def live(t: Tables) -> DataFrame:
    return gate.live_seen(t.seen, stamp(NOW))


def gated(t: Tables) -> DataFrame:
    return gate.keyword_gate(t.keys, t.texts, live(t), t.packages, profile_scorer(PROFILE), EXCLUDED_TITLES, MIN_SCORE)


_LEGACY = "trim(regexp_replace(regexp_replace(id, '[+#]+', ' ', 'g'), '\\s+', ' ', 'g'))"


@query("joi_01_seen_semi", s.sql(f"SELECT seq FROM keyed WHERE id IN (SELECT key FROM live_seen) OR {_LEGACY} IN (SELECT key FROM live_seen)", "keyed", "live_seen"))
def seen_semi(t: Tables) -> DataFrame:
    return gate.seen_postings(t.keys, live(t))


@query("joi_01_unseen_anti", s.sql(f"SELECT source, count(*) AS unseen FROM keyed WHERE id NOT IN (SELECT key FROM live_seen) AND {_LEGACY} NOT IN (SELECT key FROM live_seen) GROUP BY source", "keyed", "live_seen"))
def unseen(t: Tables) -> DataFrame:
    left = t.keys.join(gate.seen_postings(t.keys, live(t)), "seq", "left_anti")
    return left.groupBy("source").agg(F.count(F.lit(1)).alias("unseen"))


@query("joi_02_same_package", s.sql("""
SELECT j.seq, arg_min(p.file, p.seq) AS same_file FROM keyed j JOIN packages p ON p.canonical = j.canonical AND p.source = j.source AND p.url = j.url AND NOT p.archived GROUP BY j.seq""", "keyed", "packages"))
def same_package(t: Tables) -> DataFrame:
    return gate.same_package(gate.posting_copies(t.keys), t.packages)


@query("joi_03_package_by_link", s.sql("SELECT j.seq, l.file AS link_file FROM keyed j JOIN package_links l ON l.link = j.link WHERE j.link <> ''", "keyed", "package_links"))
def package_by_link(t: Tables) -> DataFrame:
    return gate.by_link(t.keys, gate.package_links(t.packages))


@query("joi_04_other_board", s.sql("""
SELECT j.seq, arg_min(p.file, p.seq) AS other_file FROM keyed j JOIN packages p ON p.canonical = j.canonical AND p.source <> j.source AND NOT p.archived GROUP BY j.seq""", "keyed", "packages"))
def other_board(t: Tables) -> DataFrame:
    return gate.other_board_package(gate.posting_copies(t.keys), t.packages)


def listing_postings(t: Tables) -> DataFrame:
    return t.listings.withColumn("link", link_key(F.col("url")))


@query("joi_05_reposts", s.sql("""
SELECT b.seq, b.best.file AS repost_file, b.best.url AS repost_url, b.best.reposts + 1 AS reposts FROM (
  SELECT j.seq, j.canonical, arg_max(struct_pack(file := p.file, url := p.url, source := p.source, generated := p.generated, reposts := p.reposts), struct_pack(g := p.generated, n := -p.seq)) AS best
  FROM listings j JOIN listings p ON p.canonical = j.canonical AND p.source = j.source AND p.closed AND p.url <> j.url GROUP BY 1, 2) b
WHERE NOT EXISTS (SELECT 1 FROM listings p WHERE p.canonical = b.canonical AND p.source = b.best.source AND NOT p.closed AND p.generated > b.best.generated)""", "listings"))
def reposts(t: Tables) -> DataFrame:
    p = listing_postings(t)
    return gate.reposts(p, p)


@query("scr_07_keyword_gate", s.sql("SELECT seq, kind, considered, retry, CASE WHEN early IS NULL THEN score END AS score, repost_file FROM gated", "gated"))
def keyword_gate(t: Tables) -> DataFrame:
    return gated(t).select("seq", "kind", "considered", "retry", "score", "repost_file")


@query("agg_01_run_summary", s.sql("""
SELECT source, count(*) AS found, count(*) FILTER (kind = 'excluded') AS excluded, count(*) FILTER (kind IN ('seen', 'packaged', 'dup')) AS seen,
  count(*) FILTER (kind = 'low') AS low, 0::BIGINT AS borderline, count(*) FILTER (kind = 'match') AS written FROM gated GROUP BY source""", "gated"))
def summary(t: Tables) -> DataFrame:
    outcomes = gate.run_outcomes(gated(t)).select("source", F.when(F.col("outcome") == "match", "written").otherwise(F.col("outcome")).alias("outcome"))
    return gate.run_summary(t.keys, outcomes)


@query("scr_08_judge_once", s.sql("""
SELECT seq, id, CASE WHEN row_number() OVER (PARTITION BY id ORDER BY retry::INT, seq) = 1 THEN 'judged' ELSE 'seen' END AS outcome, count(*) OVER (PARTITION BY id) AS same
FROM gated WHERE kind = 'match'""", "gated"))
def judge_once(t: Tables) -> DataFrame:
    return gate.judge_once(gated(t).filter("kind = 'match'")).select("seq", "id", "outcome", "same")


_ORDERED = "SELECT *, row_number() OVER (PARTITION BY id ORDER BY retry::INT, seq) AS r FROM gated WHERE kind = 'match'"


@query("scr_08_carried", s.sql(f"""
SELECT j.seq AS judged_seq, o.seq, o.source AS alt_source, o.url AS alt_url, CASE WHEN o.canonical <> j.canonical THEN o.canonical END AS merged_key,
  CASE WHEN o.title <> j.title THEN o.title END AS merged_title, CASE WHEN o.link <> '' AND o.link <> j.link THEN 'repost:' || o.link END AS marker
FROM ({_ORDERED}) o JOIN ({_ORDERED}) j ON j.id = o.id AND j.r = 1 WHERE o.r > 1""", "gated"))
def carry(t: Tables) -> DataFrame:
    return gate.carried(gate.judge_once(gated(t).filter("kind = 'match'")))


@query("scr_11_stamp_keys", s.sql("""
SELECT DISTINCT key FROM (SELECT id AS key FROM gated UNION ALL SELECT 'repost:' || link FROM gated WHERE link <> '' AND (repost_file IS NOT NULL OR 'repost:' || link IN (SELECT key FROM live_seen)))""", "gated", "live_seen"))
def stamps(t: Tables) -> DataFrame:
    return gate.stamp_keys(gated(t), live(t))


@query("stm_01_seen_upsert", s.sql(f"""
SELECT key, {s.shown('max(last_seen)')} AS last_seen FROM (SELECT key, last_seen FROM live_seen UNION ALL SELECT id, TIMESTAMP '{NOW}' FROM keyed WHERE seq % 3 = 0) GROUP BY key""", "live_seen", "keyed"))
def upsert(t: Tables) -> DataFrame:
    keys = t.keys.filter("seq % 3 = 0").select(F.col("id").alias("key")).distinct()
    return gate.upsert_seen(live(t), keys, stamp(NOW)).select("key", shown("last_seen").alias("last_seen"))


@query("stm_02_first_time", s.sql("SELECT seq, 'repost:' || link NOT IN (SELECT key FROM live_seen) AS first_time FROM keyed", "keyed", "live_seen"))
def first_time(t: Tables) -> DataFrame:
    ids = t.keys.select("seq", F.col("link").alias("id"))
    return gate.first_time(ids, live(t), "repost:").select("seq", "first_time")


# ---- location -----------------------------------------------------------------

_PARTS = f"list_filter(list_transform(string_split(location, ' · '), lambda x: trim(x)), lambda x: x <> '' AND NOT regexp_matches(lower(x), {s.lit(fixed.FORMAT_WORDS)}))"
_SEG = f"CASE WHEN len({_PARTS}) = 0 OR regexp_matches(lower({_PARTS}[1]), {s.lit(fixed.NOT_A_COUNTRY_WORDS)}) THEN '' ELSE lower({_PARTS}[1]) END"
_NAMES = f"({_SEG} LIKE '%ukraine%' OR {_SEG} LIKE '%україна%')"
_ELIGIBLE = f"({_SEG} = '' OR regexp_matches({_SEG}, {s.lit(fixed.WORLDWIDE_WORDS)}) OR {_NAMES})"
_BANNED = "regexp_matches({}, 'poland|germany')"
_OFFICE = f"len(list_filter(string_split(lower(location), ','), lambda x: regexp_matches(x, {s.lit(fixed.REMOTE_WORDS)}) OR (NOT contains(x, '(') AND NOT {_BANNED.format('x')}))) > 0"
_KEEP = f"CASE WHEN board IN ('djinni', 'himalayas', 'tgchannels') THEN {_ELIGIBLE} ELSE NOT {_BANNED.format('lower(location)')} OR (board = 'dou' AND {_OFFICE}) END"


@query("fil_01_location_filter", s.sql(f"SELECT seq, {_KEEP} AS kept FROM postings", "postings"))
def location_filter(t: Tables) -> DataFrame:
    return t.postings.select("seq", keeps_location("board", "location", EXCLUDED_PLACES).alias("kept"))


@query("set_04_kept_and_dropped", s.sql(f"SELECT board, location, {_KEEP} AS kept, count(*) AS n FROM postings GROUP BY ALL", "postings"))
def kept_and_dropped(t: Tables) -> DataFrame:
    kept = keeps_location("board", "location", EXCLUDED_PLACES)
    return t.postings.groupBy("board", "location", kept.alias("kept")).agg(F.count(F.lit(1)).alias("n"))


@query("str_24_countries", s.sql(
    f"SELECT seq, {_NAMES} AS names, {_ELIGIBLE} AS eligible FROM postings", "postings"))
def countries(t: Tables) -> DataFrame:
    c = fixed.CANDIDATE_COUNTRY
    return t.postings.select("seq", names_country("location", c).alias("names"), eligible("location", c).alias("eligible"))


@query("fil_07_known_before_fetch", s.sql(f"""
SELECT k.seq, NOT ({_KEEP}) OR ((id IN (SELECT key FROM live_seen) OR {_LEGACY} IN (SELECT key FROM live_seen) OR {s.excluded_term('title')} IS NOT NULL) AND f.seq IS NULL) AS known
FROM keyed k LEFT JOIN fresh f USING (seq)""".replace("SELECT k.seq, NOT", "SELECT seq, NOT"), "keyed", "fresh", "live_seen"))
def known(t: Tables) -> DataFrame:
    fresh = gate.fresh_reposts(t.keys, gate.reposts(t.keys, t.packages), live(t))
    keeps = keeps_location("board", "location", EXCLUDED_PLACES)
    return gate.known_before_fetch(t.keys, keeps, live(t), fresh, EXCLUDED_TITLES).select("seq", "known")


@query("fil_08_short_text", f"SELECT doc_id AS seq, length(text) < {fixed.SHORT_TEXT} AS retry FROM documents")
def short_text(t: Tables) -> DataFrame:
    return t.table("documents").select(F.col("doc_id").alias("seq"), (F.length("text") < fixed.SHORT_TEXT).alias("retry"))


@query("str_07_excluded_title", s.sql(f"SELECT seq, {s.excluded_term('title')} AS term FROM postings", "postings"))
def excluded_title(t: Tables) -> DataFrame:
    return t.postings.select("seq", first_excluded_term("title", EXCLUDED_TITLES).alias("term"))


@query("set_01_union_of_sources", s.sql("""
SELECT source, count(*) AS n, count(posted) AS posted, count(updated) AS updated FROM (
  SELECT board AS source, posted, NULL::TIMESTAMP AS updated FROM postings WHERE board = 'dou'
  UNION ALL SELECT board, NULL, updated FROM postings WHERE board = 'himalayas'
  UNION ALL SELECT board, posted, NULL FROM postings WHERE board NOT IN ('dou', 'himalayas')) GROUP BY source""", "postings"))
def union_of_sources(t: Tables) -> DataFrame:
    """Readers with different date columns become one shape."""
    p = t.postings.withColumn("source", F.col("board"))
    dou = p.filter("board = 'dou'").select("seq", "source", "posted")
    api = p.filter("board = 'himalayas'").select("seq", "source", "updated")
    rest = p.filter("board NOT IN ('dou', 'himalayas')").select("seq", "source", "posted")
    every = dou.unionByName(api, allowMissingColumns=True).unionByName(rest, allowMissingColumns=True)
    return every.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.count("posted").alias("posted"), F.count("updated").alias("updated"))


# ---- a whole run: resolve, then decide ---------------------------------------------------

_RUN = {
    "copies": """SELECT p.keeper_seq, p.seq, c.source AS alt_source, c.url AS alt_url, CASE WHEN c.id <> k.id THEN c.id END AS merged_id,
      CASE WHEN c.title_norm <> k.title_norm THEN c.title END AS merged_title, CASE WHEN c.canonical <> k.canonical THEN c.canonical END AS merged_key
      FROM plan p JOIN keyed c USING (seq) JOIN keyed k ON k.seq = p.keeper_seq WHERE p.role = 'copy'""",
    "richest": MERGED_SQL["richest"],
    "keepers": """SELECT k.* EXCLUDE (text), CASE WHEN rich_seq = k.seq AND long_len > rich_len THEN l.text ELSE k.text END AS text
      FROM plan p JOIN keyed k USING (seq) JOIN richest USING (component) JOIN longest USING (component) JOIN keyed l ON l.seq = long_seq WHERE p.role = 'keeper'""",
    "lookups": """SELECT seq, -1 AS pos, canonical AS key, source, url, link FROM keepers
      UNION ALL SELECT c.keeper_seq, c.seq, c.merged_key, c.alt_source, c.alt_url, k.link FROM copies c JOIN keepers k ON k.seq = c.keeper_seq WHERE c.merged_key IS NOT NULL""",
    "hits": """SELECT j.seq, arg_max(struct_pack(file := p.file, source := p.source, generated := p.generated), struct_pack(g := p.generated, o := -j.pos, n := -p.seq)) AS best
      FROM lookups j JOIN packages p ON p.canonical = j.key AND p.source = j.source AND p.closed AND p.url <> j.url AND p.link <> j.link GROUP BY j.seq""",
    "fresh": """SELECT h.seq, h.best.file AS repost_file FROM hits h JOIN keepers k USING (seq) WHERE k.link <> '' AND 'repost:' || k.link NOT IN (SELECT key FROM live_seen)
      AND NOT EXISTS (SELECT 1 FROM lookups j JOIN packages p ON p.canonical = j.key AND p.source = h.best.source AND NOT p.closed AND p.generated > h.best.generated WHERE j.seq = h.seq)""",
    "ids": f"""SELECT seq, id FROM keepers UNION SELECT keeper_seq, merged_id FROM copies WHERE merged_id IS NOT NULL""",
    "known": f"""SELECT DISTINCT seq FROM ids WHERE id IN (SELECT key FROM live_seen) OR {_LEGACY} IN (SELECT key FROM live_seen)""",
    "judged": s.scored("(SELECT *, lower(text) AS hay FROM keepers)"),
    "decided": f"""SELECT j.seq, j.score, f.repost_file, length(j.text) < {fixed.SHORT_TEXT} AS short, CASE
      WHEN f.seq IS NULL AND j.seq IN (SELECT seq FROM known) THEN 'seen'
      WHEN EXISTS (SELECT 1 FROM lookups l JOIN packages p ON p.canonical = l.key AND p.source = l.source AND p.url = l.url AND NOT p.archived WHERE l.seq = j.seq) THEN 'packaged'
      WHEN j.link <> '' AND j.link IN (SELECT link FROM package_links) THEN 'packaged'
      WHEN EXISTS (SELECT 1 FROM lookups l JOIN packages p ON p.canonical = l.key AND p.source <> l.source AND NOT p.archived WHERE l.seq = j.seq) THEN 'dup'
      WHEN {s.excluded_term('j.title')} IS NOT NULL OR EXISTS (SELECT 1 FROM copies c WHERE c.keeper_seq = j.seq AND {s.excluded_term('c.merged_title')} IS NOT NULL) THEN 'excluded' END AS early
      FROM judged j LEFT JOIN fresh f USING (seq)""",
}


@query("scr_07_gate_after_resolution", s.sql(f"""
SELECT seq, CASE WHEN early IS NOT NULL THEN early WHEN score < {MIN_SCORE} THEN 'low' ELSE 'match' END AS kind, CASE WHEN early IS NULL THEN score END AS score, early IS NULL AND short AS retry, repost_file
FROM decided""", "keyed", "packages", "package_links", "live_seen", recursive=GROUPS, **_RUN))
def gate_after_resolution(t: Tables) -> DataFrame:
    """Resolution, then the gate over the keepers, with everything their folded copies bring along."""
    r = Resolution(t)
    copies = cut_lineage(dedup.folded_copies(r.keyed, r.plan))
    keepers = cut_lineage(r.keyed.join(r.plan.filter("role = 'keeper'").select("seq"), "seq"))
    texts = dedup.merged_postings(r.grouped, r.plan, t.texts).select("seq", "text")
    out = gate.keyword_gate(keepers, texts, live(t), t.packages, profile_scorer(PROFILE), EXCLUDED_TITLES, MIN_SCORE, copies=copies)
    return out.select("seq", "kind", "score", "retry", "repost_file")
