"""Probing, closing, archiving, pruning and user state over orders and line items."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner import fixed
from gleaner.functions.dates import age_label, shown_date
from gleaner.functions.urls import board_of
from gleaner.operators import lifecycle as lc
from gleaner.operators import sinks
from gleaner.operators.sinks import package_part, package_store
from gleaner.plans import sqlviews as s
from gleaner.plans.registry import query
from gleaner.plans.views import ORDERS_NOW, Tables, shown, stamp
from gleaner.streaming.runs import run_folder

_NOW = f"TIMESTAMP '{ORDERS_NOW}'"


def now():
    return stamp(ORDERS_NOW)


@query("srt_04_probe_candidates", s.sql(f"""
SELECT *, probe_rank > 150 AS deferred FROM (SELECT l.seq, l.url, l.probe_board AS board,
  row_number() OVER (ORDER BY greatest(coalesce(p.checked_at, TIMESTAMP '1970-01-01'), coalesce(p.tried_at, TIMESTAMP '1970-01-01')), l.seq) AS probe_rank
FROM listings l LEFT JOIN job_state j ON j.url = l.url LEFT JOIN probes p ON p.url = l.url
WHERE l.probe_board IS NOT NULL AND (j.status IS NULL OR j.status = 'viewed')
  AND coalesce(p.checked_at, TIMESTAMP '1970-01-01') <= {_NOW} - INTERVAL 3 DAY AND coalesce(p.tried_at, TIMESTAMP '1970-01-01') <= {_NOW} - INTERVAL 1 DAY)""", "listings", "job_state", "probes"))
def candidates(t: Tables) -> DataFrame:
    return lc.probe_candidates(t.listings, t.job_state, t.probes, now(), 150).select("seq", "url", "board", "probe_rank", "deferred")


@query("srt_05_reprobe_list", s.sql(f"""
SELECT l.seq, l.url, l.probe_board AS board FROM listings l JOIN job_state j ON j.url = l.url JOIN probes p ON p.url = l.url
WHERE l.probe_board IS NOT NULL AND j.status = 'closed' AND p.gone_at <= {_NOW} - INTERVAL 1 DAY AND (p.tried_at IS NULL OR p.tried_at <= {_NOW} - INTERVAL 1 DAY)""", "listings", "job_state", "probes"))
def reprobes(t: Tables) -> DataFrame:
    return lc.reprobe_list(t.listings, t.job_state, t.probes, now())


_PLAN = f"""SELECT file, CASE WHEN tier = 'borderline' THEN CASE WHEN generated <= {_NOW} - INTERVAL 30 DAY THEN 'borderline' END
  WHEN status = 'closed' AND (updated_at IS NULL OR updated_at <= {_NOW} - INTERVAL 14 DAY) THEN 'closed'
  WHEN status = 'viewed' AND (updated_at IS NULL OR updated_at <= {_NOW} - INTERVAL 30 DAY) THEN 'viewed' END AS reason
  FROM listings l LEFT JOIN job_state j ON j.url = l.url"""


@query("srt_06_archive_plan", s.sql("SELECT * FROM plan WHERE reason IS NOT NULL", "listings", "job_state", plan=_PLAN))
def archive(t: Tables) -> DataFrame:
    return lc.archive_plan(t.listings, t.job_state, now())


@query("snk_05_mark_and_archive", s.sql(f"""
SELECT l.seq, l.archived OR p.reason IS NOT NULL AS archived, {s.shown(f"CASE WHEN p.reason IS NOT NULL THEN coalesce(l.closed_at, CASE WHEN j.status = 'closed' THEN coalesce(j.updated_at, {_NOW}) END) ELSE l.closed_at END")} AS closed_at
FROM listings l JOIN plan p USING (file) LEFT JOIN job_state j ON j.url = l.url""", "listings", "job_state", plan=_PLAN))
def mark(t: Tables) -> DataFrame:
    out = lc.mark_and_archive(t.listings, lc.archive_plan(t.listings, t.job_state, now()), t.job_state, now())
    return out.select("seq", "archived", shown("closed_at").alias("closed_at"))


_MARKED = f"CASE WHEN NOT l.archived AND p.reason IS NOT NULL THEN coalesce(l.closed_at, CASE WHEN j.status = 'closed' THEN coalesce(j.updated_at, {_NOW}) END) ELSE l.closed_at END"


@query("snk_05_archive_run", s.sql(f"""
SELECT l.seq, l.url, l.archived OR p.reason IS NOT NULL AS archived, {s.shown(_MARKED)} AS closed_at, CASE WHEN l.archived OR p.reason IS NOT NULL THEN 'archived/' ELSE 'live/' END || strftime(l.generated, '%Y-%m-01') AS part
FROM listings l JOIN plan p USING (file) LEFT JOIN job_state j ON j.url = l.url""", "listings", "job_state", plan=_PLAN))
def archive_run(t: Tables) -> DataFrame:
    """Packages written by month, then one archive run: the parts it changes are replaced in one step."""
    listed = t.listings.withColumn("day", F.trunc("generated", "month"))
    columns = ["seq", "file", "url", "generated", "tier", "closed_at", "archived", "day"]
    schema = "seq bigint, file string, url string, generated timestamp, tier string, closed_at timestamp, archived boolean, day date"
    store = package_store(t.spark, run_folder(t.spark, "packages"), schema)
    store.commit(append=listed.select(columns))
    sinks.archive_run(store, t.job_state, now())
    return store.read().select("seq", "url", "archived", shown("closed_at").alias("closed_at"), package_part().alias("part"))


@query("joi_06_closed_set", s.sql("""
SELECT l.file FROM listings l JOIN job_state j ON j.url = l.url WHERE NOT l.archived AND j.status = 'closed'
UNION ALL SELECT file FROM listings WHERE archived AND closed_at IS NOT NULL""", "listings", "job_state"))
def closed_set(t: Tables) -> DataFrame:
    return lc.closed_set(t.listings, t.job_state)


@query("joi_09_state_per_card", s.sql("SELECT l.seq, coalesce(j.status, 'new') AS status FROM listings l LEFT JOIN job_state j ON j.url = l.url", "listings", "job_state"))
def status(t: Tables) -> DataFrame:
    return lc.with_status(t.listings, t.job_state).select("seq", "status")


@query("joi_10_prunable", s.sql(f"""
SELECT url FROM job_state j WHERE note IS NULL AND (updated_at IS NULL OR updated_at < {_NOW} - INTERVAL 1 DAY)
  AND NOT EXISTS (SELECT 1 FROM listings l WHERE l.url = j.url AND NOT l.archived)""", "listings", "job_state"))
def prunable(t: Tables) -> DataFrame:
    return lc.prunable(t.job_state, t.listings.filter("NOT archived"), now()).select("url")


@query("set_03_live_and_archive", s.sql("SELECT source, count(*) AS packages, count(*) FILTER (archived) AS archived FROM listings GROUP BY source", "listings"))
def live_and_archive(t: Tables) -> DataFrame:
    live = t.listings.filter("NOT archived").select("source", F.lit(False).alias("archived"))
    past = t.listings.filter("archived").select("source", F.lit(True).alias("archived"))
    return live.unionByName(past).groupBy("source").agg(F.count(F.lit(1)).alias("packages"), F.count_if("archived").alias("archived"))


# ---- state ------------------------------------------------------------------------

def state_bodies(t: Tables) -> DataFrame:
    """JSON state stores, one per hundred orders: empty, virtual and unknown statuses among the entries."""
    key = F.col("o_orderkey")
    status = F.when(key % 5 == 0, "new").when(key % 5 == 1, "").when(key % 5 == 2, "starred").when(key % 5 == 3, "viewed")
    entry = F.concat(
        F.lit('"https://x.example/'), key.cast("string"), F.lit('":'),
        F.to_json(F.struct(status.alias("status"), F.when(key % 7 == 0, "mine").when(key % 7 == 1, "").alias("note"), F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("updatedAt"))),
    )
    each = t.table("orders").groupBy(F.floor(key / 100).alias("store")).agg(F.array_join(F.collect_list(entry), ",").alias("entries"))
    return each.select("store", F.concat(F.lit('{"_meta":{},'), "entries", F.lit("}")).alias("body"))


@query("src_28_state_rows", s.sql(f"""
SELECT 'https://x.example/' || o_orderkey AS url, status, note, {s.shown('o_orderdate')} AS updated FROM (
  SELECT *, CASE o_orderkey % 5 WHEN 2 THEN 'starred' WHEN 3 THEN 'viewed' END AS status, CASE WHEN o_orderkey % 7 = 0 THEN 'mine' END AS note FROM orders)
WHERE status IS NOT NULL OR note IS NOT NULL"""))
def state_rows(t: Tables) -> DataFrame:
    return lc.state_rows(state_bodies(t)).select("url", "status", "note", shown("updated_at").alias("updated"))


def patches(t: Tables) -> DataFrame:
    """Line items as edits of listings, in line order: set, clear, note, clear the note."""
    k = F.col("l_quantity").cast("int") % 6
    li = t.table("lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_partkey", "l_suppkey", F.col("l_shipdate").cast("timestamp").alias("at"))
    p = li.select(
        F.col("l_orderkey").alias("seq"), ((F.col("l_linenumber").cast("bigint") * 100_000_000 + F.col("l_partkey")) * 100_000_000 + F.col("l_suppkey") * 100 + F.col("l_quantity").cast("bigint")).alias("ord"),
        F.when(k == 0, "viewed").when(k == 1, "closed").when(k == 2, "new").alias("status"),
        F.when(k == 3, "note").when(k == 4, "").when(k == 0, "n").alias("note"), "at",
    )
    return p.join(t.listings.select("seq", "url"), "seq").drop("seq")


_PATCHES = """SELECT url, (l_linenumber::BIGINT * 100000000 + l_partkey) * 100000000 + l_suppkey * 100 + l_quantity::BIGINT AS ord, l_shipdate AS stamp,
  CASE l_quantity::INT % 6 WHEN 0 THEN 'viewed' WHEN 1 THEN 'closed' WHEN 2 THEN 'new' END AS status, CASE l_quantity::INT % 6 WHEN 3 THEN 'note' WHEN 4 THEN '' WHEN 0 THEN 'n' END AS note
  FROM lineitem JOIN listings ON seq = l_orderkey"""
_MERGED = """SELECT url, CASE WHEN p.s IS NULL THEN j.status WHEN p.s <> 'new' THEN p.s END AS status, nullif(coalesce(p.n, j.note), '') AS note, p.url IS NOT NULL AS patched
  FROM job_state j FULL JOIN (SELECT url, arg_max(status, ord) FILTER (status IS NOT NULL) AS s, arg_max(note, ord) FILTER (note IS NOT NULL) AS n FROM patches GROUP BY url) p USING (url)"""


@query("snk_04_merge_state", s.sql("SELECT * FROM merged WHERE status IS NOT NULL OR note IS NOT NULL", "listings", "job_state", patches=_PATCHES,
                                   merged=_MERGED.replace("p.url IS NOT NULL AS patched", "p.k IS NOT NULL AS patched").replace("SELECT url, arg_max", "SELECT url, 1 AS k, arg_max")))
def merge(t: Tables) -> DataFrame:
    merged = lc.merge_state(t.job_state, patches(t).select("url", "ord", "status", "note"), stamp("2030-01-01 00:00:00"))
    return merged.select("url", "status", "note", F.coalesce(F.col("updated_at") == stamp("2030-01-01 00:00:00"), F.lit(False)).alias("patched"))


@query("stm_12_offline_patches", s.sql("""
SELECT url, ord, CASE WHEN has_status AND (status IS NULL OR status IN ('viewed', 'closed')) THEN coalesce(status, 'new') END AS status, CASE WHEN has_note THEN coalesce(note, '') END AS note FROM (
  SELECT l.url, l.seq AS ord, l.seq % 3 <> 0 AS has_note, l.seq % 3 <> 1 AS has_status, CASE WHEN l.seq % 19 = 0 THEN 'starred' ELSE j.status END AS status, j.note
  FROM listings l LEFT JOIN job_state j ON j.url = l.url WHERE l.seq % 2 = 0)""", "listings", "job_state"))
def offline(t: Tables) -> DataFrame:
    """Even listings were edited offline; some hold a status this build does not know."""
    local = lc.with_status(t.listings, t.job_state).join(t.job_state.select("url", "note"), "url", "left").select(
        "url", F.when(F.col("seq") % 19 == 0, "starred").when(F.col("status") != "new", F.col("status")).alias("status"), "note"
    )
    fields = F.when(F.col("seq") % 3 == 0, F.array(F.lit("status"))).when(F.col("seq") % 3 == 1, F.array(F.lit("note"))).otherwise(F.array(F.lit("note"), F.lit("status")))
    edited = t.listings.filter("seq % 2 = 0").select("url", F.col("seq").alias("ord"), fields.alias("fields"))
    return lc.offline_patches(local, edited)


@query("fil_05_valid_patch", """
SELECT o_orderkey AS seq, status_ok AND note_ok AND stamp_ok AS valid FROM (
  SELECT o_orderkey, o_orderkey % 4 <> 3 AS status_ok, o_orderkey % 10 <> 0 AS note_ok, o_orderdate <= TIMESTAMP '2000-06-01 00:05:00' AS stamp_ok FROM orders)""")
def valid(t: Tables) -> DataFrame:
    key = F.col("o_orderkey")
    status = F.element_at(F.array(F.lit("viewed"), F.lit("closed"), F.lit("new"), F.lit("applied")), (key % 4 + 1).cast("int"))
    note = F.when(key % 10 == 0, F.repeat(F.lit("x"), fixed.NOTE_MAX + 1)).when(key % 10 == 1, "short")
    p = t.table("orders").select(key.alias("seq"), status.alias("status"), note.alias("note"), F.col("o_orderdate").cast("timestamp").alias("at"), now().alias("now"))
    return p.select("seq", lc.valid_patch().alias("valid"))


@query("stm_11_closures", s.sql("""
SELECT url FROM listings l LEFT JOIN job_state j USING (url) WHERE l.seq % 3 = 0 AND (j.status IS NULL OR j.status = 'viewed')""", "listings", "job_state"))
def closures(t: Tables) -> DataFrame:
    found = t.listings.filter("seq % 3 = 0").select("url")
    return lc.closures(found, t.job_state)


_LOOKS = """SELECT url, probe_board, updated_at, status, generated + INTERVAL 20 DAY AS gone, [200, 404, 410, 503][1 + seq % 4] AS code, seq % 3 = 0 AS marked FROM listings JOIN job_state USING (url) WHERE probe_board IS NOT NULL"""


def second_looks(t: Tables) -> DataFrame:
    """Probe answers: three status classes, the board's closed marker on every third page."""
    markers = {
        "dou": '<div class="l-vacancy __inactive">', "djinni": '<div class="alert alert-x"> <div> Ця вакансія зараз неактивна',
        "linkedin": '<figure class="closed-job x"> No longer accepting applications',
    }
    html = F.lit("No longer accepting applications")
    for board, marker in markers.items():
        html = F.when((F.col("source") == board) & (F.col("seq") % 3 == 0), marker).otherwise(html)
    on_board = t.listings.withColumn("source", board_of("source", F.col("url"))).filter("source IS NOT NULL")
    return on_board.select(
        "seq", "url", "source", F.element_at(F.array(*map(F.lit, [200, 404, 410, 503])), (F.col("seq") % 4 + 1).cast("int")).alias("status_code"),
        html.alias("html"), (F.col("generated") + F.expr("INTERVAL 20 DAY")).alias("gone_at"),
    )


@query("str_34_is_closed", s.sql("SELECT seq, CASE seq % 4 WHEN 1 THEN true WHEN 2 THEN true WHEN 3 THEN false ELSE seq % 3 = 0 END AS closed FROM listings WHERE probe_board IS NOT NULL", "listings"))
def is_closed(t: Tables) -> DataFrame:
    return second_looks(t).select("seq", lc.is_closed("source", "status_code", "html").alias("closed"))


@query("stm_11_reopenings", s.sql("SELECT url FROM looks WHERE code = 200 AND NOT marked AND status = 'closed' AND NOT coalesce(updated_at > gone + INTERVAL 1 MINUTE, false)", "listings", "job_state", looks=_LOOKS))
def reopenings(t: Tables) -> DataFrame:
    return lc.reopenings(second_looks(t), t.job_state)


@query("str_27_age_label", """
SELECT o_orderkey AS seq, CASE WHEN k = 'none' THEN '' WHEN days = 0 THEN k || ' today' WHEN days < 14 THEN k || ' ' || days || ' d ago' ELSE k || ' ' || (days // 7) || ' w ago' END AS label FROM (
  SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 'posted' WHEN 1 THEN 'relisted' WHEN 2 THEN 'updated' ELSE 'none' END AS k,
    greatest(0, date_diff('day', o_orderdate::DATE, DATE '2000-06-01')) AS days FROM orders)""")
def ages(t: Tables) -> DataFrame:
    key, at = F.col("o_orderkey"), F.col("o_orderdate").cast("timestamp")
    o = t.table("orders").select(
        key.alias("seq"), F.when(key % 4 == 0, at).alias("posted"),
        F.when(key % 4 != 3, at).alias("updated"), F.when(key % 4 == 1, at).alias("relisted"),
    ).withColumn("d", shown_date())
    return o.select("seq", age_label(F.coalesce("d.kind", F.lit("")), F.col("d.at"), now()).alias("label"))
