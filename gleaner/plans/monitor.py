"""Source health, heartbeats, run totals over events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner import fixed
from gleaner.operators import digest as dg
from gleaner.operators import health as hl
from gleaner.operators import verdicts as vd
from gleaner.operators.sinks import alert_feed, run_stats_after
from gleaner.operators.skew import previous_value
from gleaner.plans import sqlviews as s
from gleaner.plans.registry import query
from gleaner.plans.verdict import _GATE, judged
from gleaner.plans.views import EVENTS_NOW, Tables, shown, stamp
from gleaner.streaming.stateful import in_time

_BASE = """SELECT source, run, found, count(*) OVER w AS runs_before, coalesce(median(found) OVER w, 0) AS median, max(found) OVER w AS top FROM source_counts
  WINDOW w AS (PARTITION BY source ORDER BY run ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING)"""
_DEGRADED = """SELECT source, run, found, median::DOUBLE AS median, CASE WHEN median >= 5 AND found < median * 0.3 THEN 'degraded' WHEN found = 0 AND runs_before >= 5 AND top = 0 THEN 'never-succeeded' END AS reason, runs_before FROM base"""


@query("agg_09_median_per_source", s.sql("SELECT source, median(found)::DOUBLE AS median FROM source_counts GROUP BY source", "source_counts"))
def medians(t: Tables) -> DataFrame:
    return hl.median_per_source(t.source_counts)


@query("udf_05_median", "SELECT event_type, median(n)::DOUBLE AS median FROM (SELECT event_type, date_trunc('hour', ts) AS hour, count(*) AS n FROM events GROUP BY ALL) GROUP BY event_type")
def median_udaf(t: Tables) -> DataFrame:
    """The built-in exact median of hourly counts; no aggregate function of our own. Counting first keeps what a
    group holds to one number per hour."""
    hourly = t.events.groupBy("event_type", F.date_trunc("hour", "ts").alias("hour")).agg(F.count(F.lit(1)).alias("n"))
    return hourly.groupBy("event_type").agg(F.median("n").alias("median"))


@query("win_03_rolling_baseline", s.sql(f"SELECT source, {s.shown('run')} AS run, found, runs_before, median::DOUBLE AS median FROM base", "source_counts", base=_BASE))
def baseline(t: Tables) -> DataFrame:
    return hl.with_baseline(t.source_counts).select("source", shown("run").alias("run"), "found", "runs_before", "median")


@query("stm_04_degradations", s.sql(f"SELECT source, {s.shown('run')} AS run, found, median, reason FROM degraded WHERE reason IS NOT NULL", "source_counts", base=_BASE, degraded=_DEGRADED))
def degradations(t: Tables) -> DataFrame:
    return hl.degradations(t.source_counts).select("source", shown("run").alias("run"), "found", "median", "reason")


@query("stm_04_absent_sources", s.sql("""
SELECT source, median(found)::DOUBLE AS median, count(*) AS runs_before FROM (
  SELECT * FROM source_counts WHERE run < TIMESTAMP '2024-01-20 03:00:00' QUALIFY row_number() OVER (PARTITION BY source ORDER BY run DESC) <= 10)
WHERE source NOT IN (SELECT source FROM source_counts WHERE run = TIMESTAMP '2024-01-20 03:00:00' AND source NOT IN ('view', 'click')) AND source <> 'click' GROUP BY source HAVING median(found) >= 5""", "source_counts"))
def absent(t: Tables) -> DataFrame:
    """The run of 20 January with two sources taken out, one of them skipped on purpose."""
    run = stamp("2024-01-20 03:00:00")
    counts = t.source_counts.filter(~((F.col("run") == run) & F.col("source").isin("view", "click")))
    return hl.absent_sources(counts, run, ["click"])


@query("win_04_zero_twice", s.sql(f"""
SELECT source, {s.shown('run')} AS run, median::DOUBLE AS median FROM (
  SELECT source, run, found, lag(found) OVER (PARTITION BY source ORDER BY run) AS previous,
    median(found) OVER (PARTITION BY source ORDER BY run ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) AS median FROM counts)
WHERE found = 0 AND previous = 0 AND median > 0""", counts="SELECT event_type AS source, make_timestamp((epoch_us(ts) // 10800000000) * 10800000000) AS run, count(*) FILTER (value > 130) AS found FROM events GROUP BY ALL"))
def zero_twice(t: Tables) -> DataFrame:
    run = F.timestamp_seconds(F.floor(F.unix_seconds("ts") / 10800) * 10800)
    counts = t.events.groupBy(F.col("event_type").alias("source"), run.alias("run")).agg(F.count_if(F.col("value") > 130).alias("found"))
    return hl.zero_twice(counts).select("source", shown("run").alias("run"), "median")


@query("win_05_runs_since", s.sql(f"""
SELECT job, {s.shown("max(stamp)")} AS last_at, (SELECT count(*) FROM beats) - max(tick) AS runs FROM (SELECT *, row_number() OVER (ORDER BY stamp, seq) AS tick FROM beats) GROUP BY job""", "beats"))
def runs_since(t: Tables) -> DataFrame:
    return hl.runs_since(t.beats, stamp(EVENTS_NOW)).select("job", shown("at").alias("last_at"), "runs")


_STALE = f"""SELECT job, floor(hours + 0.5)::BIGINT AS hours, runs FROM (
  SELECT job, (epoch_us(TIMESTAMP '{EVENTS_NOW}') - epoch_us(max(stamp))) / 3600000000 AS hours, (SELECT count(*) FROM beats) - max(tick) AS runs
  FROM (SELECT *, row_number() OVER (ORDER BY stamp, seq) AS tick FROM beats) GROUP BY job) WHERE hours >= 12 AND runs >= 12"""


@query("stm_05_stale_jobs", s.sql(_STALE, "beats"))
def stale(t: Tables) -> DataFrame:
    return hl.stale_jobs(hl.runs_since(t.beats, stamp(EVENTS_NOW)))


@query("stm_05_alerted_once", s.sql(f"""
SELECT job, hours, runs FROM (SELECT job, floor(hours + 0.5)::BIGINT AS hours, runs, hours AS age, CASE WHEN runs % 2 = 0 THEN hours / 2 END AS alerted FROM (
  SELECT job, (epoch_us(TIMESTAMP '{EVENTS_NOW}') - epoch_us(max(stamp))) / 3600000000 AS hours, (SELECT count(*) FROM beats) - max(tick) AS runs
  FROM (SELECT *, row_number() OVER (ORDER BY stamp, seq) AS tick FROM beats) GROUP BY job)) WHERE age >= 12 AND runs >= 12 AND NOT coalesce(alerted < age AND alerted < 24, false)""", "beats"))
def alerted_once(t: Tables) -> DataFrame:
    """Half of the jobs were alerted on halfway through their silence."""
    state = hl.runs_since(t.beats, stamp(EVENTS_NOW)).withColumn("alerted_hours", F.when(F.col("runs") % 2 == 0, F.col("hours") / 2))
    return hl.stale_jobs(state)


@query("stm_09_fresh_sources", s.sql("""
SELECT source, coalesce(stamp <= TIMESTAMP '2024-01-30 23:40:00' AND stamp > TIMESTAMP '2024-01-30 23:40:00' - INTERVAL 50 MINUTE AND found > 0, false) AS skip FROM (
  SELECT event_type || '-' || (user_id % 10) AS source, max(ts) AS stamp, arg_max(user_id % 3, ts) AS found FROM events GROUP BY ALL)"""))
def fresh(t: Tables) -> DataFrame:
    """Last read per source with what it found; some found nothing and are read again."""
    last = t.events.groupBy(F.concat("event_type", F.lit("-"), (F.col("user_id") % 10).cast("string")).alias("source")).agg(
        F.max("ts").alias("at"), F.max_by(F.col("user_id") % 3, "ts").alias("found")
    )
    return hl.fresh_sources(last, stamp("2024-01-30 23:40:00")).select("source", "skip")


@query("agg_15_run_outcome", """
SELECT run, count(*) FILTER (tried) AS tried, count(*) FILTER (tried AND bad) AS failed, count(*) FILTER (tried) > 0 AND count(*) FILTER (tried AND bad) = count(*) FILTER (tried) AND NOT bool_or(fresh) AS run_failed FROM (
  SELECT strftime(ts, '%Y-%m-%d %H') AS run, event_type, count(*) > 1 AS tried, max(value) < 120 AS bad, max(value) > 300 AS fresh FROM events GROUP BY ALL) GROUP BY run""")
def outcome(t: Tables) -> DataFrame:
    """Hours as runs: a source with more than one event was tried, one without a high value failed."""
    per = t.events.groupBy(F.date_format("ts", "yyyy-MM-dd HH").alias("run"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.max("value").alias("top"))
    attempts = per.select("run", F.col("event_type").alias("source"), (F.col("n") > 1).alias("tried"), (F.col("top") < 120).alias("failed"), (F.col("top") > 300).alias("fresh"))
    return hl.run_outcome(attempts)


@query("win_06_keep_last", s.sql(f"SELECT source, {s.shown('run')} AS run, found FROM source_counts QUALIFY row_number() OVER (PARTITION BY source ORDER BY run DESC) <= 10", "source_counts"))
def keep_last(t: Tables) -> DataFrame:
    return hl.keep_last(t.source_counts, ["source"], [F.col("run").desc()], fixed.HISTORY_LEN).select("source", shown("run").alias("run"), "found")


@query("snk_06_run_stats_kept", """
SELECT event_id, user_id AS considered FROM events ORDER BY ts DESC LIMIT 900""")
def stats_kept(t: Tables) -> DataFrame:
    rows = t.events.select("event_id", F.col("ts").alias("at"), F.col("user_id").alias("considered"))
    last = rows.filter(F.col("event_id") == rows.agg(F.max("event_id")).scalar())
    before = rows.filter(F.col("event_id") < rows.agg(F.max("event_id")).scalar())
    return run_stats_after(before, last, 900).select("event_id", "considered")


_LOG = """SELECT ts AS stamp, 1 AS runs, user_id AS considered, 2 AS written, 0 AS dropped, 1 AS failed FROM events WHERE event_type = 'error'"""


@query("agg_06_digest_totals", s.sql("""
SELECT count(*) AS runs, sum(considered)::BIGINT AS considered, sum(written)::BIGINT AS written, sum(borderline)::BIGINT AS borderline, sum(dropped)::BIGINT AS dropped, sum(failed)::BIGINT AS failed,
  sum(llm_calls)::BIGINT AS llm_calls, sum(llm_ms)::BIGINT AS llm_ms, floor(sum(llm_ms) / sum(llm_calls) / 1000 + 0.5)::BIGINT AS avg_seconds FROM run_stats WHERE stamp >= TIMESTAMP '2024-01-10'""", "run_stats"))
def totals(t: Tables) -> DataFrame:
    recent = t.run_stats.filter(dg.in_window("at", stamp("2024-01-10 00:00:00"))).withColumn("runs", F.lit(1))
    return dg.digest_totals(recent)


@query("set_02_stats_and_log", s.sql("""
SELECT sum(runs)::BIGINT AS runs, sum(considered)::BIGINT AS considered, sum(written)::BIGINT AS written, sum(dropped)::BIGINT AS dropped, sum(failed)::BIGINT AS failed FROM (
  SELECT 1 AS runs, considered, written, dropped, failed FROM stats WHERE stamp >= TIMESTAMP '2024-01-05'
  UNION ALL SELECT runs, considered, written, dropped, failed FROM log WHERE stamp >= TIMESTAMP '2024-01-05' AND stamp < (SELECT min(stamp) FROM stats WHERE stamp >= TIMESTAMP '2024-01-05'))""",
    "run_stats", stats="SELECT * FROM run_stats WHERE stamp >= TIMESTAMP '2024-01-12'", log=_LOG))
def stats_and_log(t: Tables) -> DataFrame:
    """The stats table starts on 12 January; the log fills in the days before it, and nothing is counted twice."""
    stats = t.run_stats.filter(F.col("at") >= stamp("2024-01-12 00:00:00"))
    log = t.events.filter("event_type = 'error'").select(
        F.col("ts").alias("at"), F.lit(1).alias("runs"), F.col("user_id").alias("considered"), F.lit(2).cast("bigint").alias("written"),
        F.lit(0).cast("bigint").alias("dropped"), F.lit(1).cast("bigint").alias("failed"),
    )
    every = dg.stats_and_log(stats, log, stamp("2024-01-05 00:00:00"))
    return dg.digest_totals(every).select("runs", "considered", "written", "dropped", "failed")


@query("agg_07_packages_per_source", s.sql("SELECT source, count(*) AS packages FROM packages GROUP BY source", "packages"))
def per_source(t: Tables) -> DataFrame:
    return dg.packages_per_source(t.packages)


_LABELS = "SELECT doc_id AS seq, 'doc ' || doc_id AS label, CASE WHEN doc_id % 7 = 0 THEN 'n/a' WHEN doc_id % 7 = 1 THEN NULL ELSE (quality * 60 + doc_id % 40)::VARCHAR END AS llm_score, CASE doc_id % 3 WHEN 0 THEN 'small' WHEN 1 THEN 'large' ELSE '' END AS llm_model FROM labels"


def label_packages(t: Tables) -> DataFrame:
    k = F.col("doc_id")
    return t.table("labels").select(
        k.alias("seq"), F.concat(F.lit("doc "), k.cast("string")).alias("label"),
        F.when(k % 7 == 0, "n/a").when(k % 7 != 1, (F.col("quality") * 60 + k % 40).cast("string")).alias("llm_score"),
        F.when(k % 3 == 0, "small").when(k % 3 == 1, "large").otherwise("").alias("llm_model"),
    )


@query("agg_08_scores_line", f"WITH p AS ({_LABELS}) SELECT count(*) AS scored, arg_max(label, struct_pack(a := llm_score::INT, b := -seq)) AS top_label, max(llm_score::INT) AS top_score FROM p WHERE regexp_full_match(llm_score, '[0-9]+')")
def scores(t: Tables) -> DataFrame:
    return dg.scores_line(label_packages(t))


@query("agg_08_scores_per_model", f"WITH p AS ({_LABELS}) SELECT coalesce(nullif(llm_model, ''), 'unknown') AS model, count(*) AS scored FROM p WHERE regexp_full_match(llm_score, '[0-9]+') GROUP BY 1")
def per_model(t: Tables) -> DataFrame:
    return dg.scores_per_model(label_packages(t))


@query("fil_03_time_window", """
SELECT event_type, count(*) FILTER (stamp >= TIMESTAMP '2024-01-10' AND stamp < TIMESTAMP '2024-01-20') AS strict, count(*) FILTER (stamp IS NULL OR (stamp >= TIMESTAMP '2024-01-10' AND stamp < TIMESTAMP '2024-01-20')) AS kept FROM (
  SELECT event_type, CASE WHEN event_id % 10 <> 0 THEN ts END AS stamp FROM events) GROUP BY event_type""")
def windows(t: Tables) -> DataFrame:
    e = t.events.select("event_type", F.when(F.col("event_id") % 10 != 0, F.col("ts")).alias("at"))
    since, until = stamp("2024-01-10 00:00:00"), stamp("2024-01-20 00:00:00")
    return e.groupBy("event_type").agg(
        F.count_if(dg.in_window("at", since, until)).alias("strict"), F.count_if(dg.in_window("at", since, until, keep_unparsable=True)).alias("kept")
    )


@query("agg_14_extraction_drift", s.sql(r"""
SELECT source, count(*) AS opened, count(*) FILTER (lang = 'en') AS expected, count(*) FILTER (NOT split_ok) AS unsplit, arg_min(title, seq) FILTER (NOT split_ok) AS example, count(*) FILTER (lang = 'en') = 0 AS warn FROM (
  SELECT p.seq, p.source, d.lang, p.title, NOT regexp_matches(p.title, '[.,]') AS split_ok FROM postings p JOIN documents d ON d.doc_id = p.seq) GROUP BY source""", "postings"))
def drift(t: Tables) -> DataFrame:
    """Titles with a comma or stop pass as titles without their connector."""
    opened = t.postings.select("seq", "source", "title", "lang").withColumns({
        "lang_ok": F.col("lang") == "en", "split_ok": ~F.col("title").rlike("[.,]"),
    })
    return hl.extraction_drift(opened)


@query("snk_07_alert_feed", s.sql(f"""
SELECT 'match' AS kind, title || ' @ ' || company AS subject, 'score ' || score || coalesce(' / verdict ' || llm_score, '') AS detail, url AS link FROM decided WHERE action = 'write'
UNION ALL SELECT 'source', source, CASE WHEN reason = 'never-succeeded' THEN 'never returned results in ' || runs_before || ' runs' ELSE found || ' found, recent median ' || median END, NULL FROM degraded WHERE reason IS NOT NULL
UNION ALL SELECT 'job', job, 'no successful run for ' || hours || ' h while ' || runs || ' other runs finished', NULL FROM stale""",
    "scored", "verdicts", "source_counts", "beats", **_GATE, base=_BASE, degraded=_DEGRADED, stale=_STALE))
def alerts(t: Tables) -> DataFrame:
    written = vd.verdict_gate(judged(t), 70, 50).filter("action IN ('write', 'borderline')")
    return alert_feed(written, hl.degradations(t.source_counts), hl.stale_jobs(hl.runs_since(t.beats, stamp(EVENTS_NOW))))


@query("stm_01_last_seen_ttl", """
SELECT event_id, user_id, coalesce(ts - previous > INTERVAL 24 HOUR, true) AS is_new FROM (SELECT event_id, user_id, ts, lag(ts) OVER (PARTITION BY user_id ORDER BY ts) AS previous FROM events)""")
def last_seen(t: Tables) -> DataFrame:
    """A key is new again when it was away longer than the TTL. Looked up in minute chunks, so a hot key is many tasks."""
    e = t.events.select("event_id", "user_id", "ts")
    prev = previous_value(e, ["user_id"], F.date_trunc("minute", "ts"), [F.col("ts")], "ts", "previous")
    away = F.col("ts") - F.expr("INTERVAL 24 HOURS") > F.col("previous")
    return prev.select("event_id", "user_id", F.coalesce(away, F.lit(True)).alias("is_new"))


@query("stm_02_two_strikes", """
SELECT event_id, user_id, CASE row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) WHEN 1 THEN 'defer' WHEN 2 THEN 'final' ELSE 'seen' END AS outcome FROM events WHERE event_type = 'error'""")
def strikes(t: Tables) -> DataFrame:
    """Errors as turn-downs: the first two per key decide; they are picked before the shuffle."""
    e = t.events.filter("event_type = 'error'").select("event_id", "user_id", "ts")
    first = e.groupBy("user_id").agg(F.min(F.struct("ts", "event_id")).alias("one"))
    rest = e.join(first, "user_id").filter(F.struct("ts", "event_id") > F.col("one"))
    second = rest.groupBy("user_id").agg(F.min(F.struct("ts", "event_id")).alias("two"))
    both = e.join(first, "user_id").join(second, "user_id", "left")
    here = F.struct("ts", "event_id")
    return both.select("event_id", "user_id", F.when(here == F.col("one"), "defer").when(here == F.col("two"), "final").otherwise("seen").alias("outcome"))


@query("stm_10_time_guard", """
SELECT event_type, count(*) AS kept FROM (SELECT event_type, CASE event_id % 20 WHEN 0 THEN ts + INTERVAL 10 YEAR WHEN 1 THEN ts - INTERVAL 30 YEAR ELSE ts END AS stamp FROM events)
WHERE stamp >= TIMESTAMP '2000-01-01' AND stamp <= TIMESTAMP '2024-02-01' GROUP BY event_type""")
def guard(t: Tables) -> DataFrame:
    k = F.col("event_id") % 20
    moved = F.when(k == 0, F.col("ts") + F.expr("INTERVAL 10 YEARS")).when(k == 1, F.col("ts") - F.expr("INTERVAL 30 YEARS")).otherwise(F.col("ts"))
    return in_time(t.events.withColumn("ts", moved), stamp(EVENTS_NOW)).groupBy("event_type").agg(F.count(F.lit(1)).alias("kept"))
