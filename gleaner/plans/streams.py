"""The stateful operators as streams over the given tables; each must equal its batch form."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.operators.inbox import message_key
from gleaner.plans import sqlviews as s
from gleaner.plans.lifecycle import _MERGED as _MERGED_STATE
from gleaner.plans.lifecycle import _PATCHES, patches
from gleaner.plans.monitor import _BASE, _DEGRADED
from gleaner.plans.registry import query
from gleaner.plans.views import Tables, shown, stamp
from gleaner.session import cut_lineage, discard, scratch_folder
from gleaner.streaming import runs, stateful


def stream(t: Tables, name: str) -> DataFrame:
    """A given table as a file stream."""
    return t.spark.readStream.schema(t.table(name).schema).parquet(f"{t.sf_dir}/{name}.parquet*")


def event_stream(t: Tables) -> DataFrame:
    return stream(t, "events").withColumn("ts", F.col("ts").cast("timestamp"))


#: Rows that a file of a micro-batch holds, about.
FILE_ROWS = 1_000_000


def in_batches(t: Tables, rows: DataFrame, order: str, n: int = 4) -> DataFrame:
    """The rows as a stream of ``n`` micro-batches, one range of ``order`` (a time or a number) after another.

    The rows are worked out once. Every batch is as many files as the largest needs, each written by a task of its own; a
    range without rows is no batch.
    """
    at = F.unix_micros(order) if dict(rows.dtypes)[order] == "timestamp" else F.col(order).cast("bigint")
    folder, scratch = runs.run_folder(t.spark, "batches"), scratch_folder(t.spark)
    kept = cut_lineage(rows, scratch)
    low, high = kept.agg(F.min(at), F.max(at)).first()
    edges = [(low or 0) + ((high or 0) - (low or 0) + 1) * k // n for k in range(n + 1)]
    ranges = [at.between(start, end - 1) for start, end in zip(edges, edges[1:])]
    sizes = list(kept.agg(*[F.count_if(r) for r in ranges]).first())
    files, written = max(1, -(-max(sizes) // FILE_ROWS)), runs.Files(t.spark, folder)
    batches = [r for r, size in zip(ranges, sizes) if size] or ranges[:1]
    for i, batch in enumerate(batches):
        kept.filter(batch).repartition(files).write.mode("append").parquet(f"{folder}/in")
        there = sum(name.startswith("part-") for name in written.names(f"{folder}/in"))
        for _ in range(there, (i + 1) * files):  # fewer rows than files: the rest of them hold none
            kept.limit(0).write.mode("append").parquet(f"{folder}/in")
    discard(t.spark, scratch)
    return t.spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", files).parquet(f"{folder}/in")


def _closed(minutes: int) -> str:
    """Events whose minute the watermark, so many minutes behind the newest, has closed."""
    return f"SELECT *, epoch_ms(date_trunc('minute', ts)) + 60000 AS m FROM events WHERE epoch_ms(date_trunc('minute', ts)) + 60000 <= (SELECT epoch_us(max(ts)) // 1000 FROM events) - {minutes * 60_000}"


@query("stm_01_first_sightings_stream", s.sql("""
SELECT user_id AS key, epoch_us(ts) AS first_at FROM (SELECT user_id, ts, lag(ts) OVER (PARTITION BY user_id ORDER BY ts) AS before FROM closed)
WHERE before IS NULL OR epoch_us(ts) - epoch_us(before) > 24 * 3600000000""", closed=_closed(10)))
def sightings(t: Tables) -> DataFrame:
    """Keys that come back after a day away. Minutes that the watermark has not closed at the end of the stream stay open."""
    keyed = in_batches(t, t.events, "ts").select(F.col("user_id").alias("key"), "ts")
    return runs.run_to_table(stateful.first_sightings(keyed, 24), "sightings")


@query("stm_02_two_strikes_stream", """
SELECT user_id AS key, event_id AS seq, CASE n WHEN 1 THEN 'defer' ELSE 'final' END AS outcome FROM (
  SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events WHERE event_type = 'error') WHERE n <= 2""")
def strikes(t: Tables) -> DataFrame:
    turned_down = in_batches(t, t.events, "ts").filter("event_type = 'error'").select(F.col("user_id").alias("key"), F.col("event_id").alias("seq"), F.col("ts").alias("at"))
    return runs.run_to_table(stateful.two_strikes(turned_down), "strikes")


@query("stm_03_repost_marks_stream", """
SELECT vacancy, link, seq FROM (SELECT o_custkey AS vacancy, o_orderpriority AS link, o_orderkey AS seq, datediff('day', lag(o_orderdate::DATE) OVER (PARTITION BY o_custkey, o_orderpriority ORDER BY o_orderdate::DATE, o_orderkey), o_orderdate::DATE) AS gap FROM orders)
WHERE gap IS NULL OR gap > 90""")
def marks(t: Tables) -> DataFrame:
    """Orders as listings of one vacancy per customer under five links: a fresh look per link, again after the TTL."""
    listed = t.table("orders").select(
        F.col("o_custkey").alias("vacancy"), F.col("o_orderpriority").alias("link"),
        F.datediff(F.to_date("o_orderdate"), F.lit("1970-01-01").cast("date")).cast("bigint").alias("day"), F.col("o_orderkey").alias("seq"),
    )
    return runs.run_to_table(stateful.repost_marks(in_batches(t, listed, "day")), "marks")


@query("stm_04_degradations_stream", s.sql(f"SELECT source, {s.shown('run')} AS run, found, median, reason FROM degraded WHERE reason IS NOT NULL", "source_counts", base=_BASE, degraded=_DEGRADED))
def degradations(t: Tables) -> DataFrame:
    """Counts arrive in several batches; the state holds ten numbers a source."""
    found = runs.run_to_table(stateful.degradation_stream(in_batches(t, t.source_counts, "run")), "degradations")
    return found.select("source", shown("run").alias("run"), "found", "median", "reason")


def job_beats(t: Tables) -> DataFrame:
    return in_batches(t, t.events, "ts").select(F.concat(F.lit("job-"), F.col("user_id").cast("string")).alias("job"), F.col("ts").alias("at"))


@query("stm_05_silent_jobs_stream", s.sql("""
SELECT job, before AS silent_since_ms FROM (SELECT job, ms, lag(ms) OVER (PARTITION BY job ORDER BY ms) AS before FROM stamps) WHERE ms - before >= 43200000
UNION ALL SELECT job, max(ms) FROM stamps GROUP BY job HAVING max(ms) + 43200000 <= (SELECT epoch_us(max(ts)) // 1000 - 3600000 FROM events)""",
    closed=_closed(60), stamps="SELECT 'job-' || user_id AS job, epoch_us(ts) // 1000 AS ms FROM closed"))
def silent(t: Tables) -> DataFrame:
    """Jobs without a stamp for twelve hours: told by the next stamp or by an event-time timer, whichever is first."""
    return runs.run_to_table(stateful.silent_jobs(job_beats(t)), "silent")


@query("stm_05_watchdog_stream", s.sql("""
SELECT job, a.m AS at_ms, floor((a.m - ms) / 3600000 + 0.5)::BIGINT AS hours, t.tick - a.tick AS runs FROM alerts a JOIN ticks t USING (m)""",
    recursive=f"""closed AS ({_closed(60)}), ticks AS (SELECT m, sum(count(*)) OVER (ORDER BY m)::BIGINT AS tick FROM closed GROUP BY m),
    stamps AS (SELECT 'job-' || user_id AS job, m, max(epoch_us(ts) // 1000) AS ms FROM closed GROUP BY 1, 2),
    spans AS (SELECT job, ms, tick, coalesce(lead(m) OVER (PARTITION BY job ORDER BY m), 9000000000000000) AS until FROM stamps JOIN ticks USING (m)),
    by_clock AS (SELECT s.*, t.m AS m1 FROM spans s ASOF JOIN ticks t ON s.ms + 43200000 <= t.m),
    by_runs AS (SELECT b.*, greatest(b.m1, t.m) AS m FROM by_clock b ASOF JOIN ticks t ON b.tick + 12 <= t.tick),
    alerts AS (SELECT job, ms, tick, until, m FROM by_runs WHERE m < until
      UNION ALL SELECT a.job, a.ms, a.tick, a.until, t.m FROM alerts a ASOF JOIN ticks t ON a.m + 86400000 <= t.m WHERE t.m < a.until)"""))
def watched(t: Tables) -> DataFrame:
    """Jobs that are silent for twelve hours and out-run by twelve stamps; told again every day that they stay so."""
    return runs.run_to_table(stateful.watchdog(job_beats(t)), "watchdog")


@query("stm_06_changed_threads_stream", """
SELECT conv_id AS thread, turn AS scan, conv_id || '#' || left(sha1(text), 12) AS key FROM conversations QUALIFY text IS DISTINCT FROM lag(text) OVER (PARTITION BY conv_id ORDER BY turn)""")
def threads(t: Tables) -> DataFrame:
    """Turns as scans of a thread whose newest text is its state; stretches of two scans, so that every thread has several."""
    scans = in_batches(t, t.table("conversations"), "turn", 3).select(
        F.col("conv_id").alias("thread"), F.col("turn").cast("bigint").alias("scan"), message_key(F.col("conv_id").cast("string"), F.col("text")).alias("key")
    )
    return runs.run_to_table(stateful.changed_states(scans, 2), "threads")


@query("stm_07_pending_stream", """
SELECT conv_id % 10 AS mailbox, conv_id AS id, arg_max('n' || (length(text) % 7), turn) AS label FROM conversations WHERE role = 'user' GROUP BY 1, 2""")
def pending(t: Tables) -> DataFrame:
    notified = in_batches(t, t.table("conversations"), "turn").filter("role = 'user'").select(
        (F.col("conv_id") % 10).alias("mailbox"), F.col("conv_id").alias("id"),
        F.concat(F.lit("n"), (F.length("text") % 7).cast("string")).alias("label"), (F.col("conv_id") * 100 + F.col("turn")).alias("at"),
    )
    return runs.pending_after(notified).select("mailbox", "id", "label")


@query("stm_08_outbox_stream", "SELECT DISTINCT event_type || '/' || user_id || '/' || strftime(ts, '%Y-%m-%d') AS body FROM events")
def outbox(t: Tables) -> DataFrame:
    """Alerts per event; the same alert is sent once inside the two-day window, late ones never."""
    queue = in_batches(t, t.events, "ts").select(
        F.col("ts").alias("queued_at"), F.concat_ws("/", "event_type", F.col("user_id").cast("string"), F.date_format("ts", "yyyy-MM-dd")).alias("body")
    )
    return runs.run_to_table(stateful.outbox(queue), "outbox").select("body")


@query("stm_09_incremental_stream", "SELECT event_type, count(*) AS n FROM events GROUP BY event_type")
def incremental(t: Tables) -> DataFrame:
    """Two runs over one checkpoint: the second reads nothing again."""
    folder = runs.run_folder(t.spark, "incremental")
    rows = event_stream(t).select("event_id", "event_type")
    runs.run_to_table(rows, "incremental", folder)
    return runs.run_to_table(rows, "incremental", folder).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


@query("stm_11_closures_stream", s.sql("""
SELECT l.url, CASE WHEN l.seq % 3 = 0 AND (j.status IS NULL OR j.status = 'viewed') THEN 'closed' ELSE j.status END AS status FROM listings l LEFT JOIN job_state j USING (url)
WHERE j.status IS NOT NULL OR j.note IS NOT NULL OR l.seq % 3 = 0""", "listings", "job_state"))
def closures(t: Tables) -> DataFrame:
    """Every third listing is found closed, in several batches; only cards still new or viewed are changed."""
    found = in_batches(t, t.listings.filter("seq % 3 = 0").select("seq", "url", stamp("2000-06-01 00:00:00").alias("at")), "seq")
    return runs.state_after_closures(found, t.job_state).select("url", "status")


@query("stm_12_patch_log_stream", s.sql("SELECT url, status, note FROM merged WHERE status IS NOT NULL OR note IS NOT NULL", "listings", "job_state", patches=_PATCHES, merged=_MERGED_STATE))
def patch_log(t: Tables) -> DataFrame:
    """Patches in the order of their log, in several batches; each reads and writes the entries that it names."""
    return runs.state_after_patches(in_batches(t, patches(t), "ord", 10), t.job_state).select("url", "status", "note")
