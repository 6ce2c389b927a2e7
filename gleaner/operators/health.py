"""Source health, heartbeats, run outcome.

counts: (source, run, found), one row per source and run that tried it. A source's runs are few (one per
hour at most), so windows over them are small however large the crawl is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleaner import fixed
from gleaner.operators.skew import first_rows, ranked


def median_per_source(counts: DataFrame) -> DataFrame:
    """Exact median; an even number of runs takes the mean of the middle two."""
    return counts.groupBy("source").agg(F.median("found").alias("median"))


def with_baseline(counts: DataFrame, history: int = fixed.HISTORY_LEN) -> DataFrame:
    """Adds runs_before and median over the previous ``history`` runs of the source (0 without any)."""
    before = Window.partitionBy("source").orderBy("run").rowsBetween(-history, -1)
    return counts.withColumns({
        "runs_before": F.count(F.lit(1)).over(before),
        "median": F.coalesce(F.percentile("found", 0.5).over(before), F.lit(0.0)),
        "max_before": F.max("found").over(before),
    })


def degradations(counts: DataFrame) -> DataFrame:
    """(source, run, found, median, reason): far below the norm, or never any result in the whole history."""
    base = with_baseline(counts)
    low = (F.col("median") >= fixed.MIN_MEDIAN) & (F.col("found") < F.col("median") * fixed.DEGRADE_RATIO)
    never = (F.col("found") == 0) & (F.col("runs_before") >= fixed.NEVER_RUNS) & (F.col("max_before") == 0)
    return (
        base.withColumn("reason", F.when(low, "degraded").when(never, "never-succeeded"))
        .filter("reason IS NOT NULL").select("source", "run", "found", "median", "reason", "runs_before")
    )


def absent_sources(counts: DataFrame, run: Column, skipped: list[str] | None = None) -> DataFrame:
    """Sources with a normal history that did not take part in ``run`` and were not skipped on purpose."""
    past = counts.filter(F.col("run") < run)
    last = first_rows(past, ["source"], [F.col("run").desc()], fixed.HISTORY_LEN)
    norm = last.groupBy("source").agg(F.median("found").alias("median"), F.count(F.lit(1)).alias("runs_before"))
    present = counts.filter(F.col("run") == run).select("source")
    out = norm.join(present, "source", "left_anti").filter(F.col("median") >= fixed.MIN_MEDIAN)
    return out.filter(~F.col("source").isin(skipped)) if skipped else out


def zero_twice(counts: DataFrame) -> DataFrame:
    """Runs at 0 whose previous run was 0 too, against a positive median of the last runs kept (this one included)."""
    by_run = Window.partitionBy("source").orderBy("run")
    kept = by_run.rowsBetween(-(fixed.HISTORY_LEN - 1), 0)
    return counts.withColumns({
        "previous": F.lag("found", 1).over(by_run),
        "median": F.percentile("found", 0.5).over(kept),
    }).filter("found = 0 AND previous = 0 AND median > 0")


def keep_last(df: DataFrame, keys: list[str], order: list[Column], n: int) -> DataFrame:
    """The last n rows per key (snapshots, history, stats); each task keeps n per key before the shuffle."""
    return first_rows(df, keys, order, n)


def keep_last_overall(df: DataFrame, order: list[Column], n: int) -> DataFrame:
    """The last n rows of a log: top-n per task, then a merge."""
    return df.orderBy(*order).limit(n)


# ---- heartbeats -------------------------------------------------------------------

def with_ticks(beats: DataFrame, chunk: Column | None = None) -> DataFrame:
    """Adds tick: the running number of a stamp over all jobs. beats: (seq, job, at)."""
    chunk = F.unix_seconds(F.date_trunc("minute", "at")) if chunk is None else chunk
    return ranked(beats, [], chunk, [F.col("at"), F.col("seq")], "tick")


def runs_since(beats: DataFrame, now: Column) -> DataFrame:
    """(job, at, hours, runs): age of each job's last stamp and how many other stamps came after it."""
    ticks = with_ticks(beats)
    last = ticks.groupBy("job").agg(F.max("at").alias("at"), F.max("tick").alias("tick"))
    total = beats.agg(F.count(F.lit(1))).scalar()
    age = (F.unix_micros(now) - F.unix_micros("at")) / 3_600_000_000
    return last.select("job", "at", age.alias("hours"), (total - F.col("tick")).alias("runs"))


def heartbeat_limits() -> tuple[Column, Column]:
    """(hours, runs) allowed for the job of the row."""
    hours, runs = (F.lit(v) for v in fixed.HEARTBEAT_DEFAULT)
    for job, (h, r) in fixed.HEARTBEAT_LIMITS.items():
        hours = F.when(F.col("job") == job, h).otherwise(hours)
        runs = F.when(F.col("job") == job, r).otherwise(runs)
    return hours, runs


def stale_jobs(state: DataFrame, limits: tuple[Column, Column] | None = None) -> DataFrame:
    """Jobs old by the clock AND out-run by other jobs, not alerted on since their last success within a day.

    state: (job, at, hours, runs[, alerted_hours]) where alerted_hours is the age of the last alert.
    """
    hours, runs = limits or heartbeat_limits()
    quiet = F.lit(False)
    if "alerted_hours" in state.columns:
        quiet = F.coalesce((F.col("alerted_hours") < F.col("hours")) & (F.col("alerted_hours") < 24), F.lit(False))
    return (
        state.filter((F.col("hours") >= hours) & (F.col("runs") >= runs) & ~quiet)
        .select("job", F.floor(F.col("hours") + 0.5).cast("bigint").alias("hours"), F.col("runs").cast("bigint").alias("runs"))
    )


# ---- runs ---------------------------------------------------------------------------

def fresh_sources(last_run: DataFrame, now: Column, minutes: int = fixed.FRESH_MINUTES) -> DataFrame:
    """Adds skip: read less than ``minutes`` ago with something found. last_run: (source, at, found)."""
    age = F.unix_micros(now) - F.unix_micros("at")
    fresh = (age >= 0) & (age < minutes * 60_000_000) & (F.col("found") > 0)
    return last_run.withColumn("skip", F.coalesce(fresh, F.lit(False)))


def run_outcome(attempts: DataFrame) -> DataFrame:
    """(run, tried, failed, run_failed): a run fails only when every source it tried failed and none was fresh.

    attempts: (run, source, tried, failed, fresh).
    """
    return attempts.groupBy("run").agg(
        F.count_if("tried").alias("tried"),
        F.count_if(F.col("tried") & F.col("failed")).alias("failed"),
        F.max("fresh").alias("any_fresh"),
    ).withColumn(
        "run_failed", (F.col("tried") > 0) & (F.col("failed") == F.col("tried")) & ~F.col("any_fresh")
    ).drop("any_fresh")


def search_yield(pages: DataFrame) -> DataFrame:
    """(source, run, search, pages, items, outcome): partial when a page was cut, failed when none was read.

    pages: (source, run, search, page_no, items, status: ok | end | cut).
    """
    per = pages.groupBy("source", "run", "search").agg(
        F.count_if(F.col("status") == "ok").alias("pages"),
        F.coalesce(F.sum(F.when(F.col("status") == "ok", F.col("items"))), F.lit(0)).cast("bigint").alias("items"),
        F.count_if(F.col("status") == "cut").alias("cuts"),
    )
    outcome = F.when((F.col("cuts") > 0) & (F.col("pages") == 0), "failed").when(F.col("cuts") > 0, "partial").otherwise("ok")
    return per.withColumn("outcome", outcome).drop("cuts")


def outages(yields: DataFrame) -> DataFrame:
    """(source, run, outage): every search failed before its first page."""
    return yields.groupBy("source", "run").agg(F.min(F.col("outcome") == "failed").alias("outage"))


def extraction_drift(opened: DataFrame) -> DataFrame:
    """(source, opened, expected, warn, unsplit, example): nothing in the expected language, titles without connector.

    opened: (seq, source, lang_ok, title, split_ok).
    """
    return opened.groupBy("source").agg(
        F.count(F.lit(1)).alias("opened"),
        F.count_if("lang_ok").alias("expected"),
        F.count_if(~F.col("split_ok")).alias("unsplit"),
        F.min_by("title", F.when(~F.col("split_ok"), F.col("seq"))).alias("example"),
    ).withColumn("warn", (F.col("opened") > 0) & (F.col("expected") == 0))
