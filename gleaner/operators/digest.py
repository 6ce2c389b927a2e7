"""The periodic digest: run totals, packages per source, scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner import fixed
from gleaner.functions.text import text_or_blank

COUNTERS = ["considered", "written", "borderline", "dropped", "failed", "llm_calls", "llm_ms"]


def in_window(ts: str, since: Column, until: Column | None = None, keep_unparsable: bool = False) -> Column:
    """[since, until); a row without a stamp is dropped for packages and kept for log lines."""
    inside = F.col(ts) >= since
    if until is not None:
        inside = inside & (F.col(ts) < until)
    return F.coalesce(inside, F.lit(keep_unparsable))


def stats_and_log(stats: DataFrame, log_counts: DataFrame, since: Column) -> DataFrame:
    """Run rows from the stats table, and from the log only for the time before the first stat.

    stats: (at, runs=1 implied, counters). log_counts: (at, runs, considered, written, dropped, failed).
    """
    recent = stats.filter(F.col("at") >= since)
    first = recent.agg(F.min("at")).scalar()
    early = log_counts.filter(F.col("at").isNull() | ((F.col("at") >= since) & (first.isNull() | (F.col("at") < first))))
    return recent.withColumn("runs", F.lit(1)).unionByName(early, allowMissingColumns=True)


def digest_totals(runs: DataFrame) -> DataFrame:
    """One row: runs, the counters, and the average latency in whole seconds (half up; NULL without calls)."""
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("bigint")
    return runs.agg(total("runs").alias("runs"), *[total(c).alias(c) for c in COUNTERS]).withColumn(
        "avg_seconds",
        F.when(F.col("llm_calls") > 0, F.floor(F.col("llm_ms") / F.col("llm_calls") / 1000 + 0.5).cast("bigint")),
    )


def packages_per_source(packages: DataFrame) -> DataFrame:
    return (
        packages.groupBy(F.coalesce(F.nullif("source", F.lit("")), F.lit("?")).alias("source"))
        .agg(F.count(F.lit(1)).alias("packages")).orderBy(F.col("packages").desc(), "source")
    )


def scores_line(packages: DataFrame) -> DataFrame:
    """One row: how many carry a whole-number verdict, and the label of the best one (first on a tie)."""
    scored = packages.filter(text_or_blank("llm_score").rlike("^[0-9]+$"))
    number = F.col("llm_score").try_cast("int")
    return scored.agg(
        F.count(F.lit(1)).alias("scored"),
        F.max_by("label", F.struct(number, -F.col("seq"))).alias("top_label"), F.max(number).alias("top_score"),
    )


def scores_per_model(packages: DataFrame) -> DataFrame:
    scored = packages.filter(text_or_blank("llm_score").rlike("^[0-9]+$"))
    model = F.coalesce(F.nullif("llm_model", F.lit("")), F.lit("unknown"))
    return scored.groupBy(model.alias("model")).agg(F.count(F.lit(1)).alias("scored"))
