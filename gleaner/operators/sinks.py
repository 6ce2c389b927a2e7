"""Tables this engine writes."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner import fixed
from gleaner.functions.text import detect_lang, extract_salary, squeeze, text_or_blank
from gleaner.functions.urls import is_http_url
from gleaner.operators.lifecycle import archive_plan, mark_and_archive
from gleaner.session import cut_lineage
from gleaner.sources.parts import PartTable


def package_rows(accepted: DataFrame, now: Column) -> DataFrame:
    """One typed row per accepted posting (scored, with verdict columns), ready to be written.

    Further listings of the vacancy are rows of their own (``run.package_links``): there may be any number of them.
    """
    blank = lambda c: F.coalesce(F.nullif(squeeze(c), F.lit("")), F.lit(fixed.BLANK_FIELD))
    flags = F.array_join("red_flags", "; ")
    why = F.concat_ws(" ", F.nullif(F.trim("why"), F.lit("")), F.when(F.size("red_flags") > 0, F.concat(F.lit("⚠ "), flags)))
    return accepted.select(
        "seq", squeeze("source").alias("source"), squeeze("title").alias("title"), blank("company").alias("company"),
        blank("location").alias("location"), squeeze("url").alias("url"), squeeze(extract_salary("text")).alias("salary"),
        *fixed.DATE_KINDS, now.alias("generated"), detect_lang("text").alias("cover_language"), "score",
        F.coalesce("matched_role", F.lit(fixed.BLANK_FIELD)).alias("matched_role"),
        F.coalesce(F.nullif(F.array_join("matched_skills", ", "), F.lit("")), F.lit(fixed.BLANK_FIELD)).alias("matched_skills"),
        F.coalesce(F.nullif(F.array_join("penalties", ", "), F.lit("")), F.lit(fixed.BLANK_FIELD)).alias("penalties"),
        "llm_score", F.when(F.col("llm_score").isNotNull(), F.nullif(squeeze(why), F.lit(""))).alias("llm_why"), "tier", "reposts",
        F.when(F.col("reposts").isNotNull(), F.nullif(squeeze("repost_url"), F.lit(""))).alias("reposted_from"),
        F.when(F.col("llm_score").isNotNull(), F.nullif(squeeze("model"), F.lit(""))).alias("llm_model"),
        F.when(F.col("marks") > 0, F.concat(F.lit("injection ("), F.col("marks").cast("string"), F.when(F.col("marks") == 1, " marker)").otherwise(" markers)"))).alias("llm_suspect"),
        F.lit(False).alias("archived"), F.to_date(now).alias("day"),
    )


def write_packages(rows: DataFrame, path: str) -> None:
    """Append, one folder per (archived, day): readers prune to the live days they need.

    Rows are spread by seq inside a day, so one busy day is many files, not one task.
    """
    rows.repartition("day", F.pmod(F.col("seq"), F.lit(64))).write.mode("append").partitionBy("archived", "day").parquet(path)


def package_part() -> Column:
    """The part of a package row: live or archived, and its day."""
    return F.concat(F.when(F.col("archived"), "archived/").otherwise("live/"), F.date_format("day", "yyyy-MM-dd"))


def package_store(spark: SparkSession, path: str, schema: str) -> PartTable:
    """Packages by part, each day live and archived; ``schema`` names at least archived and day."""
    return PartTable(spark, path, schema, package_part())


def archive_run(store: PartTable, state: DataFrame, now: Column) -> int:
    """Mark and move what is due: live days that lose rows and archived days that gain some change in one step.

    Days that nothing leaves are neither read twice nor written; a live day without rows left is dropped. Run again, also
    after a run that was killed, it moves what is still due. Returns the store's version.
    """
    live = store.read(lambda part: part.startswith("live/"))
    plan = cut_lineage(archive_plan(live, state, now))
    days = store.names_of(live.join(plan, "file", "left_semi"))
    after = mark_and_archive(live.filter(package_part().isin(days)), plan, state, now).select(*live.columns)
    return store.commit(append=after.filter("archived"), replace=after.filter("NOT archived"), parts=days)


def alt_links_after(packages: DataFrame, links: DataFrame) -> DataFrame:
    """(file, source, url, is_new): links of each package, one row each, after adding ``links``.

    packages: (file, url). links: (file, ord, source, url, stored): stored ones stay; an incoming one is
    added once, unless it is the package's own url, already there, or not safe in a "source|url" list.
    """
    safe = lambda c: (text_or_blank(c) != "") & ~text_or_blank(c).rlike(r"[|,\s\p{Z}]")
    incoming = links.filter(F.col("stored") | (safe("source") & safe("url")))
    first = incoming.groupBy("file", "url").agg(
        F.min_by("source", F.struct(~F.col("stored"), F.col("ord"))).alias("source"), F.max("stored").alias("kept")
    )
    own = packages.select("file", "url").withColumn("_own", F.lit(True))
    return (
        first.join(own, ["file", "url"], "left").filter(F.col("kept") | F.col("_own").isNull())
        .select("file", "source", "url", (~F.col("kept")).alias("is_new"))
    )


def run_stats_after(stats: DataFrame, row: DataFrame, keep: int) -> DataFrame:
    """The stats table with one more run, last ``keep`` rows."""
    return stats.unionByName(row, allowMissingColumns=True).orderBy(F.col("at").desc()).limit(keep)


def alert_sink(path: str) -> Callable[[DataFrame, int], None]:
    """For ``writeStream.foreachBatch``: each micro-batch of an alert feed becomes one folder, named by its batch.

    A batch that runs again after a failure replaces its own folder, so every alert is there exactly once.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return write


def alert_feed(written: DataFrame, degraded: DataFrame, stale: DataFrame) -> DataFrame:
    """(kind, subject, detail, link): written matches, degraded sources and stale jobs in one feed."""
    matches = written.filter(F.coalesce("tier", F.lit("")) != "borderline").select(
        F.lit("match").alias("kind"), F.concat_ws(" @ ", "title", "company").alias("subject"),
        F.concat(F.lit("score "), F.col("score").cast("string"), F.coalesce(F.concat(F.lit(" / verdict "), F.col("llm_score").cast("string")), F.lit(""))).alias("detail"),
        F.when(is_http_url("url"), F.col("url")).alias("link"),
    )
    sources = degraded.select(
        F.lit("source").alias("kind"), F.col("source").alias("subject"),
        F.when(F.col("reason") == "never-succeeded", F.concat(F.lit("never returned results in "), F.col("runs_before").cast("string"), F.lit(" runs")))
        .otherwise(F.concat(F.col("found").cast("string"), F.lit(" found, recent median "), F.col("median").cast("string"))).alias("detail"),
        F.lit(None).cast("string").alias("link"),
    )
    jobs = stale.select(
        F.lit("job").alias("kind"), F.col("job").alias("subject"),
        F.concat(F.lit("no successful run for "), F.col("hours").cast("string"), F.lit(" h while "), F.col("runs").cast("string"), F.lit(" other runs finished")).alias("detail"),
        F.lit(None).cast("string").alias("link"),
    )
    return matches.unionByName(sources).unionByName(jobs)
