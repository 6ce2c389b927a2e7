"""Stored records: frontmatter files, run statistics, run logs, untyped values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner import fixed
from gleaner.functions.text import text_or_blank


def frontmatter_rows(files: DataFrame, body: str = "value") -> DataFrame:
    """Adds meta (map of the leading "---" block; the first ":" splits, the last key wins) and section.

    A file without a block has meta NULL: see ``frontmatter_rejects``. The section is the text between
    the cover markers.
    """
    text = F.regexp_replace(text_or_blank(body), "\r\n", "\n")
    block = F.regexp_extract(text, r"(?s)^---\n(.*?)\n---", 1)
    lines = F.filter(F.split(block, "\n"), lambda l: l.contains(":"))
    pairs = F.transform(lines, lambda l: F.struct(
        F.trim(F.substring_index(l, ":", 1)).alias("k"), F.trim(F.regexp_extract(l, r"(?s)^[^:]*:(.*)$", 1)).alias("v"),
    ))
    keys = F.array_distinct(F.transform(pairs, lambda p: p["k"]))
    meta = F.map_from_entries(F.transform(
        keys, lambda k: F.struct(k, F.element_at(F.filter(pairs, lambda p: p["k"] == k), -1)["v"])
    ))
    section = F.regexp_extract(text, r"(?s)<!--cover:start-->\s*(.*?)\s*<!--cover:end-->", 1)
    return files.withColumns({
        "meta": F.when(text.rlike(r"(?s)^---\n.*?\n---"), meta), "section": section,
    })


def frontmatter_rejects(rows: DataFrame) -> DataFrame:
    return rows.filter("meta IS NULL").drop("meta", "section")


def read_frontmatter(spark: SparkSession, path: str) -> DataFrame:
    """One row per file under ``path``."""
    files = spark.read.text(path, wholetext=True).select("value", F.col("_metadata.file_path").alias("file"))
    return frontmatter_rows(files)


RUN_STAT = "at string, considered bigint, written bigint, borderline bigint, dropped bigint, failed bigint, llmCalls bigint, llmMs bigint"


def run_stats(lines: DataFrame, since: Column | None = None, column: str = "value") -> DataFrame:
    """Typed counters of JSON lines; malformed lines and lines without a readable stamp are skipped."""
    parsed = lines.select(F.from_json(column, RUN_STAT).alias("r")).filter("r IS NOT NULL").select("r.*")
    stamped = parsed.withColumn("at", F.try_to_timestamp("at")).filter("at IS NOT NULL")
    kept = stamped if since is None else stamped.filter(F.col("at") >= since)
    return kept.withColumnsRenamed({"llmCalls": "llm_calls", "llmMs": "llm_ms"})


def log_counts(lines: DataFrame, column: str = "value") -> DataFrame:
    """(at, runs, considered, written, dropped, failed) per counted log line, anchored on its stamp.

    Control characters that could fake a line start become spaces first. An unreadable stamp keeps the line, at = NULL.
    """
    line = F.regexp_replace(text_or_blank(column), fixed.LOG_FORGEABLE, " ")
    done, dropped, failed = (F.regexp_extract(line, f"^{p}", 0) != "" for p in (fixed.LOG_DONE, fixed.LOG_DROPPED, fixed.LOG_FAILED))
    number = lambda i: F.when(done, F.regexp_extract(line, f"^{fixed.LOG_DONE}", i).try_cast("bigint")).otherwise(0)
    counted = lines.filter(done | dropped | failed)
    return counted.select(
        F.try_to_timestamp(F.regexp_extract(line, f"^{fixed.LOG_STAMP}", 1)).alias("at"),
        done.cast("bigint").alias("runs"), number(2).alias("considered"), number(3).alias("written"),
        dropped.cast("bigint").alias("dropped"), failed.cast("bigint").alias("failed"),
    )


def log_totals(counts: DataFrame, since: Column | None = None, until: Column | None = None) -> DataFrame:
    keep = F.lit(True)
    if since is not None:
        keep = keep & (F.col("at") >= since)
    if until is not None:
        keep = keep & (F.col("at") < until)
    names = ["runs", "considered", "written", "dropped", "failed"]
    return counts.filter(F.coalesce(keep, F.lit(True))).agg(*[F.coalesce(F.sum(c), F.lit(0)).cast("bigint").alias(c) for c in names])


# ---- untyped values ----------------------------------------------------------------

def number_in(value: Column, fallback: float, lo: float, hi: float) -> Column:
    """A number or numeric string clamped to [lo, hi]; anything else is the fallback."""
    n = F.trim(value).try_cast("double")
    usable = n.isNotNull() & ~F.isnan(n) & (F.abs(n) != float("inf"))
    return F.when(usable, F.least(F.lit(float(hi)), F.greatest(F.lit(float(lo)), n))).otherwise(F.lit(float(fallback)))


def flag(value: Column, fallback: bool) -> Column:
    s = F.lower(F.trim(value))
    return F.when(s == "true", True).when(s == "false", False).otherwise(fallback)


def coerce_numbers(df: DataFrame, rules: dict[str, tuple[float, float, float]]) -> DataFrame:
    """Every named string column as a number by its rule (fallback, lo, hi)."""
    return df.withColumns({name: number_in(F.col(name), *rule) for name, rule in rules.items()})


def number_issues(df: DataFrame, key: str, rules: dict[str, tuple[float, float, float]]) -> DataFrame:
    """(key, column_name, value, used, issue): one row per corrected value; absent values need no correction."""
    def issue(name: str, rule) -> Column:
        value, used = F.col(name), number_in(F.col(name), *rule)
        n = F.trim(value).try_cast("double")
        finite = n.isNotNull() & ~F.isnan(n) & (F.abs(n) != float("inf"))
        what = F.when(value.isNull(), None).when(~finite, "not a number").when(n != used, "out of range")
        return F.when(what.isNotNull(), F.struct(
            F.lit(name).alias("column_name"), value.alias("value"), used.alias("used"), what.alias("issue")
        ))

    problems = F.array_compact(F.array(*[issue(n, r) for n, r in rules.items()]))
    return df.select(key, F.explode(problems).alias("p")).select(key, "p.*")
