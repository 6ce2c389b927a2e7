"""External verdicts: budget, bounding, the second gate, the caller's own judge."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner import fixed
from gleaner.functions.text import injection_markers, screening_block, text_or_blank, with_screening_block


def numeric_score(c, number: Column | None = None) -> Column:
    """Digits, optionally with decimals; anything else is no score (NULL is not 0).

    Where ``number`` says that the answer held a number and not a string, any finite number is a score, negative ones too.
    """
    s = F.trim(F.col(c) if isinstance(c, str) else c)
    digits = F.when(s.rlike(r"^[0-9]{1,15}(\.[0-9]+)?$"), s.cast("double"))
    if number is None:
        return digits
    value = s.try_cast("double")
    return F.when(F.coalesce(number, F.lit(False)), F.when(F.abs(value) < float("inf"), value)).otherwise(digits)


def answer_score(answer) -> tuple[Column, Column]:
    """(score as text, whether it is a JSON number) of a judge's JSON answer; an answer that is no JSON has neither."""
    found = F.try_variant_get(F.try_parse_json(answer), "$.score", "variant")
    kind = F.schema_of_variant(found)
    return F.try_variant_get(F.try_parse_json(answer), "$.score", "string"), kind.isin("BIGINT", "DOUBLE") | kind.startswith("DECIMAL")


def bound_score(c, number: Column | None = None) -> Column:
    """Half-up rounding, clamped to 0..100; no score stays NULL (least and greatest would skip it)."""
    n = numeric_score(c, number)
    return F.when(n.isNotNull(), F.floor(F.least(F.lit(100.0), F.greatest(F.lit(0.0), n)) + 0.5).cast("int"))


def bound_verdicts(raw: DataFrame) -> DataFrame:
    """(id, llm_score, why, red_flags, cover, model): only these fields, bounded; no score, no verdict.

    A column ``number``, if there, says which scores were numbers in the answer, not strings.
    """
    return raw.select(
        "id",
        bound_score("score", F.col("number") if "number" in raw.columns else None).alias("llm_score"),
        F.left(text_or_blank("why"), F.lit(fixed.WHY_CAP)).alias("why"),
        F.transform(
            F.slice(F.coalesce("red_flags", F.array().cast("array<string>")), 1, fixed.FLAGS_CAP),
            lambda f: F.left(f, F.lit(fixed.FLAG_CAP)),
        ).alias("red_flags"),
        text_or_blank("cover").alias("cover"),
        "model",
    )


def within_budget(matches: DataFrame, budget: int) -> DataFrame:
    """The ``budget`` best matches by score, earlier ones first on a tie (TakeOrderedAndProject, no global sort)."""
    return matches.orderBy(F.col("score").desc(), F.col("seq")).limit(budget)


def split_by_budget(matches: DataFrame, budget: int) -> DataFrame:
    """All matches with deferred = past the budget."""
    kept = within_budget(matches.select("seq", "score"), budget).select("seq", F.lit(False).alias("_in"))
    return matches.join(kept, "seq", "left").withColumn("deferred", F.col("_in").isNull()).drop("_in")


def with_suspect_count(matches: DataFrame, out: str = "marks") -> DataFrame:
    """Adds how many patterns of the screened block address the screener. The block is a column of its own, so it
    is built once and not again on each side of the Unicode step."""
    return with_screening_block(matches, "_block").withColumn(out, F.size(injection_markers("_block"))).drop("_block")


def join_verdicts(matches: DataFrame, verdicts: DataFrame) -> DataFrame:
    """A match without a verdict keeps NULL: failed, not rejected."""
    return matches.join(verdicts, "id", "left")


def verdict_gate(
    judged: DataFrame, min_score: int, borderline_min: int, on: bool = True,
) -> DataFrame:
    """Adds action (write, borderline, drop, defer, hold), tier and stamped.

    Input columns: llm_score, suspect (boolean), retry (text too short), retry_first and title_first
    (the "llm-retry:" / "title-only-llm:" marker is not in the store yet).
    """
    if not on:
        return judged.withColumns({
            "action": F.lit("write"), "tier": F.lit(None).cast("string"), "stamped": F.lit(True),
        })
    band = min_score > 0 and 0 < borderline_min < min_score
    missing = F.col("llm_score").isNull()
    rejects = ~missing & (F.col("llm_score") < min_score)
    waits = (rejects & F.lit(band) & (F.col("llm_score") >= borderline_min)) | (F.col("suspect") & rejects)
    waits = waits | (missing & F.lit(min_score > 0))
    held = waits & F.col("retry") & F.col("title_first")
    action = (
        F.when(missing & F.col("retry_first"), "defer")
        .when(held, "hold")
        .when(waits, "borderline")
        .when(rejects, "drop")
        .otherwise("write")
    )
    out = judged.withColumn("action", action)
    second_look = F.col("retry") & F.col("title_first")
    return out.withColumns({
        "tier": F.when(F.col("action") == "borderline", "borderline"),
        "stamped": F.when(F.col("action").isin("defer", "hold"), False)
        .when(F.col("action") == "drop", ~second_look).otherwise(True),
    })


def run_counters(gated: DataFrame) -> DataFrame:
    """One row: written, borderline, dropped, failed, deferred, fallback."""
    missing = F.col("llm_score").isNull()
    action = F.col("action")
    return gated.agg(
        F.count_if(action == "write").alias("written"),
        F.count_if(action == "borderline").alias("borderline"),
        F.count_if(action == "drop").alias("dropped"),
        F.count_if(missing).alias("failed"),
        F.count_if(missing & (action == "defer")).alias("deferred"),
        F.count_if(missing & (action != "defer")).alias("fallback"),
    )


Judge = Callable[[str], str | None]


def judge_with(matches: DataFrame, judge: Judge, budget: int, concurrency: int) -> DataFrame:
    """Run the caller's judge on the budgeted matches only: (seq, answer, failed, millis).

    A call that raises gives a NULL answer, never a failed job. ``concurrency`` is the number of
    tasks, hence of calls in flight. The budget bounds the input, so this is never a hot group.
    """
    prompts = within_budget(matches, budget).select(
        "seq", screening_block("title", "company", "location", "text").alias("prompt")
    )

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for seq, prompt in zip(batch["seq"], batch["prompt"]):
                start = time.monotonic()
                try:
                    answer = judge(prompt)
                except Exception:  # noqa: BLE001  the caller's code may raise anything
                    answer = None
                rows.append((seq, answer, answer is None, int((time.monotonic() - start) * 1000)))
            yield pd.DataFrame(rows, columns=["seq", "answer", "failed", "millis"])

    return prompts.repartition(concurrency, "seq").mapInPandas(
        ask, "seq bigint, answer string, failed boolean, millis bigint"
    )


def top_written(written: DataFrame) -> DataFrame:
    """One row: the label of the best keyword score, the first one on a tie."""
    return written.agg(F.max_by("label", F.struct("score", -F.col("seq"))).alias("top_label"), F.max("score").alias("top_score"))


def banner_labels(written: DataFrame, n: int = 3) -> DataFrame:
    """The n strongest matches; a verdict outranks any keyword score; borderline ones are never named."""
    strength = F.when(F.col("llm_score").isNotNull(), 1000 + F.col("llm_score")).otherwise(F.col("score"))
    return (
        written.filter(F.coalesce("tier", F.lit("")) != "borderline")
        .withColumn("strength", strength)
        .orderBy(F.col("strength").desc(), "seq").limit(n)
    )
