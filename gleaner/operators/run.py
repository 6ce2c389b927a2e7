"""One whole run: what the keyword gate let through is judged once, budgeted, judged, packaged and stamped.

Everything is a table of one row a posting, so the way of each posting through the run can be read off ``lineage``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.functions.urls import is_http_url
from gleaner.operators.gate import first_time, judge_once, stamp_keys
from gleaner.operators.verdicts import split_by_budget, verdict_gate

#: Store keys that mark a first "no": on the title alone, by the keyword gate or the verdict, and a verdict that failed.
TITLE_ONLY, TITLE_ONLY_VERDICT, RETRY = "title-only-kw:", "title-only-llm:", "llm-retry:"


def judged_matches(decisions: DataFrame, seen: DataFrame, verdicts: DataFrame, budget: int, min_score: int, borderline_min: int) -> tuple[DataFrame, DataFrame]:
    """(matches, judged): every match with the one that is judged for its identity, and those with their action.

    ``decisions``: the keyword gate's rows. ``verdicts``: (seq, llm_score, suspect, ...). Past the budget the action is
    ``deferred``; a match without a verdict is a failed call, never a rejection.
    """
    once = judge_once(decisions.filter("kind = 'match'"))
    own = split_by_budget(once.filter("outcome = 'judged'"), budget)
    for marker, name in ((RETRY, "retry_first"), (TITLE_ONLY_VERDICT, "title_first")):
        own = first_time(own, seen, marker).withColumnRenamed("first_time", name).drop("marker")
    found = own.join(verdicts, "seq", "left").withColumn("suspect", F.coalesce("suspect", F.lit(False)))
    gated = verdict_gate(found, min_score, borderline_min)
    late = F.col("deferred")
    return once, gated.withColumns({
        "action": F.when(late, "deferred").otherwise(F.col("action")), "tier": F.when(~late, F.col("tier")),
        "stamped": F.col("stamped") & ~late,
    })


def lineage(plan: DataFrame, decisions: DataFrame, once: DataFrame, judged: DataFrame, seen: DataFrame) -> DataFrame:
    """(seq, component, role, keeper_seq, kind, score, judged_seq, action, tier, stamped, package_seq) of every posting.

    A folded copy shares its keeper's way, an identity's further matches that of the judged one.
    """
    kept = first_time(decisions, seen, TITLE_ONLY).select("seq", "id", "kind", "score", "retry", "first_time")
    fate = judged.select(F.col("seq").alias("judged_seq"), "action", "tier", F.col("stamped").alias("_stamped"))
    ways = kept.join(once.select("seq", "judged_seq"), "seq", "left").join(fate, "judged_seq", "left")
    held = F.col("retry") & F.col("first_time")  # turned down on the title alone, for the first time
    ways = ways.select(
        F.col("seq").alias("keeper_seq"), "kind", "score", "judged_seq", "action", "tier",
        F.when(F.col("kind") == "match", F.coalesce("_stamped", F.lit(False))).otherwise(~held).alias("stamped"),
        F.when(F.col("action").isin("write", "borderline"), F.col("judged_seq")).alias("package_seq"),
    )
    return plan.join(ways, "keeper_seq").select("seq", "component", "role", *ways.columns)


def package_links(ways: DataFrame, keyed: DataFrame) -> DataFrame:
    """(package_seq, seq, source, url): where else a package's vacancy is listed, one row a listing, however many there are."""
    others = ways.filter("package_seq IS NOT NULL AND seq <> package_seq").select("package_seq", "seq")
    safe = is_http_url("url") & ~F.col("url").rlike(r"[|,\s\p{Z}]")
    return others.join(keyed.select("seq", "source", "url"), "seq").filter(safe).select("package_seq", "seq", "source", "url")


def run_stamps(decisions: DataFrame, ways: DataFrame, judged: DataFrame, seen: DataFrame, copies: DataFrame) -> DataFrame:
    """(key): what the run writes to the seen store: identities, repost marks, and the marks of a first "no"."""
    own = ways.filter("role = 'keeper'").select(F.col("seq"), "stamped", "judged_seq")
    done = decisions.join(own, "seq").filter("stamped")
    # of matches that were not judged themselves, only a repost's own mark goes along
    further = (F.col("kind") == "match") & (F.col("judged_seq") != F.col("seq")) & F.col("repost_file").isNull()
    keys = stamp_keys(done.withColumn("link", F.when(further, "").otherwise(F.col("link"))), seen, copies)
    mark = lambda rows, marker: rows.select(F.concat(F.lit(marker), "id").alias("key"))
    low = decisions.join(own.filter("NOT stamped"), "seq").filter("kind <> 'match'")
    held = judged.filter("action = 'hold' OR (action = 'drop' AND NOT stamped)")
    marks = mark(low, TITLE_ONLY).union(mark(judged.filter("action = 'defer'"), RETRY)).union(mark(held, TITLE_ONLY_VERDICT))
    return keys.union(marks).distinct()
