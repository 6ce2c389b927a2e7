"""Packages after they are written: probing, closing, archiving, pruning, user state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner import fixed
from gleaner.functions.text import text_or_blank
from gleaner.functions.urls import board_of
from gleaner.operators.skew import first_rows, ranked


def _ago(now: Column, days: int) -> Column:
    return now - F.make_interval(days=F.lit(days))


def is_closed(source, status, html) -> Column:
    """404 and 410 close anywhere; 200 closes only on the board's own markup; anything else says nothing."""
    source, status = F.col(source), F.col(status)
    marked = F.lit(False)
    for name, _, _, host, marker, *_ in fixed.BOARDS:
        if marker:
            marked = marked | ((source == name) & text_or_blank(html).rlike(marker))
    return F.when(status.isin(404, 410), True).when(status != 200, False).otherwise(marked)


def latest_state(state: DataFrame) -> DataFrame:
    """One row per url, so that a join with it never doubles a card: the latest, of equal stamps the smaller status."""
    stamp = [F.col("updated_at").desc_nulls_last()] if "updated_at" in state.columns else []
    return first_rows(state, ["url"], [*stamp, F.col("status")])


def probe_candidates(
    packages: DataFrame, state: DataFrame, probes: DataFrame, now: Column,
    budget: int, recheck_days: int = fixed.RECHECK_DAYS, retry_days: int = fixed.RETRY_DAYS,
) -> DataFrame:
    """(seq, url, board, last_probe, probe_rank, deferred): all New or Viewed cards due for a probe, longest unprobed first.

    state: url, status. probes: url, checked_at, tried_at. The run probes the first ``budget``; the others are deferred.
    Ranks are numbered inside chunks of one hour of last probes and one range of arrivals.
    """
    on_board = packages.withColumn("board", board_of("source", F.col("url"))).filter(F.col("board").isNotNull())
    unique = first_rows(on_board.select("seq", "url", "board"), ["url"], [F.col("seq")])
    epoch = F.lit("1970-01-01 00:00:00").cast("timestamp")
    last, tried = F.coalesce("checked_at", epoch), F.coalesce("tried_at", epoch)
    due = (
        unique.join(latest_state(state).select("url", "status"), "url", "left").join(probes, "url", "left")
        .filter(F.col("status").isNull() | (F.col("status") == "viewed"))
        .filter((last <= _ago(now, recheck_days)) & (tried <= _ago(now, retry_days)))
        .withColumn("last_probe", F.greatest(last, tried))
    )
    chunk = F.struct(F.date_trunc("hour", F.col("last_probe")).alias("a"), F.when(F.col("last_probe") == epoch, F.floor(F.col("seq") / 65536)).otherwise(0).alias("b"))
    placed = ranked(due, [], chunk, [F.col("last_probe"), F.col("seq")], "probe_rank")
    return placed.select("seq", "url", "board", "last_probe", "probe_rank", (F.col("probe_rank") > budget).alias("deferred"))


def reprobe_list(packages: DataFrame, state: DataFrame, probes: DataFrame, now: Column) -> DataFrame:
    """(url, board): closed on a 404 at least a day ago, still closed, no unanswered second look since.

    probes: url, tried_at, gone_at.
    """
    on_board = packages.withColumn("board", board_of("source", F.col("url"))).filter(F.col("board").isNotNull())
    before = _ago(now, fixed.RETRY_DAYS)
    closed = state.filter(F.col("status") == "closed").select("url")
    due = probes.filter(
        (F.col("gone_at") <= before) & (F.col("tried_at").isNull() | (F.col("tried_at") <= before))
    ).select("url")
    unique = first_rows(on_board.select("seq", "url", "board"), ["url"], [F.col("seq")])
    return unique.join(closed, "url", "left_semi").join(due, "url", "left_semi").select("seq", "url", "board")


def archive_plan(packages: DataFrame, state: DataFrame, now: Column) -> DataFrame:
    """(file, reason): closed and viewed packages by their last touch, borderline ones by their own date.

    A missing stamp counts as old enough.
    """
    old = lambda ts, days: F.coalesce(F.col(ts) <= _ago(now, days), F.lit(True))
    joined = packages.join(latest_state(state).select("url", "status", "updated_at"), "url", "left")
    borderline = F.coalesce(F.col("tier") == "borderline", F.lit(False))
    reason = (
        F.when(borderline, F.when(old("generated", fixed.ARCHIVE_BORDERLINE_DAYS), "borderline"))
        .when((F.col("status") == "closed") & old("updated_at", fixed.ARCHIVE_CLOSED_DAYS), "closed")
        .when((F.col("status") == "viewed") & old("updated_at", fixed.ARCHIVE_VIEWED_DAYS), "viewed")
    )
    return joined.withColumn("reason", reason).filter("reason IS NOT NULL").select("file", "reason")


def mark_and_archive(packages: DataFrame, plan: DataFrame, state: DataFrame, now: Column) -> DataFrame:
    """Packages after the plan: archived set, closed_at written once on those archived as closed."""
    moved = plan.select("file", F.lit(True).alias("_moved"))
    closed = state.filter(F.col("status") == "closed").select("url", F.coalesce("updated_at", now).alias("_at"))
    return (
        packages.join(moved, "file", "left").join(closed, "url", "left")
        .withColumns({
            "closed_at": F.when(F.col("_moved"), F.coalesce("closed_at", "_at")).otherwise(F.col("closed_at")),
            "archived": F.col("archived") | F.coalesce("_moved", F.lit(False)),
        })
        .drop("_moved", "_at")
    )


def prunable(state: DataFrame, live: DataFrame, now: Column) -> DataFrame:
    """State rows with no live package, untouched for a day, without a note. No live packages at all prunes nothing."""
    stale = F.coalesce(F.col("updated_at") < _ago(now, fixed.PRUNE_DAYS), F.lit(True))
    some = live.limit(1).agg(F.count(F.lit(1))).scalar() > 0
    return (
        state.join(live.select("url"), "url", "left_anti")
        .filter(stale & (text_or_blank("note") == "") & some)
    )


def closed_set(packages: DataFrame, state: DataFrame) -> DataFrame:
    """Files whose vacancy is closed: by state for live packages, by their own mark for archived ones."""
    closed = state.filter(F.col("status") == "closed").select("url")
    live = packages.filter(~F.col("archived")).join(closed, "url", "left_semi")
    past = packages.filter(F.col("archived") & F.col("closed_at").isNotNull())
    return live.select("file").unionByName(past.select("file"))


def with_status(packages: DataFrame, state: DataFrame) -> DataFrame:
    """Adds status; no entry, or one this build does not know, reads as new."""
    known = latest_state(state).select("url", F.when(F.col("status").isin(fixed.STATUSES), F.col("status")).alias("status"))
    return packages.join(known, "url", "left").withColumn("status", F.coalesce("status", F.lit("new")))


# ---- user state -----------------------------------------------------------------

def clean_state(raw: DataFrame) -> DataFrame:
    """Entries without their virtual "new" status and empty note; entries with nothing left are dropped."""
    status = F.when((F.col("status") != "") & (F.col("status") != "new"), F.col("status"))
    note = F.nullif(F.col("note"), F.lit(""))
    return raw.withColumns({"status": status, "note": note}).filter("status IS NOT NULL OR note IS NOT NULL")


def state_rows(stores: DataFrame, body: str = "body") -> DataFrame:
    """(url, status, note, updated_at) of JSON state bodies: {url: {status, note, updatedAt}, "_meta": {...}}."""
    # each entry is read on its own: one that is no object is passed over, the others stay
    entries = F.from_json(body, "map<string,string>")
    rows = stores.select(F.explode(entries).alias("url", "raw")).filter(~F.col("url").isin("_meta", "__proto__"))
    rows = rows.withColumn("entry", F.from_json("raw", "struct<status:string,note:string,updatedAt:string>")).filter("entry IS NOT NULL")
    return clean_state(rows.select(
        "url", "entry.status", "entry.note", F.try_to_timestamp("entry.updatedAt").alias("updated_at")
    ))


def valid_patch() -> Column:
    """Known or virtual status, note within its length, no stamp from the future (columns: status, note, at, now)."""
    status_ok = F.col("status").isNull() | F.col("status").isin("new", *fixed.STATUSES)
    note_ok = F.col("note").isNull() | (F.length("note") <= fixed.NOTE_MAX)
    slack = F.make_interval(mins=F.lit(fixed.FUTURE_SLACK_MINUTES))
    return status_ok & note_ok & F.coalesce(F.col("at") <= F.col("now") + slack, F.lit(False))


def merge_state(state: DataFrame, patches: DataFrame, now: Column) -> DataFrame:
    """State after an ordered patch log (url, ord, status, note; NULL = field not in the patch).

    Per field the last patch that names it wins; "new" and "" clear it; an entry with neither is gone.
    """
    joined = state.join(last_fields(patches).withColumn("_patched", F.lit(True)), "url", "full")
    merged = joined.select("url", *patched_fields(), F.when(F.col("_patched"), now).otherwise(F.col("updated_at")).alias("updated_at"))
    return merged.filter("status IS NOT NULL OR note IS NOT NULL")


def last_fields(patches: DataFrame) -> DataFrame:
    """(url, p_status, p_note): what the last patch that names a field says. max_by over rows whose ord is NULL returns
    NULL: a field no patch names stays as it is."""
    last = lambda name: F.max_by(name, F.when(F.col(name).isNotNull(), F.col("ord")))
    return patches.groupBy("url").agg(last("status").alias("p_status"), last("note").alias("p_note"))


def patched_fields() -> tuple[Column, Column]:
    """Status and note of an entry (status, note) beside its ``last_fields``."""
    status = F.when(F.col("p_status").isNull(), F.col("status")).when(F.col("p_status") != "new", F.col("p_status"))
    return status.alias("status"), F.nullif(F.coalesce("p_note", "note"), F.lit("")).alias("note")


def offline_patches(local: DataFrame, edited: DataFrame) -> DataFrame:
    """Patches to push after edits made offline: only the edited fields, "new" / "" where the entry has none.

    local: url, status, note. edited: url, ord, fields (array of "status" / "note"). A status this build does
    not know was never edited here, so it is left out.
    """
    joined = edited.join(local, "url", "left")
    has = lambda name: F.array_contains("fields", name)
    foreign = F.col("status").isNotNull() & ~F.col("status").isin(fixed.STATUSES)
    return joined.select(
        "url", "ord",
        F.when(has("status") & ~foreign, F.coalesce("status", F.lit("new"))).alias("status"),
        F.when(has("note"), F.coalesce("note", F.lit(""))).alias("note"),
    )


def closures(found: DataFrame, state: DataFrame) -> DataFrame:
    """Closures still allowed against the state as it is now: no status, or viewed."""
    current = state.select("url", "status")
    return found.join(current, "url", "left").filter(F.col("status").isNull() | (F.col("status") == "viewed")).drop("status")


def reopenings(second_looks: DataFrame, state: DataFrame) -> DataFrame:
    """Urls to reopen: the board answers 200 without its marker, the card is still closed and untouched since.

    second_looks: url, source, status_code, html, gone_at. A touch within a minute of the closure is the closure itself.
    """
    answered = second_looks.filter((F.col("status_code") == 200) & ~is_closed("source", "status_code", "html"))
    current = state.select("url", "status", "updated_at")
    touched = F.col("updated_at") > F.col("gone_at") + F.make_interval(mins=F.lit(1))
    return answered.join(current, "url").filter((F.col("status") == "closed") & ~F.coalesce(touched, F.lit(False))).select("url")
