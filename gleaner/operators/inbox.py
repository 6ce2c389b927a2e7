"""Message threads: state, text, change detection, outcome, unread badge."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.functions.text import looks_like_job, text_or_blank
from gleaner.operators.skew import first_rows

WINDOW = 12


def thread_id(url, name, oldest) -> Column:
    """The id in the thread's url, else a hash of the name and the oldest message."""
    found = F.regexp_extract(text_or_blank(url), r"thread/([^/?#]+)", 1)
    hashed = F.left(F.sha1(F.concat(text_or_blank(name), F.lit("\n"), text_or_blank(oldest))), F.lit(12))
    return F.when(found != "", found).otherwise(F.concat(F.lit("name:"), hashed))


def message_key(thread, state) -> Column:
    thread = F.col(thread) if isinstance(thread, str) else thread
    return F.concat(thread, F.lit("#"), F.left(F.sha1(text_or_blank(state)), F.lit(12)))


def _text(c: str = "text") -> Column:
    return text_or_blank(c)


def thread_states(messages: DataFrame) -> DataFrame:
    """(thread, state, snippet, thread_text) from messages (thread, pos, incoming, text).

    Their messages count; a thread with none of theirs falls back to all of it. Each part is an aggregate
    with a map-side step; the joined text needs the last 12 messages only, picked before the shuffle.
    """
    theirs, any_text = F.col("incoming"), _text() != ""
    sums = messages.groupBy("thread").agg(
        F.count_if(theirs).alias("their_n"), F.count(F.lit(1)).alias("all_n"),
        F.max_by(_text(), F.when(theirs, F.col("pos"))).alias("their_last"), F.max_by(_text(), "pos").alias("all_last"),
        F.max_by(_text(), F.when(theirs & any_text, F.col("pos"))).alias("their_snippet"),
        F.max_by(_text(), F.when(any_text, F.col("pos"))).alias("all_snippet"),
    )
    last = first_rows(messages.select("thread", "pos", "incoming", "text"), ["thread", "incoming"], [F.col("pos").desc()], WINDOW)
    def joined(rows: Column) -> Column:
        tail = F.reverse(F.slice(F.reverse(F.array_sort(rows)), 1, WINDOW))
        return F.array_join(F.filter(F.transform(tail, lambda m: m["text"]), lambda t: t != ""), "\n")
    item = F.struct(F.col("pos"), _text().alias("text"))
    # At most 12 rows per thread and direction arrive here.
    texts = last.groupBy("thread").agg(
        joined(F.collect_list(F.when(theirs, item))).alias("their_text"), joined(F.collect_list(item)).alias("all_text"),
    )
    own = F.col("their_n") > 0
    either = lambda a, b: F.coalesce(F.when(own, F.col(a)).otherwise(F.col(b)), F.lit(""))
    return sums.join(texts, "thread").select(
        "thread",
        F.concat(F.when(own, F.col("their_n")).otherwise(F.col("all_n")).cast("string"), F.lit("\n"), either("their_last", "all_last")).alias("state"),
        either("their_snippet", "all_snippet").alias("snippet"),
        either("their_text", "all_text").alias("thread_text"),
        F.col("all_n").alias("messages"),
    )


def changed_threads(states: DataFrame, seen: DataFrame) -> DataFrame:
    """Threads whose current state was not processed before (seen: key)."""
    keyed = states.withColumn("key", message_key("thread", F.col("state")))
    return keyed.join(seen.select("key"), "key", "left_anti")


def thread_outcomes(threads: DataFrame) -> DataFrame:
    """Adds action (already, retry, not-job, process) and mark_seen.

    threads: already_seen, extract_failed, messages, thread_text.
    """
    action = (
        F.when(F.col("already_seen"), "already")
        .when(F.col("extract_failed") | (F.col("messages") == 0), "retry")
        .when((text_or_blank("thread_text") == "") | ~looks_like_job("thread_text"), "not-job")
        .otherwise("process")
    )
    return threads.withColumn("action", action).withColumn("mark_seen", F.col("action").isin("already", "not-job"))


def fresh_threads(current: DataFrame, previous: DataFrame, key: str = "thread") -> DataFrame:
    return current.join(previous.select(key).distinct(), key, "left_anti")


def unread_threads(links: DataFrame) -> DataFrame:
    """(thread, label): thread id from the href, first non-empty label. links: (seq, href, label)."""
    found = links.withColumn("thread", F.regexp_extract("href", r"thread/([^/?#]+)", 1)).filter("thread <> ''")
    return found.groupBy("thread").agg(
        F.coalesce(F.min_by("label", F.struct(_text("label") == "", F.col("seq"))), F.lit("")).alias("label")
    )


def merge_pending(previous: DataFrame, notified: DataFrame) -> DataFrame:
    """(mailbox, id, label) pending after a scan: one row per thread, the newest label (rows: mailbox, id, label, at)."""
    both = previous.unionByName(notified)
    return both.groupBy("mailbox", "id").agg(F.max_by("label", "at").alias("label"), F.max("at").alias("at"))


def bag_matches(pending: DataFrame, unopened: DataFrame) -> DataFrame:
    """(mailbox, matched): unopened names use up pending labels one for one, as two counted tables."""
    a = pending.groupBy("mailbox", "label").agg(F.count(F.lit(1)).alias("held"))
    b = unopened.groupBy("mailbox", "label").agg(F.count(F.lit(1)).alias("open"))
    return (
        a.join(b, ["mailbox", "label"]).groupBy("mailbox").agg(F.sum(F.least("held", "open")).alias("matched"))
    )


def unread_badge(pending: DataFrame, unopened: DataFrame, scans: DataFrame) -> DataFrame:
    """(mailbox, count): pending threads plus unread ones neither opened nor pending. scans: mailbox, unread, opened."""
    held = pending.groupBy("mailbox").agg(F.countDistinct("id").alias("pending"))
    out = scans.join(held, "mailbox", "full").join(bag_matches(pending, unopened), "mailbox", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    extra = F.greatest(F.lit(0), zero("unread") - zero("opened"))
    return out.select("mailbox", (zero("pending") + F.greatest(F.lit(0), extra - zero("matched"))).cast("bigint").alias("count"))
