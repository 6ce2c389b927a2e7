"""Message threads over conversations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner import fixed
from gleaner.operators import inbox as ib
from gleaner.operators.scoring import score_text
from gleaner.plans import sqlviews as s
from gleaner.plans.registry import query
from gleaner.plans.views import PROFILE, Tables

_POOL = "SELECT *, bool_or(incoming) OVER (PARTITION BY thread) AS own, count(*) OVER (PARTITION BY thread) AS all_n FROM messages"
_STATES = """SELECT thread, count(*) || chr(10) || arg_max(text, pos) AS state, coalesce(arg_max(text, pos) FILTER (text <> ''), '') AS snippet, any_value(all_n) AS messages,
  array_to_string(list_filter(list_reverse(list(text ORDER BY pos DESC)[1:12]), lambda x: x <> ''), chr(10)) AS thread_text FROM pool WHERE incoming OR NOT own GROUP BY thread"""


def states(select: str, **extra: str) -> str:
    return s.sql(select, "messages", pool=_POOL, states=_STATES, **extra)


@query("agg_13_thread_state", states("SELECT thread, md5(state) AS state_md5, md5(snippet) AS snippet_md5, md5(thread_text) AS text_md5, messages FROM states"))
def thread_state(t: Tables) -> DataFrame:
    st = ib.thread_states(t.messages)
    return st.select("thread", F.md5("state").alias("state_md5"), F.md5("snippet").alias("snippet_md5"), F.md5("thread_text").alias("text_md5"), "messages")


@query("str_31_message_key", states("SELECT thread, thread || '#' || left(sha1(state), 12) AS key FROM states"))
def message_keys(t: Tables) -> DataFrame:
    return ib.thread_states(t.messages).select("thread", ib.message_key(F.col("thread").cast("string"), F.col("state")).alias("key"))


@query("str_31_thread_id", """
SELECT conv_id, turn, CASE WHEN conv_id % 2 = 0 THEN 'c' || conv_id ELSE 'name:' || left(sha1(role || chr(10) || text), 12) END AS thread FROM conversations""")
def thread_ids(t: Tables) -> DataFrame:
    url = F.when(F.col("conv_id") % 2 == 0, F.concat(F.lit("https://x.example/messaging/thread/c"), F.col("conv_id").cast("string"), F.lit("/?filter=unread#top")))
    return t.table("conversations").select("conv_id", "turn", ib.thread_id(url, F.col("role"), F.col("text")).alias("thread"))


@query("stm_06_changed_threads", states("SELECT thread FROM states WHERE thread % 3 <> 0"))
def changed(t: Tables) -> DataFrame:
    """Every third thread was processed in its present state; the others in an older one."""
    st = ib.thread_states(t.messages)
    key = ib.message_key("thread", F.when(F.col("thread") % 3 == 0, F.col("state")).otherwise(F.concat("state", F.lit("older"))))
    return ib.changed_threads(st, st.select(key.alias("key"))).select("thread")


@query("scr_12_thread_outcome", states(
    "SELECT thread, action, action IN ('already', 'not-job') AS mark_seen FROM (SELECT thread, CASE WHEN thread % 5 = 0 THEN 'already' WHEN thread % 7 = 0 THEN 'retry' WHEN thread_text = '' OR NOT ("
    + " OR ".join(f"contains(lower(thread_text), {s.lit(x)})" for x in fixed.JOB_SIGNALS) + ") THEN 'not-job' ELSE 'process' END AS action FROM states)"))
def outcomes(t: Tables) -> DataFrame:
    st = ib.thread_states(t.messages).withColumns({"already_seen": F.col("thread") % 5 == 0, "extract_failed": F.col("thread") % 7 == 0})
    return ib.thread_outcomes(st).select("thread", "action", "mark_seen")


@query("scr_12_thread_score", states("SELECT thread, score FROM threads", threads=s.scored("(SELECT thread, lower(thread_text) AS hay FROM states)")))
def thread_scores(t: Tables) -> DataFrame:
    st = ib.thread_states(t.messages).select("thread", F.col("thread_text").alias("text"))
    return score_text(st, PROFILE).select("thread", "score")


@query("joi_11_fresh_threads", "SELECT DISTINCT conv_id AS thread FROM conversations WHERE turn >= 3 AND conv_id NOT IN (SELECT conv_id FROM conversations WHERE turn >= 6)")
def fresh(t: Tables) -> DataFrame:
    now = t.messages.filter("pos >= 3").select("thread").distinct()
    return ib.fresh_threads(now, t.messages.filter("pos >= 6").select("thread"))


def mailboxes(t: Tables) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Ten mailboxes: user turns are pending, assistant turns unopened names, counts per mailbox the scan."""
    m = t.table("conversations").select(
        (F.col("conv_id") % 10).alias("mailbox"), F.col("conv_id").alias("id"), F.concat(F.lit("n"), (F.length("text") % 7).cast("string")).alias("label"),
        (F.col("conv_id") * 100 + F.col("turn")).alias("at"), "role", "turn",
    )
    pending = ib.merge_pending(m.filter("role = 'user' AND turn < 2").select("mailbox", "id", "label", "at"), m.filter("role = 'user' AND turn >= 2").select("mailbox", "id", "label", "at"))
    unopened = m.filter("role = 'assistant'").select("mailbox", "label")
    scans = m.groupBy("mailbox").agg(F.count(F.lit(1)).alias("unread"), F.count_if(F.col("role") == "system").alias("opened"))
    return pending, unopened, scans


_BOXES = dict(
    m="SELECT conv_id % 10 AS mailbox, conv_id AS id, 'n' || (length(text) % 7) AS label, role, turn FROM conversations",
    pending="SELECT mailbox, id, arg_max(label, turn) AS label FROM m WHERE role = 'user' GROUP BY 1, 2",
    bag="""SELECT mailbox, sum(least(h, o))::BIGINT AS matched FROM (SELECT mailbox, label, count(*) AS h FROM pending GROUP BY 1, 2)
      JOIN (SELECT mailbox, label, count(*) AS o FROM m WHERE role = 'assistant' GROUP BY 1, 2) USING (mailbox, label) GROUP BY 1""",
)


@query("stm_07_pending", s.sql("SELECT mailbox, id, label FROM pending", **_BOXES))
def pending(t: Tables) -> DataFrame:
    return mailboxes(t)[0].select("mailbox", "id", "label")


@query("joi_12_bag_match", s.sql("SELECT * FROM bag", **_BOXES))
def bags(t: Tables) -> DataFrame:
    pending_, unopened, _ = mailboxes(t)
    return ib.bag_matches(pending_, unopened)


@query("agg_12_unread_badge", s.sql("""
SELECT mailbox, (p + greatest(0, unread - opened - coalesce(matched, 0)))::BIGINT AS count FROM (SELECT mailbox, count(*) AS unread, count(*) FILTER (role = 'system') AS opened FROM m GROUP BY 1)
JOIN (SELECT mailbox, count(*) AS p FROM pending GROUP BY 1) USING (mailbox) LEFT JOIN bag USING (mailbox)""", **_BOXES))
def badge(t: Tables) -> DataFrame:
    return ib.unread_badge(*mailboxes(t))
