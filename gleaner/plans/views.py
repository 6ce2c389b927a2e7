"""The given tables in the roles the operators expect: postings, packages, state, runs, messages.

Each view is a projection (or one aggregation) of a whole table. "Now" is a literal, never the clock.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.functions.keys import compose_unicode, with_chars, with_keys
from gleaner.operators.profile import Profile
from gleaner.session import SETTINGS, cut_lineage

NOW = "2024-02-01 00:00:00"
ORDERS_NOW = "2000-06-01 00:00:00"
EVENTS_NOW = "2024-01-31 00:00:00"
BOARDS = ["dou", "djinni", "himalayas", "tgchannels", "linkedin"]
LOCATIONS = [
    "Remote · Ukraine", "Remote · Worldwide", "Remote · Poland, Canada", "Kyiv",
    "Warsaw (Poland), remote", "Office · Germany",
]
EXCLUDED_PLACES = ["poland", "germany"]
EXCLUDED_TITLES = ["von", "that", "la"]
MIN_SCORE = 18

# Terms that are frequent in the given documents, so every rule of the profile takes part.
PROFILE = Profile(
    roles=["of the", "in the", "de la", "und der", "en la"],
    skills={
        "the": 5, "of": 5, "and": 4, "de": 4, "la": 4, "und": 4, "die": 3, "en": 3, "le": 3, "que": 2,
        "that": 2, "der": 2, "with": 1, "con": 1,
    },
    synonyms={"and": ["et", "y"], "the": ["les", "los"]},
    penalties={"nicht": -4, "pour": -3, "this": -2},
)


def stamp(text: str) -> Column:
    return F.lit(text).cast("timestamp")


def shown(ts) -> Column:
    """A stamp as text, the same in every engine."""
    return F.date_format(ts, "yyyy-MM-dd HH:mm:ss")


TEXT_TABLES = {"documents": "doc_id", "pages": "page_id"}


#: Session setting: partitions that text tables are dealt into before the work starts. Unset, they are read as they are;
#: it is for tables of one small file, whose CPU-bound text work would else run in one task.
TEXT_PARTITIONS = "spark.gleaner.textPartitions"


def spread(rows: DataFrame, key: str) -> DataFrame:
    wanted = rows.sparkSession.conf.get(TEXT_PARTITIONS, None)
    return rows.repartition(int(wanted), key) if wanted else rows


class Tables:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir
        spark.conf.set("spark.sql.session.timeZone", SETTINGS["spark.sql.session.timeZone"])

    def table(self, name: str) -> DataFrame:
        rows = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        return spread(rows, TEXT_TABLES[name]) if name in TEXT_TABLES else rows

    # ---- documents ------------------------------------------------------------

    @cached_property
    def postings(self) -> DataFrame:
        """Title = the first three words, company = the fourth with a legal form; the text is the whole document."""
        d = self.table("documents")
        doc = F.col("doc_id")
        w = F.filter(F.split(F.regexp_replace("text", r"^\s+", ""), r"\s+", 5), lambda x: x != "")
        suffix = F.when(doc % 3 == 0, " LLC").when(doc % 3 == 1, ", Inc.").otherwise("")
        job = F.when(doc % 10 == 9, doc - 5).otherwise(doc).cast("string")
        at = F.when(doc % 11 != 0, stamp("2024-01-01 00:00:00") + F.make_interval(hours=(doc % 720).cast("int")))
        dated = lambda i: F.when(doc % 3 == i, at)
        return d.withColumn("_w", w).select(
            doc.alias("seq"), "source", F.element_at(F.array(*map(F.lit, BOARDS)), (doc % 5 + 1).cast("int")).alias("board"),
            F.array_join(F.slice("_w", 1, 3), " ").alias("title"),
            F.when(F.size("_w") < 4, "").otherwise(F.concat(F.try_element_at("_w", F.lit(4)), suffix)).alias("company"),
            F.concat(F.lit("https://"), F.when(doc % 2 == 0, "www.").otherwise(""), F.lit("boards.example.org/jobs/"), job, F.lit("/?utm_source=x")).alias("url"),
            F.element_at(F.array(*map(F.lit, LOCATIONS)), (doc % 6 + 1).cast("int")).alias("location"),
            dated(0).alias("posted"), dated(1).alias("relisted"), dated(2).alias("updated"), "text", "lang",
        )

    @cached_property
    def keyed(self) -> DataFrame:
        return with_keys(compose_unicode(with_chars(self.postings)))

    @cached_property
    def keys(self) -> DataFrame:
        """Postings with keys and without their text, written once: every lookup below reads this narrow table.
        The text leaves before the Unicode step, so it never passes a Python worker."""
        return cut_lineage(with_keys(compose_unicode(with_chars(self.postings).drop("text"))))

    @cached_property
    def texts(self) -> DataFrame:
        return self.table("documents").select(F.col("doc_id").alias("seq"), "text")

    @cached_property
    def seen(self) -> DataFrame:
        """Every seventh posting was seen, some longer ago than the TTL; some re-listings had their fresh look."""
        k = self.keys
        at = stamp("2024-01-31 00:00:00") - F.make_interval(days=(F.col("seq") % 150).cast("int"))
        ids = k.filter("seq % 7 = 0").select(F.col("id").alias("key"), at.alias("last_seen"))
        marks = k.filter("seq % 35 = 0").select(F.concat(F.lit("repost:"), "link").alias("key"), at.alias("last_seen"))
        return ids.unionByName(marks)

    @cached_property
    def packages(self) -> DataFrame:
        """Every fifth posting has a package; half of them are closed, half of those archived."""
        seq = F.col("seq")
        alt = F.concat(
            F.lit("dou|https://boards.example.org/jobs/"), (seq + 2).cast("string"), F.lit("/?utm_source=y, djinni|ftp://boards.example.org/"), seq.cast("string")
        )
        return self.keys.filter("seq % 5 = 1").select(
            F.concat(F.lit("pkg-"), seq.cast("string")).alias("file"), "seq", "source", "board", "url", "canonical", "id", "link",
            "title", "company", "location",
            (stamp("2023-11-01 00:00:00") + F.make_interval(hours=(seq * 7 % 1500).cast("int"))).alias("generated"),
            (seq % 3).cast("int").alias("reposts"), (seq % 20 == 1).alias("archived"), (seq % 10 == 1).alias("closed"),
            alt.alias("alt_links"), (seq % 47).cast("int").alias("score"),
            F.when(seq % 3 != 0, (seq % 101).cast("int")).alias("llm_score"),
            F.when(seq % 4 == 1, "borderline").alias("tier"),
        )

    @cached_property
    def verdicts(self) -> DataFrame:
        """Labels as verdicts: no label is a failed call (NULL)."""
        return self.table("labels").select(
            F.col("doc_id").alias("seq"), (F.col("quality") * 60 + F.col("doc_id") % 40).cast("int").alias("llm_score"),
            (F.col("toxic") == 1).alias("suspect"),
        )

    # ---- orders ---------------------------------------------------------------

    @cached_property
    def listings(self) -> DataFrame:
        """Orders as packages of five boards; one customer is one vacancy."""
        key, board = F.col("o_orderkey"), F.col("source")
        text = key.cast("string")
        url = (
            F.when(board == "dou", F.concat(F.lit("https://jobs.dou.ua/vacancies/"), text))
            .when((board == "djinni") | ((board == "tgchannels") & (key % 2 == 0)), F.concat(F.lit("https://djinni.co/jobs/"), text))
            .when(board == "himalayas", F.concat(F.lit("https://himalayas.app/jobs/"), text))
            .when(board == "tgchannels", F.concat(F.lit("https://t.me/channel/"), text))
            .otherwise(F.concat(F.lit("https://www.linkedin.com/jobs/view/"), text))
        )
        o = self.table("orders").withColumn("source", F.element_at(F.array(*map(F.lit, BOARDS)), F.left("o_orderpriority", F.lit(1)).cast("int")))
        closed = F.col("o_orderstatus") == "F"
        return o.withColumn("url", url).select(
            key.alias("seq"), F.concat(F.lit("pkg-"), text).alias("file"), "source", "url", "o_custkey", "o_orderstatus", "o_totalprice",
            F.concat(F.lit("cust-"), F.col("o_custkey").cast("string")).alias("canonical"),
            F.col("o_orderdate").cast("timestamp").alias("generated"), closed.alias("closed"),
            (key % 8 == 0).alias("archived"), F.when(key % 9 == 0, "borderline").alias("tier"),
            F.when(closed & (key % 16 == 0), F.col("o_orderdate").cast("timestamp")).alias("closed_at"),
            (key % 4).cast("int").alias("reposts"),
        )

    @cached_property
    def job_state(self) -> DataFrame:
        """F = closed, P = viewed, O = no entry; some entries have no stamp, some a note."""
        key = F.col("seq")
        return self.listings.filter("o_orderstatus <> 'O'").select(
            "url", F.when(F.col("closed"), "closed").otherwise("viewed").alias("status"),
            F.when(key % 13 == 0, "call back").alias("note"),
            F.when(key % 17 != 0, F.col("generated") + F.make_interval(days=(key % 40).cast("int"))).alias("updated_at"),
        )

    @cached_property
    def probes(self) -> DataFrame:
        """Line items as probe stamps per listing."""
        stamps = self.table("lineitem").groupBy(F.col("l_orderkey").alias("seq")).agg(
            F.max("l_shipdate").cast("timestamp").alias("checked_at"),
            F.max(F.when(F.col("l_returnflag") == "R", F.col("l_shipdate"))).cast("timestamp").alias("tried_at"),
            F.min(F.when(F.col("l_returnflag") == "A", F.col("l_shipdate"))).cast("timestamp").alias("gone_at"),
        )
        return stamps.join(self.listings.select("seq", "url"), "seq").drop("seq")

    # ---- events ---------------------------------------------------------------

    @cached_property
    def events(self) -> DataFrame:
        return self.table("events").withColumn("ts", F.col("ts").cast("timestamp"))

    @cached_property
    def source_counts(self) -> DataFrame:
        """Found per source and three-hour run; a second, rare source per type is mostly at zero."""
        run = F.timestamp_seconds(F.floor(F.unix_seconds("ts") / 10800) * 10800)
        per = self.events.groupBy("event_type", run.alias("run")).agg(
            F.count(F.lit(1)).alias("found"), F.count_if(F.col("value") > 300).alias("rare")
        )
        return per.select(F.col("event_type").alias("source"), "run", "found").unionByName(
            per.select(F.concat("event_type", F.lit("-rare")).alias("source"), "run", F.col("rare").alias("found"))
        )

    @cached_property
    def run_stats(self) -> DataFrame:
        kind = lambda k: F.count_if(F.col("event_type") == k)
        return self.events.groupBy(F.date_trunc("day", "ts").alias("at")).agg(
            F.count(F.lit(1)).alias("considered"), kind("purchase").alias("written"), kind("signup").alias("borderline"),
            kind("click").alias("dropped"), kind("error").alias("failed"), kind("view").alias("llm_calls"),
            F.floor(F.sum(F.floor(F.col("value") * 100).cast("bigint")) / 100).cast("bigint").alias("llm_ms"),
        )

    @cached_property
    def beats(self) -> DataFrame:
        return self.events.select(F.col("event_id").alias("seq"), F.concat(F.lit("job-"), F.col("user_id").cast("string")).alias("job"), F.col("ts").alias("at"))

    # ---- conversations ----------------------------------------------------------

    @cached_property
    def messages(self) -> DataFrame:
        return self.table("conversations").select(
            F.col("conv_id").alias("thread"), F.col("turn").alias("pos"), (F.col("role") == "user").alias("incoming"), "text"
        )
