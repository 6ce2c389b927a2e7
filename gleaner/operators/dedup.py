"""Cross-source resolution: components, keepers, folded copies.

Input everywhere: the narrow keyed table (seq, source, title, company, url, dates, id, canonical, link, title_norm, chars),
without texts; ``grouped`` is the same with its component.
Copies stay one row each (keeper_seq, seq, ...): a hot vacancy may have millions of them, so they are
never gathered into one array.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleaner import fixed
from gleaner.operators.skew import first_rows, ranked
from gleaner.session import cut_lineage, discard, scratch_folder


def edges(keyed: DataFrame) -> DataFrame:
    """(seq, key): the loose key, and the link when there is one."""
    keys = F.array(
        F.concat(F.lit("c:"), F.col("canonical")),
        F.when(F.col("link") != "", F.concat(F.lit("link:"), F.col("link"))),
    )
    return keyed.select("seq", F.explode(F.array_compact(keys)).alias("key"))


#: Links that a task contracts at a time.
CONTRACTED = 1_000_000


def contract(batches: Iterator[pa.RecordBatch], chunk: int) -> Iterator[pa.RecordBatch]:
    """(node, root) of the components that the links (a, b) at hand make, each node but its smallest with that one."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        for at in range(0, batch.num_rows, chunk):
            held.append(batch.slice(at, chunk))
            if sum(b.num_rows for b in held) >= chunk:
                yield _stars(held)
                held = []
    yield _stars(held)


def _stars(held: list[pa.RecordBatch]) -> pa.RecordBatch:
    a, b = (np.concatenate([np.empty(0, np.int64), *(h.column(i).to_numpy() for h in held)]) for i in (0, 1))
    nodes, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    one, two = ends[: len(a)], ends[len(a) :]
    # every round hooks both ends of a link, and what they point to, to the smaller pointer, and follows pointers to their end
    label, before = np.arange(len(nodes)), None
    while before is None or not np.array_equal(before, label):
        before = label.copy()
        low = np.minimum(before[one], before[two])
        for at in (before[one], before[two], one, two):
            np.minimum.at(label, at, low)
        while not np.array_equal(label, label[label]):
            label = label[label]
    moved = np.flatnonzero(label != np.arange(len(nodes)))
    return pa.RecordBatch.from_arrays([pa.array(nodes[moved]), pa.array(nodes[label[moved]])], names=["node", "root"])


def components(keyed: DataFrame, chunk: int = CONTRACTED) -> DataFrame:
    """(seq, component): postings that share a loose key or a link, transitively; component = lowest seq.

    Each key is replaced by the lowest seq that carries it, so the loop moves longs only, and postings whose keys are
    theirs alone never enter it. In a round every task contracts the links that it holds to stars; a node takes the
    smallest of its roots, its other roots are linked to that one, and the node points to where that one points. Nodes that
    none points to are settled and leave, so each round has fewer links; they get their component on the way back. No node
    is ever gathered with its neighbours, however many it has.
    """
    spark = keyed.sparkSession
    folder = scratch_folder(spark)
    pairs = edges(keyed)
    heads = pairs.groupBy("key").agg(F.min("seq").alias("head"), F.count(F.lit(1)).alias("n")).filter("n > 1").select("key", "head")
    links = pairs.join(heads, "key").filter("seq <> head").select(F.col("seq").alias("a"), F.col("head").alias("b"))
    settled: list[DataFrame] = []
    while True:
        stars = links.mapInArrow(lambda batches: contract(batches, chunk), "node bigint, root bigint")
        least = Window.partitionBy("node")  # a node is in as many stars as chunks of links held it
        rooted = cut_lineage(stars.withColumn("low", F.min("root").over(least)), folder)
        own = rooted.filter("root = low").select("node", "low").distinct()
        above = own.select(F.col("node").alias("low"), F.col("low").alias("top"))
        pointed = rooted.select(F.col("root").alias("node")).distinct()
        jumped = own.join(above, "low", "left").select("node", F.coalesce("top", "low").alias("low"))
        settled.append(jumped.join(pointed, "node", "left_anti"))
        apart = rooted.filter("root <> low").select(F.col("root").alias("a"), F.col("low").alias("b"))
        links = cut_lineage(jumped.join(pointed, "node", "left_semi").select(F.col("node").alias("a"), F.col("low").alias("b")).unionByName(apart).distinct(), folder)
        if links.isEmpty():
            break
    labels = settled.pop()
    for layer in reversed(settled):
        tops = labels.select(F.col("node").alias("low"), F.col("low").alias("top"))
        labels = labels.unionByName(layer.join(tops, "low", "left").select("node", F.coalesce("top", "low").alias("low")))
    labels = cut_lineage(labels)
    discard(spark, folder)
    return keyed.select("seq").join(labels.withColumnsRenamed({"node": "seq", "low": "label"}), "seq", "left").select(
        "seq", F.coalesce("label", "seq").alias("component")
    )


def keeper_sources(grouped: DataFrame) -> DataFrame:
    """(component, keeper_source, k, n): the source with most records; a tie goes to the longest text's, else the first seen."""
    per_source = grouped.groupBy("component", "source").agg(
        F.count(F.lit(1)).alias("k"), F.min("seq").alias("first_seq"),
        F.max(F.struct("chars", (-F.col("seq")).alias("neg"))).alias("best"),
    )
    # The longest text of the component sits in the source with the greatest (length, -seq).
    tops = per_source.groupBy("component").agg(F.max("best").alias("top"), F.sum("k").alias("n"))
    choice = per_source.join(tops, "component").withColumn("has_longest", (F.col("best") == F.col("top")).cast("int"))
    order = F.struct(F.col("k"), F.col("has_longest"), (-F.col("first_seq")).alias("neg_first"))
    return choice.groupBy("component").agg(
        F.max_by("source", order).alias("keeper_source"), F.max("k").alias("k"), F.max("n").alias("n"),
    )


def _chunk(width: int) -> Column:
    return F.floor(F.col("seq") / width)


def fold_plan(grouped: DataFrame, width: int = 100_000) -> DataFrame:
    """(component, seq, role, keeper_seq): the i-th other of a component folds into keeper i mod k.

    ``grouped`` = postings with their component. Components of one row take the short way.
    """
    choice = keeper_sources(grouped).filter("n > 1").drop("n")
    role = F.when(F.col("source") == F.col("keeper_source"), "keeper").when(F.col("keeper_source").isNotNull(), "copy")
    # narrow, and read by every branch below: written once
    marked = cut_lineage(grouped.select("seq", "component", "source").join(choice, "component", "left").select("component", "seq", role.alias("role"), "k"))
    single = marked.filter("role IS NULL").select("component", "seq", F.lit("keeper").alias("role"), F.col("seq").alias("keeper_seq"))
    several = marked.filter("role IS NOT NULL")
    numbered = ranked(several, ["component", "role"], _chunk(width), [F.col("seq")], "i")
    keepers = numbered.filter(F.col("role") == "keeper").select(
        "component", (F.col("i") - 1).alias("slot"), F.col("seq").alias("keeper_seq")
    )
    copies = numbered.filter(F.col("role") == "copy").withColumn("slot", F.pmod(F.col("i") - 1, F.col("k")))
    folded = copies.join(keepers, ["component", "slot"]).select("component", "seq", "role", "keeper_seq")
    kept = keepers.select("component", F.col("keeper_seq").alias("seq"), F.lit("keeper").alias("role"), "keeper_seq")
    return single.unionByName(kept).unionByName(folded)


def folded_copies(keyed: DataFrame, plan: DataFrame) -> DataFrame:
    """One row per folded copy, beside its keeper: link, and its id / title / key where they differ from the keeper's."""
    cols = ["source", "url", "title", "id", "title_norm", "canonical"]
    copies = plan.filter(F.col("role") == "copy").select("seq", "keeper_seq")
    copy = keyed.select("seq", *[F.col(c).alias(f"alt_{c}") for c in cols])
    keeper = keyed.select(F.col("seq").alias("keeper_seq"), "id", "title_norm", "canonical")
    both = copies.join(copy, "seq").join(keeper, "keeper_seq")
    return both.select(
        "keeper_seq", "seq", "alt_source", "alt_url",
        F.when(F.col("alt_id") != F.col("id"), F.col("alt_id")).alias("merged_id"),
        F.when(F.col("alt_title_norm") != F.col("title_norm"), F.col("alt_title")).alias("merged_title"),
        F.when(F.col("alt_canonical") != F.col("canonical"), F.col("alt_canonical")).alias("merged_key"),
    )


def earliest_dates(postings: DataFrame, plan: DataFrame) -> DataFrame:
    """(keeper_seq, kind, at): the earliest stamp of any kind over a keeper and its copies; only keepers that received copies."""
    stamps = F.array(*[
        F.struct(F.col(kind).alias("at"), F.lit(i).alias("kind_order"), F.lit(kind).alias("kind"))
        for i, kind in enumerate(fixed.DATE_KINDS)
    ])
    dated = (
        postings.select("seq", F.explode(F.filter(stamps, lambda s: s["at"].isNotNull())).alias("stamp"))
        .join(plan.select("seq", "keeper_seq", (F.col("role") == "copy").alias("is_copy")), "seq")
    )
    received = plan.groupBy("keeper_seq").agg(F.max((F.col("role") == "copy").cast("int")).alias("copies"))
    first = dated.groupBy("keeper_seq").agg(
        F.min(F.struct("stamp.at", "is_copy", "seq", "stamp.kind_order", "stamp.kind")).alias("first")
    )
    return (
        first.join(received.filter("copies = 1"), "keeper_seq")
        .select("keeper_seq", F.col("first.kind").alias("kind"), F.col("first.at").alias("at"))
    )


def merged_postings(grouped: DataFrame, plan: DataFrame, texts: DataFrame) -> DataFrame:
    """The keepers, with the component's longest text on the richest keeper and the earliest stamp on keepers that merged.

    Which text goes where is settled on ids and lengths; each text is then fetched once, by its seq.
    """
    by_length = F.struct("chars", (-F.col("seq")).alias("neg"))
    longest = grouped.groupBy("component").agg(F.max(by_length).alias("long"))
    kept = plan.filter(F.col("role") == "keeper").select("seq")
    keepers = grouped.join(kept, "seq")
    richest = keepers.groupBy("component").agg(F.max(by_length).alias("rich"))
    moves = (
        longest.join(richest, "component").filter(F.col("long.chars") > F.col("rich.chars"))
        .select((-F.col("rich.neg")).alias("seq"), (-F.col("long.neg")).alias("from_seq"))
    )
    dates = earliest_dates(grouped, plan).withColumnsRenamed({"keeper_seq": "seq"})
    out = keepers.join(moves, "seq", "left").join(dates, "seq", "left")
    redate = {
        kind: F.when(F.col("kind").isNull(), F.col(kind)).when(F.col("kind") == kind, F.col("at"))
        for kind in fixed.DATE_KINDS
    }
    dated = out.withColumns({**redate, "text_seq": F.coalesce("from_seq", "seq")}).drop("kind", "at", "from_seq")
    return dated.join(texts.select(F.col("seq").alias("text_seq"), "text"), "text_seq").drop("text_seq")


def merged_count(plan: DataFrame) -> DataFrame:
    return plan.agg(F.count_if(F.col("role") == "copy").alias("merged"))


def unique_by_url(df: DataFrame, url: str = "url", seq: str = "seq") -> DataFrame:
    """The first record per url."""
    return first_rows(df, [url], [F.col(seq)])
