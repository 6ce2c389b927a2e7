"""The keyword gate: known postings, reposts, title exclusion, score.

Tables: postings (keyed, see functions.keys), copies (keeper_seq, merged_id, merged_title, merged_key,
alt_source, alt_url), seen (key, last_seen), packages (file, seq, source, url, canonical, link, generated,
reposts, archived, closed), package_links (link, file).

Everything a posting is looked up in is reduced to one small row per key first, so no join here can
multiply rows, however many packages or postings share a key. A key that many postings share still meets
one lookup row: AQE splits that partition of the postings side and copies the row to each part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner import fixed
from gleaner.functions.keys import legacy_spelling
from gleaner.functions.text import first_excluded_term, text_or_blank
from gleaner.functions.urls import parse_alt_links, link_key
from gleaner.operators.scoring import Scorer
from gleaner.operators.skew import first_rows
from gleaner.session import cut_lineage


def _lookup(rows: DataFrame, unique: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """Join to a table that is unique on ``on``."""
    return rows.join(unique, on, how)


# ---- seen store ---------------------------------------------------------------

def live_seen(seen: DataFrame, now: Column, ttl_days: int = fixed.SEEN_TTL_DAYS) -> DataFrame:
    """One row per key whose last stamp is inside the TTL."""
    return (
        seen.groupBy("key").agg(F.max("last_seen").alias("last_seen"))
        .filter(F.col("last_seen") >= now - F.make_interval(days=F.lit(ttl_days)))
    )


def lookup_ids(postings: DataFrame, copies: DataFrame | None = None) -> DataFrame:
    """(seq, key): every spelling under which a posting, or a copy folded into it, may have been seen."""
    ids = postings.select("seq", F.col("id").alias("one"))
    if copies is not None:
        ids = ids.unionByName(
            copies.filter(F.col("merged_id").isNotNull()).select(F.col("keeper_seq").alias("seq"), F.col("merged_id").alias("one"))
        )
    return ids.select("seq", F.explode(F.array_distinct(F.array("one", legacy_spelling("one")))).alias("key"))


def seen_postings(postings: DataFrame, seen: DataFrame, copies: DataFrame | None = None) -> DataFrame:
    """Distinct seq already in the store under any spelling."""
    keys = seen.select("key").withColumn("_seen", F.lit(True))
    return _lookup(lookup_ids(postings, copies), keys, ["key"]).select("seq").distinct()


# ---- package lookups ------------------------------------------------------------

def package_links(packages: DataFrame) -> DataFrame:
    """(link, file): own and alternative links of live packages; the first package wins a link."""
    own = packages.filter(~F.col("archived")).select("seq", "file", F.col("url").alias("one"))
    alt = packages.filter(~F.col("archived")).select(
        "seq", "file", F.explode(F.transform(parse_alt_links("alt_links"), lambda l: l["url"])).alias("one")
    )
    links = own.unionByName(alt).select("seq", "file", link_key(F.col("one")).alias("link")).filter("link <> ''")
    return links.groupBy("link").agg(F.min_by("file", "seq").alias("file"))


def posting_copies(postings: DataFrame, copies: DataFrame | None = None) -> DataFrame:
    """(seq, pos, key, source, url): the keeper's own key first, then the keys of copies folded into it."""
    own = postings.select("seq", F.lit(-1).cast("bigint").alias("pos"), F.col("canonical").alias("key"), "source", "url")
    if copies is None:
        return own
    return own.unionByName(
        copies.filter(F.col("merged_key").isNotNull()).select(
            F.col("keeper_seq").alias("seq"), F.col("seq").alias("pos"), F.col("merged_key").alias("key"),
            F.col("alt_source").alias("source"), F.col("alt_url").alias("url"),
        )
    )


def same_package(lookups: DataFrame, packages: DataFrame) -> DataFrame:
    """(seq, same_file): a live package with the same key, source and url as the posting or one of its copies."""
    first = (
        packages.filter(~F.col("archived") & (text_or_blank("url") != ""))
        .groupBy(F.col("canonical").alias("key"), "source", "url").agg(F.min(F.struct("seq", "file")).alias("hit"))
    )
    hits = _lookup(lookups, first, ["key", "source", "url"])
    return hits.groupBy("seq").agg(F.min_by("hit", F.struct("pos", "hit.seq"))["file"].alias("same_file"))


def other_board_package(lookups: DataFrame, packages: DataFrame) -> DataFrame:
    """(seq, other_file): the first live package with the same key from another source.

    Per key only the first package of the two earliest sources can be the answer: if the earliest is the
    posting's own source, it is the next one.
    """
    per_source = (
        packages.filter(~F.col("archived"))
        .groupBy(F.col("canonical").alias("key"), "source").agg(F.min(F.struct("seq", "file")).alias("hit"))
    )
    two = (
        first_rows(per_source, ["key"], [F.col("hit.seq")], 2)
        .groupBy("key").agg(F.array_sort(F.collect_list(F.struct("hit.seq", "hit.file", "source"))).alias("two"))
    )
    own = F.col("source")
    hits = _lookup(lookups, two, ["key"]).withColumn(
        "hit", F.try_element_at(F.filter("two", lambda p: p["source"] != own), F.lit(1))
    )
    found = hits.filter(F.col("hit").isNotNull())
    return found.groupBy("seq").agg(F.min_by("hit", F.struct("pos", "hit.seq"))["file"].alias("other_file"))


def by_link(postings: DataFrame, links: DataFrame) -> DataFrame:
    """(seq, link_file): a live package already lists the posting's link."""
    return (
        _lookup(postings.filter("link <> ''").select("seq", "link"), links, ["link"])
        .select("seq", F.col("file").alias("link_file"))
    )


def reposts(postings: DataFrame, packages: DataFrame, copies: DataFrame | None = None) -> DataFrame:
    """(seq, file, url, reposts): re-listings of a closed package from the same board under a new url and link.

    The newest closed prior counts, unless the board has a newer open package for the vacancy. Per
    (key, source) the three newest links, two urls each, are enough: at most one link (the posting's own)
    and one url (the copy's) are ruled out.
    """
    lookups = posting_copies(postings, copies).join(postings.select("seq", F.col("link").alias("own_link")), "seq")
    stamp = F.coalesce("generated", F.lit("1970-01-01 00:00:00").cast("timestamp"))
    newest = F.struct(stamp.alias("generated"), (-F.col("seq")).alias("neg"))
    closed = packages.filter(F.col("closed") & (text_or_blank("url") != "")).withColumn("newest", newest)
    urls = first_rows(closed, ["canonical", "source", "link", "url"], [F.col("newest").desc()])
    two_urls = first_rows(urls, ["canonical", "source", "link"], [F.col("newest").desc()], 2)
    per_link = two_urls.groupBy("canonical", "source", "link").agg(
        F.max("newest").alias("top"),
        F.collect_list(F.struct("newest", "file", "url", "link", "reposts")).alias("some"),
    )
    per_key = (
        first_rows(per_link, ["canonical", "source"], [F.col("top").desc()], 3)
        .groupBy(F.col("canonical").alias("key"), "source").agg(F.flatten(F.collect_list("some")).alias("priors"))
    )
    own_link, own_url = F.col("own_link"), F.col("url")
    best = F.array_max(F.filter("priors", lambda p: (p["link"] != own_link) & (p["url"] != own_url)))
    hits = _lookup(lookups, per_key, ["key", "source"]).withColumn("best", best).filter("best IS NOT NULL")
    chosen = hits.groupBy("seq").agg(
        F.max_by(F.struct("best", "source"), F.struct("best.newest.generated", -F.col("pos"))).alias("c")
    ).select("seq", "c.best", F.col("c.source").alias("source"))
    open_newest = packages.filter(~F.col("closed")).groupBy(F.col("canonical").alias("key"), "source").agg(
        F.max(stamp).alias("open_generated")
    )
    keys = lookups.select("seq", "key").distinct().join(chosen, "seq")
    answered = (
        _lookup(keys, open_newest, ["key", "source"])
        .filter(F.col("open_generated") > F.col("best.newest.generated")).select("seq").distinct()
    )
    return chosen.join(answered, "seq", "left_anti").select(
        "seq", F.col("best.file").alias("repost_file"), F.col("best.url").alias("repost_url"),
        (F.coalesce(F.col("best.reposts"), F.lit(0)) + 1).alias("reposts"),
    )


def fresh_reposts(postings: DataFrame, found: DataFrame, seen: DataFrame) -> DataFrame:
    """Reposts whose link has no "repost:" marker yet, of postings that have a link."""
    marked = postings.filter("link <> ''").select("seq", F.concat(F.lit("repost:"), "link").alias("key"))
    unjudged = marked.join(seen.select("key"), "key", "left_anti").select("seq")
    return found.join(unjudged, "seq", "left_semi")


# ---- the decision -----------------------------------------------------------------

def keyword_gate(
    keys: DataFrame, texts: DataFrame, seen: DataFrame, packages: DataFrame, scorer: Scorer, excluded: list[str],
    min_score: Column | int, require_role: bool = False, copies: DataFrame | None = None,
) -> DataFrame:
    """One decision per posting: seen, packaged, dup, excluded, low or match, in that order.

    ``keys`` is the narrow keyed table and serves every lookup; ``texts`` (seq, text) is joined only for the
    postings no earlier rule decided, so known postings never move or scan their text.
    """
    lookups = posting_copies(keys, copies)
    fresh = fresh_reposts(keys, reposts(keys, packages, copies), seen)
    known = (
        keys.join(seen_postings(keys, seen, copies).withColumn("is_seen", F.lit(True)), "seq", "left")
        .join(fresh.withColumn("is_repost", F.lit(True)), "seq", "left")
        .join(same_package(lookups, packages), "seq", "left")
        .join(by_link(keys, package_links(packages)), "seq", "left")
        .join(other_board_package(lookups, packages), "seq", "left")
        .withColumn("term", first_excluded_term("title", excluded))
    )
    if copies is not None:
        merged = (
            copies.filter(F.col("merged_title").isNotNull())
            .select(F.col("keeper_seq").alias("seq"), F.col("seq").alias("pos"), first_excluded_term("merged_title", excluded).alias("t"))
            .filter(F.col("t").isNotNull()).groupBy("seq").agg(F.min_by("t", "pos").alias("merged_term"))
        )
        known = known.join(merged, "seq", "left").withColumn("term", F.coalesce("term", "merged_term")).drop("merged_term")
    early = (
        F.when(F.col("is_repost").isNull() & F.col("is_seen"), "seen")
        .when(F.col("same_file").isNotNull() | F.col("link_file").isNotNull(), "packaged")
        .when(F.col("other_file").isNotNull(), "dup")
        .when(F.col("term").isNotNull(), "excluded")
    )
    # Written once: the undecided rows leave for scoring and come back to it.
    decided = cut_lineage(known.withColumns({"early": early, "file": F.coalesce("same_file", "link_file", "other_file")}))
    open_texts = texts.join(decided.filter("early IS NULL").select("seq"), "seq", "left_semi")
    scored = scorer(open_texts).withColumn("retry", F.length(text_or_blank("text")) < fixed.SHORT_TEXT).drop("text")
    threshold = min_score if isinstance(min_score, Column) else F.lit(min_score)
    low = F.col("score") < threshold
    if require_role:
        low = low | F.col("matched_role").isNull()
    return decided.join(scored, "seq", "left").withColumns({
        "kind": F.coalesce("early", F.when(low, "low").otherwise("match")),
        "considered": F.col("early").isNull() | (F.col("early") == "excluded"),
        "retry": F.coalesce("retry", F.lit(False)),
        "file": F.when(F.col("early").isin("packaged", "dup"), F.col("file")),
        "term": F.when(F.col("early") == "excluded", F.col("term")),
    }).drop("early", "is_seen", "is_repost", "same_file", "link_file", "other_file")


def known_before_fetch(
    postings: DataFrame, keeps_location: Column, seen: DataFrame, fresh: DataFrame, excluded: list[str],
) -> DataFrame:
    """Postings whose detail page need not be read: dropped by place, or (seen or excluded) and no fresh repost."""
    flagged = (
        postings.join(seen_postings(postings, seen).withColumn("is_seen", F.lit(True)), "seq", "left")
        .join(fresh.select("seq", F.lit(True).alias("is_repost")), "seq", "left")
    )
    dull = F.coalesce("is_seen", F.lit(False)) | first_excluded_term("title", excluded).isNotNull()
    return flagged.withColumn("known", ~keeps_location | (dull & F.col("is_repost").isNull())).drop("is_seen", "is_repost")


def first_time(ids: DataFrame, seen: DataFrame, marker: str) -> DataFrame:
    """Adds first_time: the marker key ("title-only-kw:", "title-only-llm:", "llm-retry:") is not in the store yet."""
    keyed = ids.withColumn("marker", F.concat(F.lit(marker), F.col("id")))
    held = seen.select(F.col("key").alias("marker"), F.lit(True).alias("_held"))
    return _lookup(keyed, held, ["marker"], "left").withColumn(
        "first_time", F.col("_held").isNull()
    ).drop("_held")


def judge_once(matches: DataFrame) -> DataFrame:
    """Several matches of one identity: the first with a description is judged, the others count as seen."""
    order = F.struct(F.col("retry").cast("int").alias("short"), F.col("seq"))
    chosen = matches.groupBy("id").agg(F.min(order)["seq"].alias("judged_seq"), F.count(F.lit(1)).alias("same"))
    return _lookup(matches, chosen, ["id"]).withColumn(
        "outcome", F.when(F.col("seq") == F.col("judged_seq"), "judged").otherwise("seen")
    )


def carried(once: DataFrame) -> DataFrame:
    """(judged_seq, seq, alt_source, alt_url, merged_key, merged_title, marker): what the unjudged matches of an identity
    hand to the judged one. ``once``: the rows of ``judge_once``.

    Key, title and repost marker only where the judged one does not say the same. One row a copy, never an array a keeper.
    """
    own = once.filter("outcome = 'judged'").select(
        F.col("seq").alias("judged_seq"), F.col("canonical").alias("_key"), F.col("title").alias("_title"), F.col("link").alias("_link"),
    )
    rest = once.filter("outcome = 'seen'").join(own, "judged_seq")
    differs = lambda c, than: F.when(~F.col(c).eqNullSafe(F.col(than)), F.col(c))
    return rest.select(
        "judged_seq", "seq", F.col("source").alias("alt_source"), F.col("url").alias("alt_url"), differs("canonical", "_key").alias("merged_key"),
        differs("title", "_title").alias("merged_title"),
        F.when((F.col("link") != "") & ~F.col("link").eqNullSafe(F.col("_link")), F.concat(F.lit("repost:"), "link")).alias("marker"),
    )


def stamp_keys(decisions: DataFrame, seen: DataFrame, copies: DataFrame | None = None) -> DataFrame:
    """Distinct keys one run writes: identity, ids folded in, and the repost marker when new or held already."""
    ids = decisions.select(F.col("id").alias("key"))
    if copies is not None:
        merged = copies.filter(F.col("merged_id").isNotNull()).select(F.col("keeper_seq").alias("seq"), F.col("merged_id").alias("key"))
        ids = ids.unionByName(merged.join(decisions.select("seq"), "seq", "left_semi").select("key"))
    markers = decisions.filter("link <> ''").select(
        F.concat(F.lit("repost:"), "link").alias("key"), F.col("repost_file").isNotNull().alias("new")
    ).groupBy("key").agg(F.max("new").alias("new"))
    held = seen.select("key").withColumn("_held", F.lit(True))
    kept = markers.join(held, "key", "left").filter(F.col("new") | F.col("_held")).select("key")
    return ids.unionByName(kept).distinct()


def upsert_seen(seen: DataFrame, keys: DataFrame, now: Column) -> DataFrame:
    """The store after a run: stamped keys carry this run's time, the rest keep theirs."""
    return (
        seen.select("key", "last_seen").unionByName(keys.select("key", now.alias("last_seen")))
        .groupBy("key").agg(F.max("last_seen").alias("last_seen"))
    )


def run_outcomes(decisions: DataFrame) -> DataFrame:
    """Adds outcome: packaged and dup count as seen."""
    return decisions.withColumn(
        "outcome", F.when(F.col("kind").isin("packaged", "dup"), "seen").otherwise(F.col("kind"))
    )


def run_summary(found: DataFrame | None, outcomes: DataFrame) -> DataFrame:
    """source x (found, excluded, seen, low, borderline, written); ``found`` holds the rows before resolution.

    Without it every row has an outcome, and one aggregate over ``outcomes`` says both.
    """
    if found is None:
        each = [F.count_if(F.col("outcome") == o).cast("bigint").alias(o) for o in fixed.RUN_OUTCOMES]
        return outcomes.groupBy("source").agg(F.count(F.lit(1)).cast("bigint").alias("found"), *each)
    counted = outcomes.groupBy("source").pivot("outcome", fixed.RUN_OUTCOMES).agg(F.count(F.lit(1)))
    raw = found.groupBy("source").agg(F.count(F.lit(1)).alias("found"))
    return raw.join(counted, "source", "full").select(
        "source", *[F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in ["found", *fixed.RUN_OUTCOMES]]
    )
