"""Merkle manifest of a table: a digest for every row, a root for every group and for the whole, and a proof for every row.

A row's place among its group's ids is read off bitmaps, no leaf is sorted. Ids of a group are bits of 64-bit words, and
only words with a bit are kept; partial bitmaps are merged by bit-or. A popcount directory over them has one level for every
16 bits of the ids, so no node has more than 65,536 children: a row's place is the count before its word plus the bits below
its own. Places are keys: 16 consecutive nodes meet by place / 16 as the slots of one array, level by level, and proofs come
down the same way. A hot group is as many words and arrays as its rows need; nothing gathers a group.
"""

from __future__ import annotations

import string
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gleaner.llm.common import table
from gleaner.llm.registry import query
from gleaner.operators.skew import ranked
from gleaner.session import cut_lineage

#: Nodes that become one.
FAN = 16
#: Low bits of an id that are a place in a word, and widths of what the directory's levels leave out.
WORD, SHIFTS = 6, (16, 32, 48)
PATH = "array<struct<before:string,after:string>>"
GROUP = ["_named", "_group"]


def digest(text: Column) -> Column:
    return F.sha2(text, 256)


def leaf(columns: Sequence[Column]) -> Column:
    """Digest of a row: of every column ``-`` for null, else its UTF-8 byte count, a colon and its value."""
    parts = [F.when(c.isNull(), "-").otherwise(F.concat(F.octet_length(c.cast("string")).cast("string"), F.lit(":"), c.cast("string"))) for c in columns]
    return digest(F.concat(*parts))


def placed(rows: DataFrame) -> DataFrame:
    """Add ``_pos`` and ``_total`` to rows of (_named, _group, _key, _leaf, ...): place and number of rows in the group.

    Ascending keys; rows without a key come first, by leaf, as do rows that share one among themselves. Rows without a key
    are filed by the first 60 bits of their leaf in a bitmap of their own.
    """
    coded = rows.withColumn("_band", F.col("_key").isNotNull()).withColumn(
        "_code", F.coalesce(F.col("_key"), F.conv(F.substring("_leaf", 1, 15), 16, 10).cast("bigint"))
    )
    coded = coded.withColumn("_word", F.shiftright("_code", WORD)).withColumn("_bit", F.col("_code").bitwiseAND(F.lit((1 << WORD) - 1)).cast("int"))
    here = [*GROUP, "_band", "_word"]
    bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), F.col("_bit"))
    words = cut_lineage(coded.groupBy(*here).agg(F.bit_or(bit).alias("_bits"), F.count(F.lit(1)).alias("_rows")))
    full = words.filter(F.col("_rows") != F.bit_count("_bits"))
    shared = cut_lineage(
        coded.join(full.select(*here), here, "left_semi").groupBy(*here, "_bit").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1")
    )
    more = shared.groupBy(*here).agg(F.collect_list(F.struct("_bit", (F.col("_n") - 1).alias("_n"))).alias("_more"))
    filed = directory(words).join(more, here, "left")
    below = F.bit_count(F.col("_bits").bitwiseAND(F.bitwise_not(F.call_function("shiftleft", F.lit(-1).cast("bigint"), F.col("_bit")))))
    extra = F.aggregate(F.filter(F.coalesce("_more", F.array().cast("array<struct<_bit:int,_n:bigint>>")), lambda m: m["_bit"] < F.col("_bit")), F.lit(0).cast("bigint"), lambda a, m: a + m["_n"])
    found = coded.join(filed, here).withColumn("_pos", F.col("_base") + below + extra)
    names = [*rows.columns, "_pos", "_total"]
    if shared.isEmpty():
        return found.select(*names)
    again = F.exists(F.coalesce("_more", F.array().cast("array<struct<_bit:int,_n:bigint>>")), lambda m: m["_bit"] == F.col("_bit"))
    alone, copies = found.filter(~again), found.filter(again)
    # rows alike in key and leaf are one another's copies: any order among them gives the same tree
    numbered = ranked(copies, [*here, "_bit"], F.struct("_leaf", F.spark_partition_id().alias("_part")), [F.col("_leaf")], "_nth")
    return alone.select(*names).unionByName(numbered.withColumn("_pos", F.col("_pos") + F.col("_nth") - 1).select(*names))


def directory(words: DataFrame) -> DataFrame:
    """Add ``_base``, the rows of the group before each word, and ``_total``, all its rows.

    Counts are summed up one level after another and running sums come down again, each over the children of one node. A
    level whose prefix is the same for all words would have one node a group, and is left out.
    """
    low, high = words.agg(F.min("_word"), F.max("_word")).first()
    shifts = [s - WORD for s in SHIFTS if low is not None and low >> (s - WORD) != high >> (s - WORD)]
    for s in shifts:
        words = words.withColumn(f"_at{s}", F.shiftright("_word", s))
    levels = [[*GROUP, "_band", *[f"_at{s}" for s in reversed(shifts[i:])]] for i in range(len(shifts) + 1)] + [GROUP]
    sums = [words]
    for keys in levels:
        sums.append(sums[-1].groupBy(*keys).agg(F.sum("_rows").alias("_rows")))
    down = sums[-1].withColumnRenamed("_rows", "_total").withColumn("_base", F.lit(0).cast("bigint"))
    for below, parent in zip(reversed(sums[:-1]), reversed(levels)):
        own = [c for c in below.columns if c not in (*parent, "_rows", "_bits")]
        order = Window.partitionBy(*parent).orderBy(*own).rowsBetween(Window.unboundedPreceding, -1)
        stepped = below.withColumn("_before", F.coalesce(F.sum("_rows").over(order), F.lit(0).cast("bigint")))
        down = stepped.join(down, parent).withColumn("_base", F.col("_base") + F.col("_before")).drop("_before", "_rows")
    return down


def grouped(nodes: DataFrame, members: Sequence[str]) -> DataFrame:
    """One row for every 16 consecutive nodes of a group: their slots as an array, and the digest of the run.

    A group of one node keeps that node's digest.
    """
    run = nodes.groupBy(*GROUP, F.expr(f"_pos div {FAN}").alias("_up")).agg(
        F.map_from_entries(F.collect_list(F.struct((F.col("_pos") % FAN).cast("int"), F.struct(*members)))).alias("_by"),
        F.max("_total").alias("_total"),
    )
    slots = run.withColumn("_slots", F.transform(F.sequence(F.lit(0), F.size("_by") - 1), lambda i: F.element_at("_by", i))).drop("_by")
    joined = F.array_join(F.transform("_slots", lambda s: s["_leaf"]), "")
    lone = F.col("_total") == 1
    return slots.select(
        *GROUP, F.col("_up").alias("_pos"), F.expr(f"(_total + {FAN} - 1) div {FAN}").alias("_total"), "_slots", lone.alias("_lone"),
        F.when(lone, F.element_at("_slots", 1)["_leaf"]).otherwise(digest(joined)).alias("_leaf"),
    )


def raised(nodes: DataFrame, members: Sequence[str]) -> list[DataFrame]:
    """Levels of slot arrays over the leaves; each holds the groups that still had several nodes below it."""
    levels = [cut_lineage(grouped(nodes, members))]
    while not levels[-1].filter("_total > 1").isEmpty():
        levels.append(cut_lineage(grouped(levels[-1].filter("_total > 1"), ["_leaf"])))
    return levels


def tops(levels: list[DataFrame]) -> DataFrame:
    """The last node of every group."""
    done = [level.filter("_total = 1").select(*GROUP, "_leaf") for level in levels]
    out = done[0]
    for d in done[1:]:
        out = out.union(d)
    return out


def lowered(level: DataFrame, paths: DataFrame, carried: Sequence[str]) -> DataFrame:
    """Members of a level's runs with their own path: what lies beside them, then the path of the run."""
    found = level.join(paths, [*GROUP, "_pos"]).select(*GROUP, "_pos", "_slots", "_lone", "_path", *carried, F.posexplode("_slots").alias("_slot", "_member"))
    side = F.struct(
        F.array_join(F.transform(F.slice("_slots", 1, F.col("_slot")), lambda s: s["_leaf"]), "").alias("before"),
        F.array_join(F.transform(F.slice("_slots", F.col("_slot") + 2, F.lit(FAN)), lambda s: s["_leaf"]), "").alias("after"),
    )
    path = F.when(F.col("_lone"), F.col("_path")).otherwise(F.concat(F.array(side), F.col("_path"))).cast(PATH)
    return found.select(*GROUP, (F.col("_pos") * FAN + F.col("_slot")).alias("_pos"), path.alias("_path"), *carried, "_member")


def descended(levels: list[DataFrame], top: DataFrame, carried: Sequence[str]) -> DataFrame:
    """Members of the first level with their whole paths; ``top`` has the path of every group's last node."""
    first = top.withColumn("_pos", F.lit(0).cast("bigint"))
    paths = None
    for level in reversed(levels):
        # groups that end at this level enter here, the others come from the level above
        ended = level.filter("_total = 1").select(*GROUP, "_pos").join(first, [*GROUP, "_pos"])
        paths = ended if paths is None else ended.unionByName(paths)
        paths = lowered(level, paths, carried)
        members, paths = paths, paths.drop("_member")
    return members


def manifest(df: DataFrame, columns: Sequence[str], group: str = "source", key: str = "doc_id", carry: Sequence[str] = ()) -> DataFrame:
    """(key, leaf, subroot, root, path, *carry) for every row of ``df``.

    ``columns`` make the leaf. Leaves of a ``group`` ascend by ``key`` (an integer; rows without one first, then and among
    equal keys by leaf), groups by name, rows without a group first. ``path`` holds the siblings before and after each node
    from the leaf to the root. An empty table gives no row; repeated rows are leaves of their own; further columns are
    ignored but those of ``carry``.
    """
    member = F.struct(F.col(key).cast("bigint").alias("key"), *[F.col(c).alias(f"c{i}") for i, c in enumerate(carry)])
    rows = df.select(
        F.col(group).isNotNull().alias("_named"), F.coalesce(F.col(group).cast("string"), F.lit("")).alias("_group"),
        F.col(key).cast("bigint").alias("_key"), leaf([F.col(c) for c in columns]).alias("_leaf"), member.alias("_row"),
    )
    levels = raised(placed(cut_lineage(rows)), ["_leaf", "_row"])
    subroots = cut_lineage(tops(levels))
    dealt = subroots.repartitionByRange(*GROUP).withColumn("_part", F.spark_partition_id())
    named = ranked(cut_lineage(dealt), [], F.col("_part"), [F.col(c) for c in GROUP], "_pos")
    over = named.select(
        F.lit(True).alias("_named"), F.lit("").alias("_group"), (F.col("_pos") - 1).alias("_pos"), F.lit(subroots.count()).cast("bigint").alias("_total"),
        "_leaf", F.struct("_named", "_group", "_leaf").alias("_row"),
    )
    upper = raised(over, ["_leaf", "_row"])
    root = tops(upper).select(*GROUP, F.col("_leaf").alias("_root"), F.array().cast(PATH).alias("_path"))
    top = descended(upper, root, ["_root"]).select(
        F.col("_member._row._named").alias("_named"), F.col("_member._row._group").alias("_group"),
        F.col("_member._row._leaf").alias("_subroot"), "_root", "_path",
    )
    found = descended(levels, cut_lineage(top), ["_subroot", "_root"])
    return found.select(
        F.col("_member._row.key").alias(key), F.col("_member._leaf").alias("leaf"), F.col("_subroot").alias("subroot"), F.col("_root").alias("root"),
        F.col("_path").alias("path"), *[F.col(f"_member._row.c{i}").alias(c) for i, c in enumerate(carry)],
    )


def folded(leaf_: Column, path: Column) -> Column:
    """The root that a leaf and its path lead to."""
    return F.aggregate(path, leaf_, lambda node, side: digest(F.concat(side["before"], node, side["after"])))


def siblings(path: Column) -> Column:
    """All siblings on a path, from the leaf to the root, each level from left to right."""
    return F.array_join(F.transform(path, lambda side: F.concat(side["before"], side["after"])), "")


def _field(name: str) -> str:
    return f"CASE WHEN {name} IS NULL THEN '-' ELSE strlen({name}::VARCHAR) || ':' || {name}::VARCHAR END"


_CRC = """xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)),
  lambda acc, b: list_reduce(list_prepend(xor(acc, b), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda x, i: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)), 4294967295)"""
_HEAD = " || ".join(map(_field, ["doc_id", "source", "lang", "n_chars"]))
_LOW = f"translate(text, '{string.ascii_uppercase}', '{string.ascii_lowercase}')"


def _tree(name: str, base: str) -> str:
    """Nodes of all levels, and what lies beside each, of the nodes (grp, pos, total, digest)."""
    beside = "string_agg(digest, '') OVER (PARTITION BY level, grp, pos // 16 ORDER BY pos ROWS BETWEEN"
    return f"""{name}(level, grp, pos, total, digest) AS (SELECT 0, grp, pos, total, digest FROM {base}
  UNION ALL SELECT level + 1, grp, pos // 16, (total + 15) // 16, sha256(string_agg(digest, '' ORDER BY pos)) FROM {name} WHERE total > 1 GROUP BY level, grp, pos // 16, total),
{name}_sides AS (SELECT *, coalesce({beside} UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS before, coalesce({beside} 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS after FROM {name} WHERE total > 1)"""


def _walk(name: str, tree: str, base: str) -> str:
    """From (id, grp, pos, fold, proof) up to the last node of the group; ``{name}_end`` holds the last row of each id."""
    return f"""{name}(id, level, grp, pos, fold, proof) AS (SELECT id, 0, grp, pos, fold, proof FROM {base}
  UNION ALL SELECT w.id, w.level + 1, w.grp, w.pos // 16, sha256(s.before || w.fold || s.after), w.proof || s.before || s.after
  FROM {name} w JOIN {tree}_sides s ON s.level = w.level AND s.grp = w.grp AND s.pos = w.pos),
{name}_end AS (SELECT * FROM {name} QUALIFY row_number() OVER (PARTITION BY id ORDER BY level DESC) = 1)"""


#: The tree level by level; a group's name is told from no group by a letter before it.
OP12_SQL = f"""
WITH RECURSIVE leaves AS (
  SELECT *, sha256({_HEAD} || {_field("text")}) AS leaf, CASE WHEN doc_id IS NOT NULL AND {_CRC} % 5 = 0 THEN sha256({_HEAD} || {_field(_LOW)}) END AS tampered FROM documents
), rows_ AS (
  SELECT row_number() OVER () AS id, doc_id, leaf, tampered, CASE WHEN source IS NULL THEN 'a' ELSE 'b' || source END AS grp FROM leaves
), based AS (
  SELECT *, leaf AS digest, row_number() OVER (PARTITION BY grp ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY grp) AS total FROM rows_
), {_tree("tree", "based")},
subroots AS (SELECT grp AS owner, digest, '' AS grp, row_number() OVER (ORDER BY grp) - 1 AS pos, count(*) OVER () AS total FROM tree WHERE total = 1),
{_tree("upper", "subroots")},
begun AS (SELECT id, grp, pos, coalesce(tampered, leaf) AS fold, '' AS proof FROM based),
{_walk("low", "tree", "begun")},
crossed AS (SELECT l.id, '' AS grp, s.pos, l.fold, l.proof FROM low_end l JOIN subroots s ON s.owner = l.grp),
{_walk("high", "upper", "crossed")}
SELECT b.doc_id, b.leaf, s.digest AS subroot, u.digest AS root, sha256(h.proof) AS proof_sha256, h.fold AS folded_root, h.fold = u.digest AS verified
FROM based b JOIN high_end h USING (id) JOIN subroots s ON s.owner = b.grp, (SELECT digest FROM upper WHERE total = 1) u
"""


@query("op12_merkle_manifest", OP12_SQL)
def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaves, roots and proofs of all documents, and whether a leaf of which some texts were tampered with still verifies."""
    columns = ["doc_id", "source", "lang", "n_chars", "text"]
    docs = table(spark, sf_dir, "documents").select(*columns)
    lowered_ = F.translate("text", string.ascii_uppercase, string.ascii_lowercase)
    tampered = F.when(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, leaf([*map(F.col, columns[:-1]), lowered_]))
    found = manifest(docs.withColumn("tampered", tampered), columns, carry=["tampered"])
    out = found.select(
        "doc_id", "leaf", "subroot", "root", digest(siblings(F.col("path"))).alias("proof_sha256"),
        folded(F.coalesce("tampered", "leaf"), F.col("path")).alias("folded_root"),
    )
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))
