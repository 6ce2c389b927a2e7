"""Exact top-k search over binary codes by incremental multi-index hashing.

A code is cut into segments. If two codes differ in at most m * (r + 1) - 1 bits over m segments, some segment pair
differs in at most r bits. Radii 0, 1, 2, ... are searched in turn in every segment; a query is done as soon as its k-th
verified distance is within what the searched radii cover. Only open queries go on, so the work follows the data.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gleaner.llm.common import table
from gleaner.llm.registry import query
from gleaner.session import cut_lineage

MIN_SEGMENTS = 3


def sign_codes(vectors: Column) -> Column:
    """Binary code of a vector: one bit a dimension, set where the value is above 0, in longs of 64 bits; null for null."""

    @F.arrow_udf("array<bigint>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            rows = []
            for i in range(len(batch)):
                values = batch[i].as_py()
                if values is None:
                    rows.append(None)
                    continue
                bits = np.array([v is not None and v > 0 for v in values], bool)
                bits = np.concatenate([bits, np.zeros(-len(bits) % 64, bool)])
                rows.append(np.packbits(bits, bitorder="little").view("<i8").tolist())
            yield pa.array(rows, pa.list_(pa.int64()))

    return run(vectors)


def cut(rows: int) -> list[tuple[int, int]]:
    """(first bit, width) of the segments of 64 bits: about log2 of the number of codes wide, so that a segment value is
    held by about one code whatever their number; at least MIN_SEGMENTS, which bounds the values within a radius."""
    parts = min(16, max(MIN_SEGMENTS, round(64 / math.log2(max(2, rows)))))
    edges = [64 * i // parts for i in range(parts + 1)]
    return [(a, b - a) for a, b in zip(edges, edges[1:])]


def segments(words: int, cuts: list[tuple[int, int]]) -> list[Column]:
    """The segments of a code of ``words`` longs."""
    return [
        F.shiftrightunsigned(F.element_at("code", w + 1), first).bitwiseAND((1 << width) - 1)
        for w in range(words) for first, width in cuts
    ]


def flips(radius: int, width: int) -> list[int]:
    return [sum(1 << b for b in bits) for bits in combinations(range(width), radius)]


def nearest_codes(
    base: DataFrame, queries: DataFrame, k: int = 10, words: int = 1,
) -> DataFrame:
    """(query_id, id, distance, rank): the k nearest of ``base`` (id, code) to each of ``queries`` (query_id, code).

    Exact under Hamming distance; ties by id, null ids and codes are left out, repeated ids count as often as they come.
    Fewer base rows than k give them all. Base codes are grouped first: equal codes are one entry that knows its k
    smallest ids, so a code shared by a third of all rows is one row. Each radius meets each code once per query: the
    candidates of a round are the codes that are nearer in some segment for the first time, found by equality of segment
    values. Rounds end when every query is covered; the last possible round covers all.
    """
    codes = base.filter("id IS NOT NULL AND code IS NOT NULL").select("id", "code")
    by_code = Window.partitionBy("code").orderBy("id")
    few = codes.withColumn("n", F.row_number().over(by_code)).filter(F.col("n") <= k)
    entries = cut_lineage(few.groupBy("code").agg(F.array_sort(F.collect_list("id")).alias("ids")))
    n = entries.count()
    cuts = cut(n)
    m, widest = words * len(cuts), max(width for _, width in cuts)
    filed = entries.select("code", F.posexplode(F.array(*segments(words, cuts))).alias("segment", "value"))
    filed = cut_lineage(filed.select("segment", "value", F.col("code").alias("found")))
    asked = cut_lineage(queries.filter("query_id IS NOT NULL AND code IS NOT NULL").select("query_id", "code"))
    distinct = cut_lineage(asked.select("code").distinct())
    best = None
    still = distinct
    enough = min(n, k)
    for radius in range(widest + 1):
        probes = still.select("code", F.posexplode(F.array(*segments(words, cuts))).alias("segment", "own"))
        # segments are of one width or the next: each takes the flips of its own
        own_flips = F.array(*[F.lit(width) for _ in range(words) for _, width in cuts])
        by_width = {width: F.lit(flips(radius, width)).cast("array<bigint>") for _, width in cuts}
        width = F.element_at(own_flips, F.col("segment") + 1)
        choice = F.coalesce(*[F.when(width == w, f) for w, f in by_width.items()])
        probes = probes.withColumn("flip", F.explode(choice))
        probes = probes.select("code", "segment", F.col("own").bitwiseXOR(F.col("flip")).alias("value"))
        # the exploded probes look far smaller to the planner than they are: never broadcast them
        pairs = probes.hint("merge").join(filed, ["segment", "value"]).select("code", "found").distinct()
        distance = sum((F.bit_count(F.element_at("code", w + 1).bitwiseXOR(F.element_at("found", w + 1))) for w in range(1, words)),
                       F.bit_count(F.element_at("code", 1).bitwiseXOR(F.element_at("found", 1))))
        fresh = pairs.withColumn("distance", distance.cast("bigint"))
        merged = fresh if best is None else fresh.unionByName(best.select("code", "found", "distance")).distinct()
        order = Window.partitionBy("code").orderBy("distance", "found")
        # the k-th distance keeps its ties: a code beyond place k at that distance may carry a smaller id
        ranked = merged.withColumn("place", F.row_number().over(order))
        best = cut_lineage(_within_k(ranked, k))
        reach = m * (radius + 1) - 1
        state = best.groupBy("code").agg(F.max("distance").alias("far"), F.count(F.lit(1)).alias("n"))
        open_ = still.join(state, "code", "left").filter(
            F.col("n").isNull() | (F.col("n") < enough) | (F.col("far") > reach)
        ).select("code")
        still = cut_lineage(open_)
        if still.isEmpty():
            break
    hits = best.join(entries.select(F.col("code").alias("found"), "ids"), "found").select("code", "distance", F.explode("ids").alias("id"))
    order = Window.partitionBy("code").orderBy("distance", "id")
    top = hits.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return asked.join(top, "code").select("query_id", "id", "distance", F.col("rank").cast("bigint").alias("rank"))


def _within_k(ranked: DataFrame, k: int) -> DataFrame:
    """Codes up to the distance of the k-th nearest code, its ties included."""
    limit = ranked.filter(F.col("place") <= k).groupBy("code").agg(F.max("distance").alias("limit"))
    return ranked.join(limit, "code").filter("distance <= limit").select("code", "found", "distance")


OP9_SQL = """
WITH codes AS (
  SELECT vec_id, list_transform(embedding, lambda v: CASE WHEN v > 0 THEN '1' ELSE '0' END) AS bits FROM embeddings
), coded AS (SELECT vec_id, array_to_string(bits, '')::BIT AS code FROM codes),
pairs AS (
  SELECT q.vec_id AS query_id, b.vec_id, bit_count(xor(q.code, b.code))::BIGINT AS distance
  FROM coded q, coded b WHERE q.vec_id % 100 = 0
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) AS rank FROM pairs
) SELECT query_id, vec_id, distance, rank FROM ranked WHERE rank <= 10
"""


@query("op9_exact_top_k", OP9_SQL)
def op9_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 nearest vectors, by Hamming distance of sign codes, to each whose id is divisible by 100."""
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), sign_codes(F.col("embedding")).alias("code"))
    coded = cut_lineage(vectors)
    queries = coded.filter("id % 100 = 0").select(F.col("id").alias("query_id"), "code")
    return nearest_codes(coded, queries).select("query_id", F.col("id").alias("vec_id"), "distance", "rank")
