"""Grouped work that must survive a group holding a third of all rows.

A window over such a group runs in one task. These helpers give the same results in two bounded steps.
Joins on hot keys need none of this here: the other side is always reduced to one row per key first, and
AQE splits an oversized partition of the big side (spark.sql.adaptive.skewJoin).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

def _dealt(df: DataFrame, group: list[str], chunk: Column) -> DataFrame:
    """Rows dealt out by group and chunk. Without it, rows that come partitioned by the group alone (from a join on it)
    would satisfy the window as they are, and all chunks of a hot group would stay in one task."""
    return df.withColumn("_chunk", chunk).repartition(*group, "_chunk")


def ranked(
    df: DataFrame, group: list[str], chunk: Column, order: list[Column], out: str = "rank",
) -> DataFrame:
    """Exact row_number within ``group``, in the order of ``chunk`` then ``order``.

    ``chunk`` must not decrease along the order (a time or sequence range). Rows are numbered
    inside their chunk; the running count over chunks is added to it.
    """
    keyed = _dealt(df, group, chunk)
    inside = Window.partitionBy(*group, "_chunk").orderBy(*order)
    sizes = keyed.groupBy(*group, "_chunk").agg(F.count(F.lit(1)).alias("_size"))
    before = Window.partitionBy(*group).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.withColumn("_before", F.coalesce(F.sum("_size").over(before), F.lit(0))).drop("_size")
    numbered = keyed.withColumn("_inside", F.row_number().over(inside))
    return (
        numbered.join(offsets, [*group, "_chunk"])
        .withColumn(out, (F.col("_before") + F.col("_inside")).cast("bigint"))
        .drop("_chunk", "_before", "_inside")
    )


def running_min(
    df: DataFrame, group: list[str], chunk: Column, order: list[Column], value: str, out: str,
) -> DataFrame:
    """min(value) over all earlier rows of the group, current row excluded; chunked like ``ranked``."""
    keyed = _dealt(df, group, chunk)
    inside = Window.partitionBy(*group, "_chunk").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    lows = keyed.groupBy(*group, "_chunk").agg(F.min(value).alias("_low"))
    before = Window.partitionBy(*group).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    carried = lows.withColumn("_carried", F.min("_low").over(before)).drop("_low")
    return (
        keyed.withColumn("_own", F.min(value).over(inside))
        .join(carried, [*group, "_chunk"])
        .withColumn(out, F.least("_own", "_carried"))
        .drop("_chunk", "_own", "_carried")
    )


def previous_value(
    df: DataFrame, group: list[str], chunk: Column, order: list[Column], value: str, out: str,
) -> DataFrame:
    """lag(value) within the group for a ``value`` that never decreases along the order (a stamp)."""
    keyed = _dealt(df, group, chunk)
    inside = Window.partitionBy(*group, "_chunk").orderBy(*order)
    lasts = keyed.groupBy(*group, "_chunk").agg(F.max(value).alias("_last"))
    before = Window.partitionBy(*group).orderBy("_chunk")
    carried = lasts.withColumn("_carried", F.lag("_last").over(before)).drop("_last")
    return (
        keyed.withColumn("_own", F.lag(value).over(inside))
        .join(carried, [*group, "_chunk"])
        .withColumn(out, F.coalesce("_own", "_carried"))
        .drop("_chunk", "_own", "_carried")
    )


def first_rows(df: DataFrame, keys: list[str], order: list[Column], n: int = 1) -> DataFrame:
    """The first n rows per key. Spark keeps n per task before the shuffle (WindowGroupLimit), so hot keys stay small."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= n).drop("_rn")
