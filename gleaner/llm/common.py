"""What the operators of this subpackage share."""

from __future__ import annotations

import ctypes
import gc
import time
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(doc_id: str, folds: int) -> Column:
    """Fold of a document: crc32 of its id as text; null for a null id."""
    return F.crc32(F.col(doc_id).cast("string")) % folds


def bounded_ids(df: DataFrame, key: str, limit: int) -> DataFrame:
    """At most ``limit`` distinct keys, those of the smallest hash: the same ones however the rows are dealt out.

    Hashes are even, so the smallest lie under a threshold that the number of keys gives: what meets in the one last task is
    little more than ``limit``, however many partitions there are. The result holds one long a row, ``limit`` rows: small
    enough to broadcast by construction.
    """
    keys = df.select(F.col(key).alias("_key")).filter("_key IS NOT NULL").withColumn("_hash", F.xxhash64("_key"))
    # rows, not distinct keys: where keys repeat the threshold may be too low, which is seen and mended below
    share = min(1.0, (1.2 * limit + 1000) / max(1, keys.count()))
    low = keys.filter(F.col("_hash") <= F.lit(int(-(2**63) + share * (2**64 - 1024)))) if share < 1 else keys
    few = low.distinct()
    if share < 1 and few.limit(limit).count() < limit:
        few = keys.distinct()
    return few.orderBy("_hash", "_key").limit(limit).select("_key")


def unused(df: DataFrame, name: str) -> str:
    """The name, with as many underscores before it as make it none of the columns'."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def texts(column: pa.Array | pa.ChunkedArray) -> Iterator[str | None]:
    """The values one by one: a batch of long texts is never held a second time as Python strings."""
    for i in range(len(column)):
        yield column[i].as_py()


_TRIM = getattr(ctypes.CDLL(None), "malloc_trim", None)
_given = [0.0]


def give_back(seconds: float = 1.0) -> None:
    """Memory that earlier tasks of this worker freed, back to the system: a worker lives on and serves other stages.

    Not more than once in so many seconds, so that short tasks do not pay for it.
    """
    now = time.monotonic()
    if now - _given[0] >= seconds:
        _given[0] = now
        gc.collect()
        pa.default_memory_pool().release_unused()
        if _TRIM:
            _TRIM(0)


class Memo(dict):
    """Values by key, made on demand; holds ``limit`` keys at most, so that memory stays bounded.

    Frequent keys come early. When it is full, the newest quarter goes and the older keys stay. Results never depend on
    what is remembered.
    """

    def __init__(self, make: Callable, limit: int):
        super().__init__()
        self.make, self.limit = make, limit

    def __missing__(self, key):
        if len(self) >= self.limit:
            for _ in range(max(1, self.limit // 4)):
                self.popitem()
        value = self[key] = self.make(key)
        return value
