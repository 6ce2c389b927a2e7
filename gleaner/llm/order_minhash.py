"""Document fingerprints by Order MinHash.

Each hash function selects the ``length`` smallest occurrence-numbered k-mers of a document, puts them back into text
order and hashes the tuple. Two documents agree on an entry if they share the selected k-mers in the same order, so the
share of equal entries falls with the edit distance, not only with the overlap of the k-mer sets.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.llm.common import Memo, table, texts
from gleaner.llm.registry import query
from gleaner.llm.words import byte_words

ENTRIES, LENGTH = 64, 2
#: Units of a k-mer, whatever the length of the text. A unit is a word, or a character of a word of over LONG bytes, so
#: that text without spaces has units too; what a word is taken as depends on that word alone.
UNITS, LONG = 2, 24
REMEMBERED, STRETCH = 200_000, 8_192
ODD = np.array([xxhash.xxh64_intdigest(str(i), 7) | 1 for i in range(ENTRIES)], np.uint64)[:, None]
SALT = np.array([xxhash.xxh64_intdigest(str(i), 8) for i in range(ENTRIES)], np.uint64)[:, None]
PLACE = np.array([xxhash.xxh64_intdigest(str(i), 9) | 1 for i in range(8)], np.uint64)
TOP = np.uint64(0xFFFFFFFFFFFFFFFF)


def mixed(values: np.ndarray) -> np.ndarray:
    values = (values ^ (values >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    return (values ^ (values >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)


class Fingerprinter:
    def __init__(self):
        self.hash_of = Memo(xxhash.xxh64_intdigest, REMEMBERED)

    def units(self, text: str) -> np.ndarray:
        """Hashes of the words, long ones as their characters; a text of white space alone is one unit."""
        parts = []
        for words in byte_words(text):
            if words and max(map(len, words)) > LONG:
                words = [u for w in words for u in ([w] if len(w) <= LONG else map(str.encode, w.decode()))]
            parts.append(np.fromiter(map(self.hash_of.__getitem__, words), np.uint64, len(words)))
        units = np.concatenate(parts)
        return units if len(units) or not text else np.array([self.hash_of[text[:1].encode()]], np.uint64)

    def kmers(self, text: str) -> np.ndarray:
        """Occurrence-numbered k-mers in text order: the second "of the" differs from the first."""
        units = self.units(text)
        k = min(UNITS, len(units))
        n = len(units) - k + 1 if len(units) else 0
        if not n:
            return np.empty(0, np.uint64)
        grams = sum((units[j : j + n] * PLACE[j] for j in range(k)), np.zeros(n, np.uint64))
        order = np.argsort(grams, kind="stable")
        new = np.concatenate([[True], grams[order][1:] != grams[order][:-1]])
        first = np.maximum.accumulate(np.where(new, np.arange(n), 0))
        times = np.empty(n, np.uint64)
        times[order] = (np.arange(n) - first).astype(np.uint64)
        return mixed(grams + times * PLACE[7])

    def signature(self, text: str | None) -> np.ndarray:
        """ENTRIES values of 32 bits; all zero for a null or empty text."""
        kmers = self.kmers(text) if text else np.empty(0, np.uint64)
        if not len(kmers):
            return np.zeros(ENTRIES, np.uint32)
        best = np.full((ENTRIES, LENGTH), TOP)
        where = np.full((ENTRIES, LENGTH), -1, np.int64)
        rows = np.arange(ENTRIES)
        for at in range(0, len(kmers), STRETCH):
            values = (kmers[None, at : at + STRETCH] ^ SALT) * ODD
            found, places = [best], [where]
            for _ in range(min(LENGTH, values.shape[1])):
                least = values.argmin(axis=1)
                found.append(values[rows, least][:, None])
                places.append((least + at)[:, None])
                values[rows, least] = TOP
            found, places = np.concatenate(found, axis=1), np.concatenate(places, axis=1)
            order = np.argsort(found, axis=1, kind="stable")[:, :LENGTH]
            best, where = np.take_along_axis(found, order, 1), np.take_along_axis(places, order, 1)
        where.sort(axis=1)
        chosen = np.where(where >= 0, kmers[where], np.uint64(0))
        tuples = sum((chosen[:, j] * PLACE[j] for j in range(LENGTH)), np.zeros(ENTRIES, np.uint64))
        return np.maximum(mixed(tuples) >> np.uint64(32), 1).astype(np.uint32)


def signatures(text: Column) -> Column:
    """array<bigint> of ENTRIES values; equal texts have equal signatures, null and empty texts zeros."""

    @F.arrow_udf("array<bigint>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = Fingerprinter()
        for batch in batches:
            yield pa.array([own.signature(t).tolist() for t in texts(batch)], pa.list_(pa.int64()))

    return run(text)


def likeness(a: Column, b: Column) -> Column:
    """Share of equal entries of two signatures, 0 to 1."""
    return F.size(F.filter(F.arrays_zip(a.alias("a"), b.alias("b")), lambda e: e["a"] == e["b"])) / F.size(a)


def neighbours(df: DataFrame, order: str, text: str) -> DataFrame:
    """(_range, _id, _text, _head) where the rows of a range, sorted, are each followed by the next of the whole order.

    The order is by descending ``order`` (nulls last), equal ones by descending text; the first follows the last. Ranges
    are cut at quantiles; each takes in a copy of the first row of the next range that has rows (_head). Only the cuts
    and one id a range pass through the driver.
    """
    spark = df.sparkSession
    rows = df.select(F.col(order).cast("bigint").alias("_id"), F.col(text).alias("_text"))
    n = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    cuts = rows.agg(F.percentile_approx("_id", [i / n for i in range(1, n)], 100 * n).alias("cuts")).first().cuts
    splits = [float("-inf"), *sorted({float(c) for c in cuts or [0]}), float("inf")]
    bucketizer = Bucketizer(splits=splits, inputCol="_place", outputCol="_bucket", handleInvalid="keep")
    placed = bucketizer.transform(rows.withColumn("_place", F.col("_id").cast("double")))
    # ranges count in the order of the rows: the largest ids are range 0, rows without an id the last one
    ranged = placed.select(
        F.when(F.col("_id").isNull(), len(splits)).otherwise(len(splits) - 1 - F.col("_bucket")).cast("int").alias("_range"), "_id", "_text",
    )
    firsts = sorted((r._range, r._id) for r in ranged.groupBy("_range").agg(F.max("_id").alias("_id")).collect())
    if not firsts:
        return ranged.select("*", F.lit(False).alias("_head"))
    targets = [(firsts[i - 1][0], head) for i, (_, head) in enumerate(firsts)]
    heads = spark.createDataFrame(targets, "_target int, _first bigint")  # one row a range
    first_rows = rows.join(F.broadcast(heads), F.col("_id").eqNullSafe(F.col("_first")))
    copies = first_rows.groupBy("_target").agg(F.max(F.struct("_id", "_text")).alias("_row"))
    return ranged.select("*", F.lit(False).alias("_head")).union(
        copies.select(F.col("_target").alias("_range"), "_row._id", "_row._text", F.lit(True).alias("_head"))
    )


SCHEMA = pa.schema([
    ("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()),
    ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64()),
])


def edited(text: str, following: str) -> str:
    """The last third replaced by as much of the following text (or all of it)."""
    third = len(text) // 3
    return text[: len(text) - third] + following[:third]


def compare_to_next(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: its fingerprint and that of its edited text, with the likeness to the edited and to the next text.

    A null text is empty; a single row is its own next. Rows that share an id follow each other by descending text. Texts
    move once, to their range; a task holds two rows at a time. Other columns are not read.
    """
    ranged = neighbours(df, doc_id, text)
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = ranged.repartition(parts, "_range").sortWithinPartitions("_range", "_head", F.desc_nulls_last("_id"), F.desc_nulls_last("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Fingerprinter()
        last = None
        for batch in batches:
            out = []
            for i, (home, key, head) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("_range", "_id", "_head")))):
                value = batch.column("_text")[i].as_py() or ""
                signature = own.signature(value)
                if last is not None and last[0] == home:
                    _, former, former_text, former_signature = last
                    changed = edited(former_text, value)
                    again = own.signature(changed)
                    out.append((
                        former, len(former_text), hashlib.sha256(changed.encode()).hexdigest(), former_signature.tobytes().hex(),
                        again.tobytes().hex(), float((again == former_signature).mean()), float((signature == former_signature).mean()),
                    ))
                last = None if head else (home, key, value, signature)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), SCHEMA.types)], schema=SCHEMA)

    return dealt.mapInArrow(
        run, "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, "
        "near_edited double, near_next double",
    )


@query("op6_order_minhash")
def op6_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare_to_next(table(spark, sf_dir, "documents"))
