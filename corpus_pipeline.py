"""Cleaning a corpus into training sequences: language, near-duplicates, repeated passages, secrets, packing.

Each stage takes what its predecessor kept, as the rows and columns of ``documents``; the last returns pieces of token
sequences. ``run`` writes every stage to the shared folder and reads it again, so a lost executor costs tasks, not stages.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gleaner.llm.common import table, unused
from gleaner.llm.language import UNKNOWN, identify, trained_on
from gleaner.llm.packing import pack, pieces
from gleaner.llm.secrets import redact
from gleaner.llm.simhash import near_duplicates
from gleaner.llm.substrings import drop_repeats
from gleaner.session import cut_lineage

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

#: Most documents in an Arrow batch while a stage runs. Whole texts are long: tens of thousands of them at a time would stand
#: beside each other in the executor's heap, in its Arrow buffers and in its Python workers.
BATCH_ROWS, BATCH_SETTING = 2_000, "spark.sql.execution.arrow.maxRecordsPerBatch"


def small_batches(stage: Stage) -> Stage:
    """The stage in a session whose Arrow batches hold BATCH_ROWS rows at most; a smaller setting stays."""

    @wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        if not 0 < int(spark.conf.get(BATCH_SETTING)) <= BATCH_ROWS:
            spark.conf.set(BATCH_SETTING, str(BATCH_ROWS))
        return stage(spark, docs, sf_dir)

    return run_stage


@small_batches
def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a language: null, empty, or without a letter. A null ``lang`` becomes the language found.

    The model learns from the documents at hand. Documents that no model could judge, because no row names a language, are
    kept by their text alone.
    """
    name = unused(docs, "language")
    found = identify(docs, trained_on(docs), out=name).filter(F.col(f"{name}.letters"))
    named = F.coalesce("lang", F.nullif(F.col(f"{name}.lang_pred"), F.lit(UNKNOWN)))
    return found.withColumn("lang", named).drop(name)


@small_batches
def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps of each group of near-duplicates the document with the smallest id.

    Rows that share an id are one document: the smallest text stays. Documents without an id are kept: nothing says which
    of them is the first.
    """
    kept, rows, place = unused(docs, "kept_id"), unused(docs, "rows"), unused(docs, "place")
    groups = near_duplicates(docs)
    first = groups.filter("doc_id = component_id").groupBy(F.col("doc_id").alias(kept)).agg(F.count(F.lit(1)).alias(rows))
    named = docs.join(first, F.col("doc_id") == F.col(kept))
    by_text = Window.partitionBy(kept).orderBy("text", *[c for c in docs.columns if c != "text"])
    shared = named.filter(F.col(rows) > 1).withColumn(place, F.row_number().over(by_text)).filter(F.col(place) == 1)
    alone = named.filter(F.col(rows) == 1).select(*docs.columns).union(shared.select(*docs.columns))
    return alone.union(docs.filter("doc_id IS NULL"))


@small_batches
def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes out passages that an earlier document has; a document of which nothing is left goes, untouched ones stay as they are."""
    name = unused(docs, "repeats")
    found = drop_repeats(docs, out=name)
    removed = F.col(f"{name}.n_removed")
    text = F.when(removed == 0, F.col("text")).otherwise(F.col(f"{name}.kept"))
    kept = found.filter((removed == 0) | (removed < F.col(f"{name}.n_words")))
    return with_length(kept.withColumn("text", text).drop(name))


@small_batches
def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Masks every secret found; no document goes."""
    return with_length(redact(docs))


@small_batches
def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of at most 2048 tokens, over everything that is left."""
    return pieces(pack(docs))


def with_length(docs: DataFrame) -> DataFrame:
    """``n_chars`` follows the text where the table has it."""
    if "n_chars" not in docs.columns:
        return docs
    return docs.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))


STAGES: list[tuple[str, Stage]] = [
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("substring_dedup", substring_dedup),
    ("secret_scan", secret_scan),
    ("packing", packing),
]

#: SQL has no tokenizer; tests compare the rows with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = cut_lineage(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
