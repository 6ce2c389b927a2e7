"""Text quality from learned subword embeddings.

A text is the average of the vectors of its words, their character n-grams and its repeats (word pairs of one word, which
share a bucket), hashed into a fixed number of buckets; a softmax layer over that average gives the label. Vectors and layer are trained together by stochastic gradient descent on a
bounded number of labelled texts. As the layer is linear, what a bucket adds to the log odds is one number: scoring sums
these numbers over a whole text, word by word.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.llm.common import bounded_ids, fold, table, texts
from gleaner.llm.registry import query
from gleaner.session import cut_lineage

#: Bound of the model: labelled rows it learns from, those with the smallest hash of their id.
EXAMPLES = 4000
#: Buckets as a power of two, length of a vector, lengths of n-grams.
BITS, DIMENSIONS, GRAMS = 17, 8, (3, 4)
BUCKETS = 1 << BITS
EPOCHS, RATE, SEED = 16, 4.0, 7
#: Characters read at a time, and where a text may be cut: the white space of the word contracts.
STRETCH, BLANK = 1 << 18, re.compile(r"[\x20\x09-\x0D]")
#: Odd multipliers of the hashes: of a word, of the places of an n-gram, of the last mix.
WORD, MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)
PLACES = np.array([0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)


def bucket(hashes: np.ndarray) -> np.ndarray:
    mixed = (hashes ^ (hashes >> np.uint64(32))) * MIX
    return (mixed >> np.uint64(64 - BITS)).astype(np.int32)


#: The bucket of a word that stands behind itself.
REPEAT = int(bucket(np.zeros(1, np.uint64) + WORD)[0])


def buckets_in(text: str | None, stretch: int = STRETCH) -> Iterator[np.ndarray]:
    """Buckets of the words of a whole text, of their n-grams (the ends of a word count as a blank) and of its repeats.

    A stretch of whole words at a time; none for a text without words.
    """
    text, at, last = text or "", 0, None
    while at < len(text):
        m = BLANK.search(text, at + stretch)
        end = m.start() if m else len(text)
        codes = np.frombuffer(f" {text[at:end]} ".encode("utf-32-le"), np.uint32).astype(np.uint64)
        at = end
        codes[(codes >= 9) & (codes <= 13)] = 32
        blank = codes == 32
        keep = ~blank
        keep[1:] |= ~blank[:-1]  # one blank behind every word
        keep[0] = True
        codes, blank = codes[keep], blank[keep]
        if len(codes) == 1:
            continue
        if blank[1]:
            codes, blank = codes[1:], blank[1:]
        edges = np.flatnonzero(blank)
        sizes = np.diff(edges)  # a word and the blank before it
        powers = np.cumprod(np.full(int(sizes.max()), WORD))
        place = np.arange(len(codes) - 1) - np.repeat(edges[:-1], sizes)
        words = np.add.reduceat(codes[:-1] * powers[place], edges[:-1])
        yield bucket(words)
        for n in GRAMS:
            count = len(codes) - n + 1
            if count > 0:
                inside = ~blank[1 : 1 + count]
                for k in range(2, n - 1):
                    inside &= ~blank[k : k + count]
                grams = sum((codes[k : k + count] * PLACES[k] for k in range(n)), np.zeros(count, np.uint64))
                yield bucket(grams[inside] + np.uint64(n))
        repeats = int((words[1:] == words[:-1]).sum()) + (last is not None and words[0] == last)
        last = words[-1]
        yield np.full(repeats, REPEAT, np.int32)


def counts_of(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of a whole text, ascending, with their counts."""
    return np.unique(np.concatenate([np.empty(0, np.int32), *buckets_in(text)]), return_counts=True)


class Model:
    """Log odds of label 1: what every bucket adds (averaged over the text), and what a text without words has."""

    def __init__(self, adds: np.ndarray, bias: float):
        self.adds, self.bias = adds, bias

    def chance(self, text: str | None) -> float:
        total, n = 0.0, 0
        for found in buckets_in(text):
            total += float(self.adds[found].sum())
            n += len(found)
        odds = self.bias + (total / n if n else 0.0)
        return 1 / (1 + math.exp(-min(50.0, max(-50.0, odds))))


def fit(rows: list[tuple[np.ndarray, np.ndarray, int]], epochs: int = EPOCHS, rate: float = RATE, seed: int = SEED) -> Model:
    """Gradient descent over (buckets, counts, label) of texts, one text a step, the rate falling to nothing.

    The same rows in the same order give the same model. With one label alone, or no rows, the model is that label's share.
    """
    labels = np.array([label for _, _, label in rows], np.int64)
    share = (labels.sum() + 0.5) / (len(labels) + 1.0)
    bias = np.array([0.0, math.log(share / (1 - share))])
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-1 / DIMENSIONS, 1 / DIMENSIONS, (BUCKETS, DIMENSIONS)).astype(np.float32)
    layer = np.zeros((2, DIMENSIONS), np.float32)
    layer[1] = rng.uniform(-1, 1, DIMENSIONS)
    seen = np.zeros(BUCKETS, bool)
    usable = [i for i, (buckets, _, _) in enumerate(rows) if len(buckets)] if 0 < labels.sum() < len(labels) else []
    for i in usable:
        seen[rows[i][0]] = True
    steps = epochs * len(usable)
    for step in range(steps):
        if step % len(usable) == 0:
            order = rng.permutation(usable)
        buckets, counts, label = rows[order[step % len(usable)]]
        part = (counts / counts.sum()).astype(np.float32)
        own = vectors[buckets]
        mean = part @ own
        odds = layer @ mean + bias
        chance = np.exp(odds - odds.max())
        error = (chance / chance.sum()).astype(np.float32)
        error[label] -= 1
        now = rate * (1 - step / steps)
        vectors[buckets] = own - np.outer(now * part, error @ layer)
        layer -= now * 0.05 * np.outer(error, mean)
        bias -= now * 0.005 * error
    adds = np.where(seen, vectors @ (layer[1] - layer[0]), 0.0).astype(np.float64)
    return Model(adds, float(bias[1] - bias[0]))


def learn(docs: DataFrame, labels: DataFrame, label: str = "quality", examples: int = EXAMPLES) -> Model:
    """Fit on ``docs`` (doc_id, text) whose ids ``labels`` (doc_id, ``label``) marks 0 or 1.

    Of at most ``examples`` labelled ids the buckets of their texts and counts reach the driver, nothing else; of several
    labels of an id the largest counts. Rows without id, text or label teach nothing.
    """
    marked = labels.filter(F.col("doc_id").isNotNull() & F.col(label).isNotNull())
    ids = bounded_ids(marked, "doc_id", examples)
    chosen = cut_lineage(
        marked.join(F.broadcast(ids), F.col("doc_id") == F.col("_key"), "left_semi").groupBy("doc_id").agg((F.max(label) > 0).cast("int").alias("label"))
    )
    kind = pa.list_(pa.int32())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [counts_of(t) for t in texts(batch.column(2))]
            columns = [pa.array([f[k] for f in found], kind) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], names=["doc_id", "label", "buckets", "counts"])

    sample = docs.filter("text IS NOT NULL").select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("doc_id", "label", "text")
    counted = sample.select(F.col("doc_id").cast("bigint"), "label", "text").mapInArrow(run, "doc_id bigint, label int, buckets array<int>, counts array<int>").toArrow()
    rows = [
        (doc, b.values.to_numpy().tobytes(), b.values.to_numpy(), c.values.to_numpy(), y)
        for doc, y, b, c in zip(counted.column("doc_id").to_pylist(), counted.column("label").to_pylist(), counted.column("buckets"), counted.column("counts"))
    ]
    rows.sort(key=lambda r: r[:2])
    return fit([(b, c.astype(np.float64), y) for _, _, b, c, y in rows])


def score(df: DataFrame, model: Model, text: str = "text", out: str = "quality") -> DataFrame:
    """Add ``out``: the chance of label 1, from the whole text alone. Null texts and texts without words get the model's share.

    Equal texts get equal scores, however rows are dealt out; other columns pass as they are.
    """
    shared = df.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = shared.value
        for batch in batches:
            yield pa.array([own.chance(t) for t in texts(batch)], pa.float64())

    return df.withColumn(out, run(F.col(text)))


@query("op13_quality_classifier")
def op13_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chance that a document's quality label is 1, learnt outside the held-out fold."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality").filter(fold("doc_id", 5) != 0)
    return score(docs, learn(docs, labels), out="score").select(
        "doc_id", F.coalesce(fold("doc_id", 5) == 0, F.lit(False)).alias("held_out"), "score",
        F.when(F.col("score") >= 0.3, 1).otherwise(0).alias("predicted"),
    )
