"""Language identification with word-first backoff.

A word that training knows is scored by its log frequency in each language. An unseen word falls back to its known
character n-grams, the longest length that has any; so misspelt and new words still speak for a language, and a known
word is never diluted by its parts.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gleaner.llm.common import Memo, bounded_ids, fold, give_back, table, texts
from gleaner.llm.registry import query
from gleaner.llm.words import lower_words, spelled, words_in  # noqa: F401

#: Bounds of the model: training rows, known words and n-grams of each length per language.
TRAIN_ROWS, TOP_WORDS, TOP_GRAMS, LONGEST = 50_000, 20_000, 5_000, 5
#: Words a worker remembers, and the longest of them.
REMEMBERED, LONG = 100_000, 64
#: Distinct words of a language that a task counts before it gives them out.
PARTIAL = 50_000
UNKNOWN = "und"


def grams_of(word: str, n: int) -> list[str]:
    """Character n-grams; from two letters on, the ends of the word count as a letter."""
    marked = f"<{word}>" if n > 1 else word
    return [marked[i : i + n] for i in range(len(marked) - n + 1)]


def count_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, n, gram, seen): words have n = 0. Partial counts, given out when a language has many words; the sums are Spark's."""
    give_back()
    words: dict[str, Counter] = {}
    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), texts(batch.column(1))):
            own = words.setdefault(lang, Counter())
            for found in lower_words(text):
                own.update(found)
            if len(own) > PARTIAL:
                yield from _counted(lang, words.pop(lang))
    for lang, own in words.items():
        yield from _counted(lang, own)


def _counted(lang: str, counted: Counter) -> Iterator[pa.RecordBatch]:
    own: Counter = Counter()
    for word, times in counted.items():
        own[spelled(word)] += times
    for n in range(LONGEST + 1):
        seen: Counter = own if n == 0 else Counter()
        if n:
            for word, times in own.items():
                for gram in grams_of(word, n):
                    seen[gram] += times
        if seen:
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(seen)), pa.array([n] * len(seen), pa.int32()), pa.array(list(seen.keys())),
                 pa.array(list(seen.values()), pa.int64())], names=["lang", "n", "gram", "seen"],
            )


class Model:
    """Log frequencies by word and n-gram, a row of one value a language; bounded by TOP_WORDS and TOP_GRAMS."""

    def __init__(self, rows: list[tuple[str, int, str, int, int]]):
        self.languages = sorted({r[0] for r in rows})
        place = {lang: i for i, lang in enumerate(self.languages)}
        total = np.ones((LONGEST + 1, len(place)))
        for lang, n, _, _, all_seen in rows:
            total[n, place[lang]] = all_seen
        floor = np.log(0.5 / total)
        self.known: list[dict[str, int]] = [{} for _ in range(LONGEST + 1)]
        for _, n, gram, _, _ in rows:
            self.known[n].setdefault(gram, len(self.known[n]))
        self.values = [np.repeat(floor[n : n + 1], len(own), axis=0) for n, own in enumerate(self.known)]
        for lang, n, gram, seen, _ in rows:
            self.values[n][self.known[n][gram], place[lang]] = math.log(seen / total[n, place[lang]])

    def word(self, word: str) -> np.ndarray:
        """Log frequency of a word in each language, relative to their mean, so that only differences count."""
        at = self.known[0].get(word)
        if at is not None:
            row = self.values[0][at]
            return row - row.mean()
        for n in range(LONGEST, 0, -1):
            known = self.known[n]
            found = [k for g in grams_of(word, n) if (k := known.get(g)) is not None]
            if found:
                row = self.values[n][found].sum(axis=0) / len(found)
                return row - row.mean()
        return np.zeros(len(self.languages))


class _Rows(Memo):
    """Remembers no long words."""

    def __missing__(self, key):
        return super().__missing__(key) if len(key) <= LONG else self.make(key)


class Scorer:
    def __init__(self, model: Model):
        self.model = model
        self.rows = _Rows(lambda word: model.word(spelled(word)).tobytes(), REMEMBERED)

    def score(self, text: str | None) -> tuple[str, float, bool]:
        """Language, probability, and whether the text has a letter."""
        n, sums = 0, np.zeros(len(self.model.languages))
        for words in lower_words(text):
            n += len(words)
            rows = np.frombuffer(b"".join(map(self.rows.__getitem__, words)))
            sums += rows.reshape(len(words), len(sums)).sum(axis=0)
        if not n or not self.model.languages:
            return UNKNOWN, 0.0, n > 0
        weights = np.exp(sums - sums.max())
        best = int(np.argmax(sums))
        return self.model.languages[best], float(1.0 / weights.sum()), True


def train(
    df: DataFrame, lang: str = "lang", text: str = "text", doc_id: str = "doc_id", rows: int = TRAIN_ROWS,
    top_words: int = TOP_WORDS, top_grams: int = TOP_GRAMS,
) -> Model:
    """Fit on the texts of at most ``rows`` ids of rows with a language, those of the smallest hash; counts are Spark aggregates.

    Null texts, languages and ids teach nothing. Of equally frequent grams the lexically smaller stay. The model holds
    ``top_words`` words and ``top_grams`` n-grams of each length per language, so its size does not grow with the input.
    """
    named = df.select(F.col(doc_id).alias("doc_id"), F.col(lang).alias("lang"), F.col(text).alias("text"))
    named = named.filter("lang IS NOT NULL AND doc_id IS NOT NULL")
    ids = bounded_ids(named, "doc_id", rows)  # from the narrow columns: the texts are read once, for their counts
    sample = named.filter("text IS NOT NULL").join(F.broadcast(ids), F.col("doc_id") == F.col("_key"), "left_semi").select("lang", "text")
    counts = sample.mapInArrow(count_grams, "lang string, n int, gram string, seen bigint")
    sums = counts.groupBy("lang", "n", "gram").agg(F.sum("seen").alias("seen"))
    totals = sums.groupBy("lang", "n").agg(F.sum("seen").alias("all_seen"))
    best = Window.partitionBy("lang", "n").orderBy(F.desc("seen"), "gram")
    limit = F.when(F.col("n") == 0, top_words).otherwise(top_grams)
    kept = sums.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= max(top_words, top_grams)).filter(F.col("rank") <= limit)
    model = kept.join(F.broadcast(totals), ["lang", "n"]).select("lang", "n", "gram", "seen", "all_seen")
    return Model([tuple(r) for r in model.toLocalIterator()])


def identify(df: DataFrame, model: Model, text: str = "text", out: str = "language") -> DataFrame:
    """Add ``out``: struct (lang_pred, score, letters). ``und`` with score 0 for null texts, texts without a letter, or no model.

    Only the text is read: other columns, clashing names included, pass as they are. Equal texts have equal results.
    The score is the probability of the language among the known ones; ``letters`` says whether the text has any. Rows never
    meet.
    """
    shared = df.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("struct<lang_pred:string,score:double,letters:boolean>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        give_back()
        scorer = Scorer(shared.value)
        for batch in batches:
            found = [scorer.score(t) for t in texts(batch)]
            kinds = {"lang_pred": pa.string(), "score": pa.float64(), "letters": pa.bool_()}
            yield pa.StructArray.from_arrays([pa.array([f[k] for f in found], kind) for k, kind in enumerate(kinds.values())], names=list(kinds))

    return df.withColumn(out, run(F.col(text)))


def trained_on(docs: DataFrame) -> Model:
    """The model of the documents outside the held-out fold."""
    return train(docs.filter(fold("doc_id", 3) != 1))


@query("op8_language_id")
def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    found = identify(docs, trained_on(docs))
    return found.select(
        "doc_id", F.coalesce(fold("doc_id", 3) == 1, F.lit(False)).alias("held_out"), "language.lang_pred", "language.score",
    )
