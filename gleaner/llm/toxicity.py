"""Toxicity by nearest labelled examples.

Documents are compared by the exact TF-IDF cosine over all words, and word starts, that labelled examples hold; no term is
left out. A term's weight is its rarity among all documents, raised by how much oftener toxic examples hold it than clean
ones (relevance frequency); only what most clean examples hold weighs nothing. The examples lie in blocks of like ones: rare
terms in lists, a block's frequent ones in rows beside their largest weight. The lists are summed over all examples first,
and only blocks whose frequent terms could still lift an example to the k-th best are worked out. The neighbours vote,
weighted by their cosine, against a prior of the share of toxic examples; their ids are the evidence.
"""

from __future__ import annotations

import math
import sys
import zlib
from array import array
from collections import Counter
from collections.abc import Iterable, Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.llm.common import Memo, bounded_ids, fold, give_back, table, texts
from gleaner.llm.registry import query
from gleaner.llm.words import lower_words, spelled, words_in  # noqa: F401
from gleaner.session import cut_lineage

#: Bound of the model: labelled rows it learns from.
EXAMPLES = 20_000
#: Word starts that are terms of their own.
STARTS = (4, 5, 6, 7)
NEIGHBOURS, BLOCK, PRIOR_WEIGHT = 15, 256, 0.25
REMEMBERED = 200_000
#: Texts that are asked together, and entries that are packed or sorted together.
ASKED, PACKED = 128, 1 << 20
#: Entries of a list that is kept as an array of its own.
LONG = 16
#: Groups of like examples, told apart by the most frequent terms that weigh.
GROUPS, LEADING = 16, 256
#: A term has a row in a block if its examples there times its share of all examples are more; what single precision may be out.
ROWS, ROUNDING = 2, 1e-5
LOGS = 1 + np.log(np.maximum(1, np.arange(1 << 16)))


def terms_of(word: bytes | str) -> tuple[str, ...]:
    """The word and its starts (marked by a hyphen)."""
    word = spelled(word)
    return (word, *(f"{word[:n]}-" for n in STARTS if len(word) > n))


def words_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The distinct words of each batch."""
    for batch in batches:
        seen: set = set()
        for text in texts(batch.column(0)):
            for words in lower_words(text):
                seen.update(words)
        yield pa.RecordBatch.from_arrays([pa.array(list({spelled(w) for w in seen}), pa.string())], names=["word"])


class Vectors:
    """Term counts of texts over a fixed vocabulary, by the places of its terms, many texts at once."""

    def __init__(self, terms: list[str]):
        self._take("\n".join(terms).encode())  # terms are letters and hyphens

    def _take(self, names: bytes) -> None:
        """The terms lie in one string, and their places by a part of their checksums: an object each would take far more."""
        self.names = names
        ends = np.append(np.flatnonzero(np.frombuffer(names, np.uint8) == ord("\n")), len(names)) if names else np.empty(0, np.int64)
        self.n_terms = len(ends)
        self.start = array("q", np.append(0, ends + 1).tobytes())
        self.bits = (1 << max(1, self.n_terms).bit_length()) - 1
        bucket = np.fromiter((zlib.crc32(names[a : b - 1]) & self.bits for a, b in pairwise(self.start)), np.int64, self.n_terms)
        self.order = array("i", np.argsort(bucket, kind="stable").astype(np.int32).tobytes())
        self.bucket = array("i", by_row(bucket, self.bits + 1).astype(np.int32).tobytes())
        # the row of a word in the table is the number of words known before it
        self.known = Memo(self._row, sys.maxsize)
        self.table = np.full((1024, 1 + len(STARTS)), -1)
        self.times, self.last = np.zeros((2, self.n_terms), np.int64)

    def __getstate__(self) -> bytes:
        return zlib.compress(self.names, 1)

    def __setstate__(self, state: bytes) -> None:
        self._take(zlib.decompress(state))

    @property
    def terms(self) -> list[str]:
        return self.names.decode().split("\n") if self.names else []

    def place(self, term: str) -> int:
        """Where the term stands, or -1."""
        name = term.encode()
        at = zlib.crc32(name) & self.bits
        for i in self.order[self.bucket[at] : self.bucket[at + 1]]:
            if self.names[self.start[i] : self.start[i + 1] - 1] == name:
                return i
        return -1

    def _row(self, word: bytes | str) -> int:
        n, width = len(self.known), self.table.shape[1]
        if n == len(self.table):
            self.table = np.concatenate([self.table, np.full_like(self.table, -1)])
        found = [self.place(t) for t in terms_of(word)]
        self.table[n] = found + [-1] * (width - len(found))
        return n

    def count(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        """The places of the text's terms, in order, and how often they occur."""
        seen = []
        for words in lower_words(text):
            times = Counter(words)
            rows = np.fromiter(map(self.known.__getitem__, times), np.int64, len(times))
            found = self.table[rows]
            held = found >= 0
            n = np.broadcast_to(np.fromiter(times.values(), np.int64, len(times))[:, None], found.shape)[held]
            found = found[held]
            np.add.at(self.times, found, n)
            at = np.arange(len(found))
            self.last[found] = at
            seen.append(found[self.last[found] == at])
        own = np.sort(seen[0]) if len(seen) == 1 else np.unique(np.concatenate(seen))
        times = self.times[own]
        self.times[own] = 0
        if over := max(0, len(self.known) - REMEMBERED):
            for _ in range(over + REMEMBERED // 4):  # frequent words come early: the newest go
                self.known.popitem()
        return own, times

    def counts(self, values: Iterable[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Where each text's terms start (and the end of the last); the terms and times of all texts, one behind another."""
        found = [self.count(text) for text in values]
        none = np.empty(0, np.int64)
        first = np.cumsum([0, *(len(own) for own, _ in found)])
        return first, np.concatenate([none, *(own for own, _ in found)]), np.concatenate([none, *(times for _, times in found)])


def ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """All places of the ranges, one range behind another."""
    return np.repeat(starts - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())


def by_row(rows: np.ndarray, n: int) -> np.ndarray:
    """Where each of ``n`` rows starts in ``rows`` (sorted), and the end."""
    return np.concatenate([[0], np.cumsum(np.bincount(rows, minlength=n))])


def packed(values: np.ndarray) -> list[bytes]:
    """32-bit integers, byte by byte of their places, compressed, a million at a time."""
    parts = (values[i : i + PACKED] for i in range(0, len(values), PACKED))
    return [zlib.compress(np.ascontiguousarray(v.astype("<i4").view(np.uint8).reshape(-1, 4).T).tobytes(), 1) for v in parts]


def unpacked(data: list[bytes], kind: np.dtype | type = np.int32) -> np.ndarray:
    out, at = np.empty(PACKED * len(data), kind), 0
    for part in data:
        places = np.frombuffer(zlib.decompress(part), np.uint8).reshape(4, -1)
        out[at : at + places.shape[1]] = np.ascontiguousarray(places.T).view("<i4").reshape(-1)
        at += places.shape[1]
    return out[:at]


def damped(times: np.ndarray) -> np.ndarray:
    return LOGS[times] if times.dtype.itemsize <= 2 else 1 + np.log(times.astype(float))


def alike(vectors: np.ndarray, groups: int = GROUPS) -> np.ndarray:
    """A group for every row, by the direction of the rows: the same one for the same rows."""
    if not len(vectors):
        return np.empty(0, np.int64)
    centers, near = vectors[:1], np.full(len(vectors), -1.0, np.float32)
    while len(centers) < groups:
        near = np.maximum(near, vectors @ centers[-1])
        centers = np.concatenate([centers, vectors[[int(near.argmin())]]])
    for _ in range(5):
        group = (vectors @ centers.T).argmax(axis=1)
        sums = np.stack([vectors[group == g].sum(axis=0) for g in range(groups)])
        centers = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-9)
    return group


class BlockMaxIndex:
    """Unit vectors of examples in blocks of like ones.

    A term that is frequent in a block lies there as a row of numbers for all its examples, with the largest of them; all
    others lie in lists by term. A search sums the lists first; of the blocks it works out those whose largest numbers, or
    longest rest of a vector, could still lift an example to the k-th best.
    """

    def __init__(self, rows: Iterable[tuple[int, int, dict[int, int]]], idf: np.ndarray, k: int = NEIGHBOURS):
        rows = [(doc, toxic, sorted(counts.items())) for doc, toxic, counts in rows]
        terms = np.array([t for r in rows for t, _ in r[2]], np.int32)
        times = np.array([n for r in rows for _, n in r[2]], np.int32)
        first = np.cumsum([0, *(len(r[2]) for r in rows)])
        self._take(np.array([r[0] for r in rows], np.int64), np.array([r[1] for r in rows], np.float64), first, terms, times, idf, k)

    @classmethod
    def of(cls, docs: np.ndarray, toxic: np.ndarray, first: np.ndarray, terms: np.ndarray, times: np.ndarray, idf: np.ndarray, k: int = NEIGHBOURS) -> BlockMaxIndex:
        """The same of examples whose terms, in order, and counts lie one behind another, from ``first`` on."""
        index = cls.__new__(cls)
        index._take(docs, toxic, first, terms, times, idf, k)
        return index

    def _take(self, docs: np.ndarray, toxic: np.ndarray, first: np.ndarray, terms: np.ndarray, times: np.ndarray, idf: np.ndarray, k: int) -> None:
        self.idf, self.k = idf, k
        times = times.astype(np.min_scalar_type(max(1, int(times.max(initial=1)))))
        often = np.bincount(terms, minlength=len(idf)) * (idf > 0)
        frequent = np.full(len(idf), -1)
        top = np.argsort(-often, kind="stable")[:LEADING]
        frequent[top] = np.arange(len(top))
        spans, norms, leading = [], [], np.zeros((len(docs), max(1, len(top))), np.float32)
        for i, (start, end) in enumerate(zip(first[:-1].tolist(), first[1:].tolist())):
            own = terms[start:end]
            values = damped(times[start:end]) * idf[own]
            norms.append(math.sqrt(float((values**2).sum())))
            held = values > 0
            spans.append((own[held], times[start:end][held]))
            place = frequent[own]
            leading[i, place[place >= 0]] = values[place >= 0]
        length = np.linalg.norm(leading, axis=1)
        leading /= np.maximum(length, 1e-9)[:, None]
        # like shares of frequent terms keep the bounds of a block tight; examples without a term that weighs are near to nothing
        order = [i for i in np.lexsort((docs, length / np.maximum(norms, 1e-9), alike(leading))).tolist() if len(spans[i][0])]
        del leading
        self.docs, self.toxic, self.norms = docs[order], toxic[order], np.array(norms, np.float64)[order]
        self.blocks = math.ceil(len(order) / BLOCK)
        self.first = np.concatenate([[0], np.cumsum([len(spans[i][0]) for i in order], dtype=np.int64)])
        self.own_terms = np.concatenate([np.empty(0, np.int32), *(spans[i][0] for i in order)])
        self.own_times = np.concatenate([np.empty(0, times.dtype), *(spans[i][1] for i in order)])
        self.top: list[np.ndarray] | None = None

    @property
    def own_values(self) -> np.ndarray:
        return damped(self.own_times) * self.idf[self.own_terms] / np.repeat(self.norms, np.diff(self.first))

    def __getstate__(self) -> dict:
        """Counts travel, packed; the values are worked out of them again, the same to the last bit."""
        small = {k: v for k, v in self.__dict__.items() if k in ("idf", "k", "docs", "toxic", "blocks", "first", "norms")}
        return small | {"own_terms": packed(np.diff(self.own_terms, prepend=np.int32(0))), "own_times": packed(self.own_times), "kind": self.own_times.dtype}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update({k: v for k, v in state.items() if k != "kind"})
        self.own_terms = unpacked(state["own_terms"])
        np.cumsum(self.own_terms, out=self.own_terms)
        self.own_times = unpacked(state["own_times"], state["kind"])
        self.top = None

    def invert(self) -> None:
        """Lists and rows; made where the index is asked, so that only the examples travel. A range of terms at a time."""
        n, t, blocks = len(self.docs), len(self.idf), max(1, self.blocks)
        owner = np.repeat(np.arange(n, dtype=np.int32), np.diff(self.first))
        often = np.bincount(self.own_terms, minlength=t)
        total, dense, used = np.cumsum(often), [], 0
        # an entry of a list: the place of an example, and its value as the bits of a single
        entries = np.empty((len(owner), 2), np.int32)
        self.start = np.zeros(t + 1, np.int64)
        ends = np.unique(np.searchsorted(total, np.arange(0, total[-1] if t else 0, PACKED) + PACKED).clip(max=max(0, t - 1)) + 1)
        for low, high in zip([0, *ends[:-1].tolist()], ends.tolist()):
            at = np.flatnonzero((self.own_terms >= low) & (self.own_terms < high))
            at = np.sort((self.own_terms[at].astype(np.int64) << 32) | at) & 0xFFFFFFFF
            terms, place = self.own_terms[at], owner[at]
            value = (damped(self.own_times[at]) * self.idf[terms] / self.norms[place]).astype(np.float32)
            key = (terms - low).astype(np.int64) * blocks + place // BLOCK
            new = np.flatnonzero(np.diff(key, prepend=-1))
            size = np.diff(new, append=len(key))
            # a row costs every search the same, a list those that ask for the term
            rows = np.repeat(size * often[terms[new]] > ROWS * n, size)
            dense.append((terms[rows], place[rows], value[rows]))
            lists = entries[used : used + np.count_nonzero(~rows)]
            lists[:, 0], lists[:, 1] = place[~rows], value[~rows].view(np.int32)
            used += len(lists)
            self.start[low + 1 : high + 1] = np.bincount(terms[~rows] - low, minlength=high - low)
        np.cumsum(self.start, out=self.start)
        self.entries = entries[:used].view(np.int64).reshape(-1)
        size = np.diff(self.start)
        self.long = np.full(t, -1)
        held = np.flatnonzero(size >= LONG)
        self.long[held] = np.arange(len(held))
        self.lists = [self.entries[a:b] for a, b in zip(self.start[held].tolist(), self.start[held + 1].tolist())]
        self.asked = np.zeros(t)
        del owner
        terms, place, value = (np.concatenate(x) for x in zip(*dense)) if dense else (np.empty(0, np.int32),) * 3
        dense.clear()
        columns = np.unique(terms)
        self.column = np.full(t, -1, np.int32)
        self.column[columns] = np.arange(len(columns))
        self.columns, self.block_terms, self.block_rows, self.block_long, self.top = len(columns), [], [], [], []
        order = np.argsort(place // BLOCK, kind="stable")
        bounds = by_row(place[order] // BLOCK, blocks)
        for b in range(self.blocks):
            at = order[bounds[b] : bounds[b + 1]]
            own, row = np.unique(self.column[terms[at]], return_inverse=True)
            numbers = np.zeros((len(own), min(BLOCK, n - b * BLOCK)), np.float32)
            numbers[row, place[at] - b * BLOCK] = value[at]
            self.block_terms.append(own)
            self.block_rows.append(numbers)
            self.block_long.append(float(np.sqrt((numbers**2).sum(axis=0)).max(initial=0)))
            self.top.append(numbers.max(axis=1, initial=0))
        give_back(0)

    def nearest(self, counts: dict[int, int]) -> list[tuple[int, float]]:
        """(place of an example, cosine) of the k largest cosines above 0; ties by doc_id."""
        terms = np.array(sorted(counts), np.int64)
        times = np.array([counts[x] for x in terms.tolist()], np.int64)
        return self.search(np.array([0, len(terms)]), terms, times)[0]

    def search(self, first: np.ndarray, terms: np.ndarray, times: np.ndarray) -> list[list[tuple[int, float]]]:
        """``nearest`` of many texts whose terms, in order, and counts lie one behind another, from ``first`` on."""
        if self.top is None:
            self.invert()
        n, asked = len(self.docs), len(first) - 1
        if not n:
            return [[] for _ in range(asked)]
        queries, sums = [], np.zeros((asked, n), np.float32)
        frequent = np.zeros((self.columns, asked), np.float32)
        for q, (start, end) in enumerate(zip(first[:-1].tolist(), first[1:].tolist())):
            own = terms[start:end]
            weights = (1 + np.log(times[start:end].astype(float))) * self.idf[own]
            own, weights = own[weights > 0], weights[weights > 0]
            weights /= math.sqrt(float((weights**2).sum())) or 1.0
            queries.append((own, weights))
            column = self.column[own]
            frequent[column[column >= 0], q] = weights[column >= 0]
            sums[q] = self._lists(own, weights.astype(np.float32))
        self._rows(frequent, sums)
        return [self._best(own, weights, sums[q]) for q, (own, weights) in enumerate(queries)]

    def _lists(self, terms: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """What the lists give every example."""
        start, sizes, long = self.start[terms], self.start[terms + 1] - self.start[terms], self.long[terms]
        few, many = np.flatnonzero(long < 0), np.flatnonzero(long >= 0)
        found = np.concatenate([self.entries[ranges(start[few], sizes[few])], *map(self.lists.__getitem__, long[many].tolist())])
        order = np.concatenate([few, many])
        weights = np.repeat(weights[order], sizes[order])
        weights *= found.view(np.float32)[1::2]
        return np.bincount(found.view(np.int32)[::2], weights, len(self.docs))

    def _rows(self, frequent: np.ndarray, sums: np.ndarray) -> None:
        """Add what the blocks give to the sums of the queries that they matter to."""
        n = len(self.docs)
        least = np.partition(sums, n - self.k, axis=1)[:, n - self.k] if n > self.k else np.zeros(len(sums), np.float32)
        for b, (own, numbers) in enumerate(zip(self.block_terms, self.block_rows)):
            if not len(own):
                continue
            part, asked = sums[:, b * BLOCK : b * BLOCK + BLOCK], frequent[own]
            bound = np.minimum(self.top[b] @ asked, self.block_long[b] * np.sqrt((asked**2).sum(axis=0)))
            open_ = np.flatnonzero(part.max(axis=1) + bound + ROUNDING >= least)
            if len(open_) == len(sums):
                part += asked.T @ numbers
            elif len(open_):
                part[open_] += asked[:, open_].T @ numbers

    def _best(self, terms: np.ndarray, weights: np.ndarray, sums: np.ndarray) -> list[tuple[int, float]]:
        """The k best; those that single precision can't tell from them are worked out in full too."""
        n = len(self.docs)
        least = float(np.partition(sums, n - self.k)[n - self.k]) if n > self.k else 0.0
        open_ = np.flatnonzero((sums > 0) & (sums >= least - ROUNDING))
        if not len(open_):
            return []
        spans = [slice(a, b) for a, b in zip(self.first[open_].tolist(), self.first[open_ + 1].tolist())]
        self.asked[terms] = weights * self.idf[terms]
        scores = np.array([self.asked[self.own_terms[x]] @ damped(self.own_times[x]) for x in spans]) / self.norms[open_]
        self.asked[terms] = 0
        scores = np.round(scores, 12)
        best = np.lexsort((self.docs[open_], -scores))[: self.k]
        return [(int(open_[i]), float(scores[i])) for i in best.tolist() if scores[i] > 0]


class Model:
    """Vocabulary, index and prior; its size is bounded by the texts of EXAMPLES labelled rows."""

    def __init__(self, vectors: Vectors, index: BlockMaxIndex, prior: float):
        self.vectors, self.index, self.prior = vectors, index, prior

    @property
    def terms(self) -> list[str]:
        return self.vectors.terms

    def votes(self, values: Iterable[str | None]) -> list[tuple[float, list[tuple[int, float]]]]:
        """Share of toxic votes, each weighted by 1 / (distance + 0.1) relative to a perfect match, with the prior."""
        return [self._vote(near) for near in self.index.search(*self.vectors.counts(values))]

    def _vote(self, near: list[tuple[int, float]]) -> tuple[float, list[tuple[int, float]]]:
        weight = [0.1 / (1.0 - min(1.0, c) + 0.1) for _, c in near]
        toxic = sum(w * self.index.toxic[p] for (p, _), w in zip(near, weight))
        score = (toxic + PRIOR_WEIGHT * self.prior) / (sum(weight) + PRIOR_WEIGHT)
        return float(score), [(int(self.index.docs[p]), c) for p, c in near]


def chosen_labels(labels: DataFrame, examples: int = EXAMPLES) -> DataFrame:
    """(doc_id, toxic) of at most ``examples`` labelled ids, those of the smallest hash; of several labels the largest."""
    marked = labels.filter("doc_id IS NOT NULL AND toxic IS NOT NULL")
    ids = bounded_ids(marked, "doc_id", examples)
    return marked.join(F.broadcast(ids), F.col("doc_id") == F.col("_key"), "left_semi").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))


def slices(column: pa.Array, rows: int = ASKED) -> Iterator[Iterator[str | None]]:
    """The values, so many at a time."""
    for at in range(0, len(column), rows):
        yield texts(column.slice(at, rows))


def frequencies(docs: DataFrame, vocabulary: Broadcast, n_terms: int, text: str = "text") -> tuple[np.ndarray, int]:
    """Documents that hold each term, over the whole table, and the number of rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, rows = np.zeros(n_terms, np.int64), 0
        for batch in batches:
            for values in slices(batch.column(0)):
                found += np.bincount(vocabulary.value.counts(values)[1], minlength=n_terms)
            rows += len(batch)
        held = np.flatnonzero(found)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(held, -1), pa.int32()), pa.array(np.append(found[held], rows), pa.int64())], names=["term", "n"])

    counted = docs.select(text).mapInArrow(run, "term int, n bigint").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    term, n = counted.column("term").to_numpy(), counted.column("n").to_numpy()
    out = np.zeros(n_terms, np.int64)
    out[term[term >= 0]] = n[term >= 0]
    return out, int(n[term < 0].sum())


def with_counts(df: DataFrame, vocabulary: Broadcast, text: str = "text", out: str = "counts") -> DataFrame:
    """Add ``out``: struct (n, terms, times), the counts of the terms in the whole text, packed; none for a null text."""

    @F.arrow_udf("struct<n:int,terms:array<binary>,times:array<binary>>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            found = []
            for values in slices(batch):
                first, terms, times = vocabulary.value.counts(values)
                spans = [slice(a, b) for a, b in zip(first[:-1].tolist(), first[1:].tolist())]
                found += [(s.stop - s.start, packed(np.diff(terms[s], prepend=0)), packed(times[s])) for s in spans]
            columns = [pa.array([f[k] for f in found], kind) for k, kind in enumerate((pa.int32(), pa.list_(pa.binary()), pa.list_(pa.binary())))]
            yield pa.StructArray.from_arrays(columns, names=["n", "terms", "times"])

    return df.withColumn(out, run(F.col(text)))


def term_weights(held: np.ndarray, total: int, toxic: np.ndarray, clean: np.ndarray, all_clean: int) -> np.ndarray:
    """Inverse document frequency times relevance frequency; 0 for a term of more than half of the clean examples."""
    idf = np.log(1 + (total + 1) / (held + 1))
    return np.where(2 * clean > all_clean, 0.0, idf * np.log2(2 + toxic / np.maximum(1, clean)))


def learn(docs: DataFrame, labels: DataFrame, examples: int = EXAMPLES) -> Model:
    """Fit on labelled ``docs`` (doc_id, text), ``labels`` (doc_id, toxic); rows without id, text or label teach nothing.

    Every term of every example counts; copies of a text count once for its weight. What reaches the driver are the terms
    of the examples, with their frequencies over all of ``docs``, and the examples' term counts: as many as the examples'
    texts hold, whatever the size of the tables.
    """
    chosen = cut_lineage(chosen_labels(labels, examples))
    sample = cut_lineage(docs.filter("text IS NOT NULL").join(F.broadcast(chosen), "doc_id").select("doc_id", "toxic", "text"))
    words = sample.select("text").mapInArrow(words_of, "word string").distinct().toArrow().column("word").to_pylist()
    names = sorted({t for word in words for t in terms_of(word)})
    del words
    n_terms, vocabulary = len(names), docs.sparkSession.sparkContext.broadcast(Vectors(names))
    held, total = frequencies(docs, vocabulary, n_terms)
    # from here on frequent terms come first: what a search looks up lies close together
    order = np.argsort(-held, kind="stable")
    held, rank = held[order], np.empty(n_terms, np.int64)
    rank[order] = np.arange(n_terms)
    rows = with_counts(sample, vocabulary).select("doc_id", "toxic", F.xxhash64("text").alias("hash"), "counts.*").toArrow().sort_by("doc_id")
    vocabulary.destroy()
    marked, hashes = rows.column("toxic").to_numpy() > 0, rows.column("hash").to_numpy()
    first = np.concatenate([[0], np.cumsum(rows.column("n").to_numpy(), dtype=np.int64)])
    terms, times = np.empty(first[-1], np.int32), np.empty(first[-1], np.int32)
    by_label, clean, seen = np.zeros((2, n_terms), np.int64), 0, set()
    for i, (start, end) in enumerate(zip(first[:-1].tolist(), first[1:].tolist())):
        own = rank[np.cumsum(unpacked(rows.column("terms")[i].as_py()))]
        order_in = np.argsort(own)
        terms[start:end], times[start:end] = own[order_in], unpacked(rows.column("times")[i].as_py())[order_in]
        key = (int(hashes[i]), bool(marked[i]))
        if key not in seen:
            seen.add(key)
            by_label[int(marked[i]), terms[start:end]] += 1
            clean += not marked[i]
    docs_of = rows.column("doc_id").to_numpy().astype(np.int64)
    del rows
    weights = term_weights(held, total, by_label[1], by_label[0], clean)
    index = BlockMaxIndex.of(docs_of, marked.astype(np.float64), first, terms, times, weights)
    return Model(Vectors([names[i] for i in order.tolist()]), index, float(marked.sum() + 0.1) / (len(marked) + 1.0))


def score(df: DataFrame, model: Model, text: str = "text", out: str = "toxicity") -> DataFrame:
    """Add ``out``: struct (score 0 to 1, neighbours array of (doc_id, cosine)), from the whole text alone.

    Null and empty texts, and texts without any term that weighs, get the prior and no neighbours. Equal texts get equal
    scores; other columns pass as they are. Rows never meet.
    """
    shared = df.sparkSession.sparkContext.broadcast(model)
    kind = pa.list_(pa.struct([("doc_id", pa.int64()), ("cosine", pa.float64())]))

    @F.arrow_udf("struct<score:double,neighbours:array<struct<doc_id:bigint,cosine:double>>>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        give_back()  # of the stages before
        for batch in batches:
            found = [vote for values in slices(batch) for vote in shared.value.votes(values)]
            yield pa.StructArray.from_arrays([
                pa.array([f[0] for f in found], pa.float64()),
                pa.array([[{"doc_id": d, "cosine": c} for d, c in f[1]] for f in found], kind),
            ], names=["score", "neighbours"])

    return df.withColumn(out, run(F.col(text)))


@query("op2_toxicity")
def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic").filter(fold("doc_id", 5) != 0)
    found = score(docs, learn(docs, labels))
    return found.select(
        "doc_id", F.coalesce(fold("doc_id", 5) == 0, F.lit(False)).alias("held_out"), "toxicity.score",
        F.when(F.col("toxicity.score") >= 0.5, 1).otherwise(0).alias("predicted"),
        F.array_join(F.transform("toxicity.neighbours", lambda n: n["doc_id"].cast("string")), ",").alias("evidence"),
    )
