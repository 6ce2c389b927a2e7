"""Ranked lexical search by two trees.

Every document is a vector of term saturations, every item a vector of term weights; a score is their product. Items lie in
one tree, the documents of a task in others of a few thousand rows each; a node holds the largest value of every coordinate
below it. The product of an item node and a document node bounds every score between the two: where it is under the weakest
k-th score of the node's items, all pairs below are passed over at once. What is left is scored exactly, in whole numbers.

Documents never meet: each task keeps the k best of its own rows an item, and only those are shuffled.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gleaner.llm.common import table, texts
from gleaner.llm.registry import query
from gleaner.llm.words import STRETCH
from gleaner.session import cut_lineage

#: Letters and digits of ASCII, A-Z as a-z, and every byte of another character; the rest parts terms.
BYTES = bytes(b if b >= 128 or chr(b).isalnum() else 32 for b in range(256)).lower()
#: Term entries of the items that are searched at a time: a task and the driver hold no more of them.
ENTRIES = 200_000
#: Rows and term entries of one document tree, rows of a leaf, and children of a node.
TREE_ROWS, TREE_ENTRIES, LEAF, FAN = 4096, 500_000, 32, 8
ITEM_LEAF, ITEM_FAN = 4, 4
#: Products of nodes are sums of doubles: a bound counts as this much higher.
SLACK = 1 + 1e-12
TOP = 10


def terms_in(text: str | None, stretch: int = STRETCH) -> Iterator[list[bytes]]:
    """Lists of the terms of a whole text, cut between terms only; none for a null text."""
    data = text.encode().translate(BYTES) if text else b""
    at = 0
    while len(data) - at > stretch and (end := data.find(b" ", at + stretch)) >= 0:
        yield data[at:end].split()
        at = end
    yield data[at:].split()


def weight(rows: int, held: int) -> int:
    return math.floor(1000 * math.log((2 * rows + 2) / (2 * held + 1)))


def item_terms(items: DataFrame, item_id: str = "item_id", text: str = "text") -> DataFrame:
    """(item_id, term) once each; rows that share an id are one item, as are those without an id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for item, value in zip(batch.column(0).to_pylist(), texts(batch.column(1))):
                own = {t.decode() for found in terms_in(value) for t in found}
                yield pa.RecordBatch.from_arrays([pa.array([item] * len(own), pa.int64()), pa.array(list(own), pa.string())], names=["item_id", "term"])

    asked = items.select(F.col(item_id).cast("bigint").alias("item_id"), F.col(text).alias("text"))
    return asked.mapInArrow(run, "item_id bigint, term string").distinct()


def vectors(docs: DataFrame, vocabulary: list[str], doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n, terms, times) of every document with a term: how often it holds which places of the vocabulary."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)
    kind = pa.list_(pa.int32())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = {t.encode(): i for i, t in enumerate(shared.value)}
        for batch in batches:
            ids, sizes, terms, times = [], [], [], []
            for doc, value in zip(batch.column(0).to_pylist(), texts(batch.column(1))):
                n, seen = 0, Counter()
                for found in terms_in(value):
                    n += len(found)
                    seen.update(found)
                if n:
                    known = [(place[t], c) for t, c in seen.items() if t in place]
                    ids.append(doc)
                    sizes.append(n)
                    terms.append([k for k, _ in known])
                    times.append([c for _, c in known])
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()), pa.array(terms, kind), pa.array(times, kind)], names=["doc_id", "n", "terms", "times"])

    asked = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    return asked.mapInArrow(run, "doc_id bigint, n bigint, terms array<int>, times array<int>")


def held_by(found: DataFrame, size: int) -> np.ndarray:
    """Documents that hold each place of the vocabulary: one row a task and term is added up by Spark."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(size, np.int64)
        for batch in batches:
            held += np.bincount(batch.column(0).flatten().to_numpy(), minlength=size)
        seen = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int32()), pa.array(held[seen])], names=["term", "held"])

    counted = found.select("terms").mapInArrow(run, "term int, held bigint").groupBy("term").agg(F.sum("held").alias("held")).toArrow()
    out = np.zeros(size, np.int64)
    out[counted.column("term").to_numpy()] = counted.column("held").to_numpy()
    return out


class Node:
    """Items ``first`` to ``end``, the largest weight of each of their terms, and the nodes below."""

    def __init__(self, first: int, end: int, below: list[Node], terms: np.ndarray):
        self.first, self.end, self.below, self.terms = first, end, below, terms


class Items:
    """Items by id with their term places, and the tree over them; like items lie side by side."""

    def __init__(self, rows: dict[int | None, list[int]], weights: np.ndarray):
        self.weights = weights.astype(np.float64)
        heaviest = lambda terms: sorted(terms, key=lambda t: (weights[t], t))[:3]  # noqa: E731 - common words tell languages apart
        order = sorted(rows, key=lambda i: (heaviest(rows[i]), i is None, i or 0))
        self.ids = order
        self.terms = [np.array(sorted(rows[i]), np.int64) for i in order]
        level = [
            Node(at, min(at + ITEM_LEAF, len(order)), [], np.unique(np.concatenate(self.terms[at : at + ITEM_LEAF])))
            for at in range(0, len(order), ITEM_LEAF)
        ]
        while len(level) > 1:
            groups = [level[at : at + ITEM_FAN] for at in range(0, len(level), ITEM_FAN)]
            level = [Node(g[0].first, g[-1].end, g, np.unique(np.concatenate([n.terms for n in g]))) for g in groups]
        self.root = level[0]


class DocumentTree:
    """Documents as rows of (place, saturation) entries; ``levels[0]`` are the leaves' largest values, the last one row."""

    def __init__(self, start: np.ndarray, terms: np.ndarray, values: np.ndarray):
        n = len(start) - 1
        # documents whose heaviest term is the same share a leaf, the longer ones (low values) apart from the shorter ones
        sizes = np.diff(start)
        top = np.zeros(n, np.int64)
        rows = np.repeat(np.arange(n), sizes)
        by_value = np.lexsort((terms, values, rows))
        full = sizes > 0
        top[full] = by_value[start[1:][full] - 1]
        order = np.lexsort((np.where(full, values[top] if len(values) else 0, 0), np.where(full, terms[top] if len(terms) else 0, -1)))
        rank = np.empty(n, np.int64)
        rank[order] = np.arange(n)
        move = np.argsort(rank[rows], kind="stable")
        self.order = order
        self.places, self.column = np.unique(terms[move], return_inverse=True)
        self.value = values[move].astype(np.float32)
        self.start = np.concatenate([[0], np.cumsum(sizes[order])])
        leaves = np.zeros((-(-n // LEAF), len(self.places)), np.float32)
        np.maximum.at(leaves, (rank[rows][move] // LEAF, self.column), self.value)
        self.levels = [leaves]
        while len(self.levels[-1]) > 1:
            below = self.levels[-1]
            self.levels.append(np.maximum.reduceat(below, np.arange(0, len(below), FAN), axis=0))

    def leaf(self, k: int) -> np.ndarray:
        """The rows of a leaf, every coordinate."""
        first, end = k * LEAF, min((k + 1) * LEAF, len(self.order))
        a, b = self.start[first], self.start[end]
        out = np.zeros((end - first, len(self.places)), np.float32)
        out[np.repeat(np.arange(end - first), np.diff(self.start[first : end + 1])), self.column[a:b]] = self.value[a:b]
        return out


class Search:
    """The k best documents of each item so far; trees of documents are searched one after another."""

    def __init__(self, items: Items, k: int = TOP):
        self.items, self.k = items, k
        self.scores = np.zeros((len(items.ids), k), np.int64)
        self.docs = np.zeros((len(items.ids), k), np.int64)
        self.missing = np.ones((len(items.ids), k), bool)
        self.scored = 0

    def weakest(self, node: Node) -> int:
        return int(self.scores[node.first : node.end, -1].min())

    def add(self, tree: DocumentTree, docs: np.ndarray, missing: np.ndarray) -> None:
        """Search a tree whose rows are ``docs``; ``missing`` marks rows without an id, which come last among equals."""
        column = np.full(len(self.items.weights), -1, np.int64)
        column[tree.places] = np.arange(len(tree.places))
        here: dict[int, tuple[np.ndarray, np.ndarray]] = {}

        def coordinates(node: Node) -> tuple[np.ndarray, np.ndarray]:
            if id(node) not in here:
                own = node.terms[column[node.terms] >= 0]
                here[id(node)] = column[own], self.items.weights[own]
            return here[id(node)]

        leaves: dict[int, list[tuple[float, Node]]] = {}
        work = [(self.items.root, len(tree.levels) - 1, np.arange(len(tree.levels[-1])))]
        while work:
            node, level, rows = work.pop()
            columns, weights = coordinates(node)
            bound = tree.levels[level][np.ix_(rows, columns)].astype(np.float64) @ weights * SLACK
            open_ = (bound > 0) & (bound >= self.weakest(node))
            rows, bound = rows[open_], bound[open_]
            if not len(rows):
                continue
            if node.below:
                work += [(child, level, rows) for child in node.below]
            elif level:
                below = (rows[:, None] * FAN + np.arange(FAN)).ravel()
                work.append((node, level - 1, below[below < len(tree.levels[level - 1])]))
            else:
                for k, b in zip(rows.tolist(), bound.tolist()):
                    leaves.setdefault(k, []).append((b, node))
        for k, nodes in sorted(leaves.items(), key=lambda pair: (-max(b for b, _ in pair[1]), pair[0])):
            matrix = None
            for b, node in nodes:
                if b < self.weakest(node):
                    continue
                matrix = tree.leaf(k) if matrix is None else matrix
                own = tree.order[k * LEAF : (k + 1) * LEAF]
                self._score(node, matrix, column, docs[own], missing[own])

    def _score(self, node: Node, matrix: np.ndarray, column: np.ndarray, docs: np.ndarray, missing: np.ndarray) -> None:
        for i in range(node.first, node.end):
            self.scored += len(docs)
            terms = self.items.terms[i]
            terms = terms[column[terms] >= 0]
            # whole numbers under 2 ** 53 are exact as doubles, in any order of adding
            kind = np.float64 if self.items.weights[terms].sum() < 9e9 else np.int64
            found = (matrix[:, column[terms]].astype(kind) @ self.items.weights[terms].astype(kind)).astype(np.int64)
            better = np.flatnonzero((found > 0) & (found >= self.scores[i, -1]))
            if len(better):
                scores = np.concatenate([self.scores[i], found[better]])
                ids, none = np.concatenate([self.docs[i], docs[better]]), np.concatenate([self.missing[i], missing[better]])
                best = np.lexsort((ids, none, -scores))[: self.k]
                self.scores[i], self.docs[i], self.missing[i] = scores[best], ids[best], none[best]

    def rows(self) -> Iterator[tuple[int | None, int | None, int]]:
        for i, item in enumerate(self.items.ids):
            for score, doc, none in zip(self.scores[i].tolist(), self.docs[i].tolist(), self.missing[i].tolist()):
                if score > 0:
                    yield item, None if none else doc, score


def trees(batch: pa.RecordBatch, rows: int, terms: int) -> Iterator[tuple[DocumentTree, np.ndarray, np.ndarray]]:
    """Trees over the rows of a batch of vectors, bounded in rows and entries."""
    n = batch.num_rows
    docs, missing = batch.column(0).fill_null(0).to_numpy(), batch.column(0).is_null().to_numpy(zero_copy_only=False)
    sizes, lists, times = batch.column(1).to_pylist(), batch.column(2), batch.column(3)
    start = np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy())])
    place, seen = lists.flatten().to_numpy(), times.flatten().to_numpy().astype(np.int64)
    at = 0
    while at < n:
        end = max(at + 1, min(n, at + TREE_ROWS, int(np.searchsorted(start, start[at] + TREE_ENTRIES, "right")) - 1))
        own = start[at : end + 1]
        # the length norm is worked out in Python numbers, which have no largest
        norm = np.array([100 - 90 + 90 * size * rows // terms for size in sizes[at:end]], np.int64)
        tf = seen[own[0] : own[-1]]
        values = 1_000_000_000 * tf // (1000 * tf + 8 * np.repeat(norm, np.diff(own)))
        yield DocumentTree(own - own[0], place[own[0] : own[-1]].astype(np.int64), values), docs[at:end], missing[at:end]
        at = end


def best_documents(docs: DataFrame, items: DataFrame, k: int = TOP, entries: int = ENTRIES) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``k`` best rows of ``docs`` (doc_id, text) for each item (item_id, text).

    Only scores above 0 count; equal ones rank by ascending doc_id, rows without an id last. Each row of ``docs`` is a
    document of its own, also where ids repeat; items that share an id are one item. Null and empty texts hold no term: such
    documents are not counted, such items get no row. Items come in blocks of about ``entries`` terms, each searched in all
    documents; further columns are ignored.
    """
    spark = docs.sparkSession
    named = cut_lineage(item_terms(items))
    blocks = max(1, -(-named.count() // entries))
    found = None
    for block in range(blocks):
        own = named.filter(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == block).toArrow()
        vocabulary = sorted(set(own.column("term").to_pylist()))
        if vocabulary:
            best = _searched(spark, docs, own, vocabulary, k)
            found = best if found is None else found.unionByName(best)
    if found is None:
        return spark.createDataFrame([], "item_id bigint, rank int, doc_id bigint, score bigint")
    order = Window.partitionBy("item_id").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    ranked = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("item_id", "rank", "doc_id", "score")


def _searched(spark: SparkSession, docs: DataFrame, own: pa.Table, vocabulary: list[str], k: int) -> DataFrame:
    """The k best of every task for one block of items."""
    place = {t: i for i, t in enumerate(vocabulary)}
    asked: dict[int | None, list[int]] = {}
    for item, term in zip(own.column("item_id").to_pylist(), own.column("term").to_pylist()):
        asked.setdefault(item, []).append(place[term])
    filed = cut_lineage(vectors(docs, vocabulary))
    rows, terms = filed.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    held = held_by(filed, len(vocabulary))
    weights = np.array([weight(rows, h) for h in held.tolist()], np.int64)
    shared = spark.sparkContext.broadcast(Items(asked, weights))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = Search(shared.value, k)
        for batch in batches:
            for tree, ids, missing in trees(batch, rows, terms):
                search.add(tree, ids, missing)
        out = list(search.rows())
        kinds = ("item_id", pa.int64()), ("doc_id", pa.int64()), ("score", pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in out], kind) for c, (_, kind) in enumerate(kinds)], names=[name for name, _ in kinds])

    return filed.mapInArrow(run, "item_id bigint, doc_id bigint, score bigint")


OP11_SQL = r"""
WITH doc_terms AS (
  SELECT doc_id, row_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+')) AS term
  FROM (SELECT doc_id, text, row_number() OVER () AS row_id FROM documents)
), sizes AS (SELECT row_id, count(*) AS n FROM doc_terms GROUP BY row_id),
totals AS (SELECT count(*)::BIGINT AS rows_, sum(n)::BIGINT AS terms FROM sizes),
asked AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+')) AS term
  FROM benchmark
), seen AS (
  SELECT doc_id, row_id, term, count(*)::BIGINT AS tf FROM doc_terms WHERE term IN (SELECT term FROM asked) GROUP BY ALL
), weights AS (
  SELECT term, floor(1000 * ln((2 * rows_ + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM seen, totals GROUP BY term, rows_
), parts AS (
  SELECT doc_id, row_id, term, w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + (90 * n * rows_) // terms))) AS part
  FROM seen JOIN sizes USING (row_id) JOIN weights USING (term), totals
), scored AS (
  SELECT item_id, doc_id, row_id, sum(part)::BIGINT AS score FROM asked JOIN parts USING (term) GROUP BY ALL HAVING sum(part) > 0
), ranked AS (
  SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score FROM scored
) SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 10
"""


@query("op11_ranked_search", OP11_SQL)
def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 best documents for every benchmark item."""
    return best_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
