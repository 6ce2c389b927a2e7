"""Ranked search against a plain sum over all pairs."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

import __spark_entry__ as entry
from gleaner.llm import ranking

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return TERM.findall((text or "").translate(LOWER))


def brute(docs, items, k=10):
    counts = [(i, Counter(terms(t))) for i, t in docs]
    counts = [(i, c) for i, c in counts if c]
    n_docs, length = len(counts), sum(sum(c.values()) for _, c in counts)
    held = Counter(t for _, c in counts for t in c)
    asked = {}
    for i, t in items:
        asked.setdefault(i, set()).update(terms(t))
    out = []
    for item, own in asked.items():
        scored = []
        for doc, c in counts:
            m = 100 - 90 + (90 * sum(c.values()) * n_docs) // length
            score = sum(
                math.floor(1000 * math.log((2 * n_docs + 2) / (2 * held[t] + 1))) * ((1000000000 * c[t]) // (1000 * c[t] + 8 * m))
                for t in own if c[t]
            )
            if score > 0:
                scored.append((-score, doc is None, doc or 0))
        out += [(item, rank + 1, None if none else doc, -s) for rank, (s, none, doc) in enumerate(sorted(scored)[:k])]
    return sorted(out, key=repr)


def made(spark, docs, items, parts=3):
    d = spark.createDataFrame([(i, t, "x", 7) for i, t in docs], "doc_id bigint, text string, term string, score int").repartition(parts)
    q = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id bigint, text string, rank int")
    return d, q


def corpus(seed, n):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(60)] + ["Ünïcode", "ABC", "x1", "дім"]
    docs = [(i, rng.choice([" ", ", ", "-", "\n"]).join(rng.choice(words) for _ in range(rng.choice([1, 3, 20, 80])))) for i in range(n)]
    docs += [(n, None), (n + 1, ""), (n + 2, " !? "), (None, docs[0][1]), (None, docs[1][1]), (0, docs[0][1]), (n + 3, docs[5][1]), (n + 4, "w1 " * 3000)]
    items = [(i, " ".join(rng.choice(words) for _ in range(rng.choice([1, 4, 12])))) for i in range(30)]
    return docs, items + [(30, None), (31, "..."), (32, "nowhere"), (None, "w1 w2"), (3, "ABC abc")]


@pytest.mark.parametrize(("entries", "rows", "leaf"), [(ranking.ENTRIES, 4096, 32), (40, 4096, 4), (ranking.ENTRIES, 13, 2)])
def test_ranking_matches_brute_force(spark, entries, rows, leaf, monkeypatch):
    monkeypatch.setattr(ranking, "TREE_ROWS", rows)
    monkeypatch.setattr(ranking, "LEAF", leaf)
    docs, items = corpus(3, 150)
    d, q = made(spark, docs, items)
    got = ranking.best_documents(d, q, entries=entries)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted(map(tuple, got.collect()), key=repr) == brute(docs, items)


def test_ranking_of_nothing(spark):
    docs, items = corpus(1, 8)
    for a, b in (([], items), (docs, []), ([(1, None)], items), (docs, [(1, "")])):
        assert ranking.best_documents(*made(spark, a, b)).collect() == []


@pytest.mark.parametrize("shape", ["topics", "one"])
def test_trees_prune_and_stay_exact(shape):
    """Node bounds pass over whole batches where documents differ by topic; the result is that of all pairs."""
    rng = np.random.default_rng(5)
    n, size, topics = 3000, 400, 20 if shape == "topics" else 1
    weights = rng.integers(1, 9000, size)
    rows = []
    for i in range(n):
        low = (i % topics) * (size // topics)
        own = np.unique(rng.integers(low, low + size // topics, 12))
        rows.append((own, rng.integers(1, 10**6, len(own))))
    asked = {i: sorted({int(t) for t in rng.integers((i % topics) * (size // topics), (i % topics + 1) * (size // topics), 6)}) for i in range(60)}
    search = ranking.Search(ranking.Items(asked, weights), 10)
    for at in range(0, n, 1000):
        part = rows[at : at + 1000]
        start = np.concatenate([[0], np.cumsum([len(t) for t, _ in part])])
        tree = ranking.DocumentTree(start, np.concatenate([t for t, _ in part]), np.concatenate([v for _, v in part]))
        search.add(tree, np.arange(at, at + len(part)), np.zeros(len(part), bool))
    want = []
    for item, own in asked.items():
        scores = [(-sum(int(weights[t]) * int(v) for t, v in zip(*row) if t in own), i) for i, row in enumerate(rows)]
        want += [(item, i, -s) for s, i in sorted(scores)[:10] if s < 0]
    assert sorted(search.rows()) == sorted(want)
    if shape == "topics":
        assert search.scored < 0.5 * n * len(asked)


def test_terms_of_long_texts_are_cut_between_terms():
    text = "Ab-cd " * 500 + "é" * 300 + " x\x85y"
    assert [t.decode() for found in ranking.terms_in(text, 10) for t in found] == terms(text)
    assert list(ranking.terms_in(None)) == [[]] == list(ranking.terms_in(""))


def test_op11(spark, sf_dir):
    read = lambda name: [tuple(r) for r in spark.read.parquet(f"{sf_dir}/{name}.parquet").select({"documents": "doc_id", "benchmark": "item_id"}[name], "text").collect()]
    got = entry.queries()["op11_ranked_search"](spark, sf_dir)
    assert sorted(map(tuple, got.collect()), key=repr) == brute(read("documents"), read("benchmark"))
