"""The index of toxicity's examples: small where it is asked, many texts at once, as exact as brute force."""

import pickle
from collections import Counter

import numpy as np

from gleaner.llm import words
from gleaner.llm.toxicity import BlockMaxIndex, Vectors, terms_of


def examples(n, terms, seed=5):
    """Examples of Zipf-like terms: some in most examples, most in few."""
    rng = np.random.default_rng(seed)
    return [(d, int(d % 9 == 0), dict(Counter((terms * rng.random(150 + d % 50) ** 4).astype(int).tolist()))) for d in range(n)]


def held_bytes(index):
    """Of its arrays; ``lists`` are parts of ``entries``."""
    flat = [x for k, v in vars(index).items() if k != "lists" for x in (v if isinstance(v, list) else [v])]
    return sum(x.nbytes for x in flat if isinstance(x, np.ndarray))


def test_an_index_takes_few_bytes_an_entry():
    idf = np.linspace(1, 9, 3000)
    index = pickle.loads(pickle.dumps(BlockMaxIndex(examples(3000, 3000), idf)))
    index.nearest({5: 1})
    assert held_bytes(index) < 20 * len(index.own_terms)  # 31.6 before


def test_texts_asked_together_find_the_same_as_brute_force():
    rows = examples(1200, 900) + [(5000 + i, 1, {3: 1, 800: 2}) for i in range(40)] + [(9000, 0, {}), (9001, 0, {0: 4})]
    idf = np.where(np.arange(900) == 0, 0.0, np.linspace(1, 7, 900))
    index = BlockMaxIndex(rows, idf)
    index.invert()
    assert index.columns and len(index.entries)  # rows and lists are both in use

    def vector(counts):
        v = np.zeros(900)
        for t, n in counts.items():
            v[t] = (1 + np.log(n)) * idf[t]
        return v / (np.linalg.norm(v) or 1)

    asked = [rows[7][2], {800: 1, 3: 5}, {}, {0: 9}, *(r[2] for r in examples(90, 900, 8))]
    matrix = np.stack([vector(r[2]) for r in rows])
    terms = [np.array(sorted(a), np.int64) for a in asked]
    first = np.cumsum([0, *(len(t) for t in terms)])
    times = np.array([a[t] for a, own in zip(asked, terms) for t in own.tolist()], np.int64)
    found = index.search(first, np.concatenate(terms), times)
    for a, got in zip(asked, found):
        scores = np.round(matrix @ vector(a), 11)
        want = sorted((-s, r[0]) for s, r in zip(scores.tolist(), rows) if s > 0)[: index.k]
        assert [int(index.docs[p]) for p, _ in got] == [d for _, d in want]
        assert np.allclose([s for _, s in got], [-s for s, _ in want], atol=1e-10, rtol=0)
        assert got == index.nearest(a)


def test_terms_are_counted_as_one_by_one(monkeypatch):
    stretches = words.lower_words.__defaults__
    texts = ["The wonderful wonder, the end", None, "", "Ünïted ünited x7x " * 40, "Žluťoučký kůň “wonderful” " * 30]
    monkeypatch.setattr(words.lower_words, "__defaults__", (40,))  # several stretches a text
    vectors = pickle.loads(pickle.dumps(Vectors([t for w in ("the", "wonderful", "ünited", "žluťoučký", "kůň") for t in terms_of(w)])))
    names = vectors.terms
    assert [vectors.place(t) for t in names] == list(range(len(names))) and vectors.place("th") == vectors.place("") == -1
    none = pickle.loads(pickle.dumps(Vectors([])))
    assert none.terms == [] and none.place("a") == -1 and len(none.counts(texts)[1]) == 0
    monkeypatch.setattr("gleaner.llm.toxicity.REMEMBERED", 4)
    for _ in range(2):
        first, terms, times = vectors.counts(texts)
        for i, text in enumerate(texts):
            own = slice(first[i], first[i + 1])
            want = Counter(t for ws in words.words_in(text, *stretches) for w in ws for t in terms_of(w) if t in names)
            assert {names[t]: n for t, n in zip(terms[own].tolist(), times[own].tolist())} == want
            assert terms[own].tolist() == sorted(set(terms[own].tolist()))
    assert len(vectors.known) <= 4
