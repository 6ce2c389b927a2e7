"""Letter runs as bytes: the same words as the pattern finds, most of them without it."""

import pickle
import random

import numpy as np

from gleaner.llm import words
from gleaner.llm.toxicity import BlockMaxIndex


def test_words_as_bytes_are_those_of_the_pattern():
    rng = random.Random(1)
    for chars in (128, 256, 0x180, 0x600):
        for _ in range(200):
            text = "".join(chr(rng.randrange(chars)) for _ in range(40)) + rng.choice(["", "“a Š’b…ƒ–Œ€", "Ÿ¼²µªß"])
            assert [w for ws in words.words_in(text) for w in ws] == words.LETTERS.findall(text.lower())
    every = " ".join(map(chr, range(0x2100)))
    assert [w for ws in words.words_in(every) for w in ws] == words.LETTERS.findall(every.lower())
    assert words.letter_words("Ça vaut “dix” €") == ["ça".encode("cp1252"), b"vaut", b"dix"]
    assert words.letter_words("a\x8ab") == [b"a", b"b"]


def test_a_model_travels_as_counts():
    rng = np.random.default_rng(2)
    rows = [(d, d % 3 == 0, {int(t): int(rng.integers(1, 9)) for t in rng.choice(4000, 300, replace=False)}) for d in range(200)]
    idf = np.where(np.arange(4000) % 7 == 0, 0.0, 1 + np.arange(4000) / 999)
    index = BlockMaxIndex(rows, idf)
    sent = pickle.dumps(index)
    back = pickle.loads(sent)
    assert np.array_equal(back.own_values, index.own_values) and np.array_equal(back.own_terms, index.own_terms)
    assert back.nearest(rows[5][2]) == index.nearest(rows[5][2]) and back.nearest(rows[5][2])[0][0] in range(200)
    assert len(sent) < 4 * len(index.own_terms) + 8 * len(idf) + 10_000  # 12 bytes an entry as arrays
    empty = pickle.loads(pickle.dumps(BlockMaxIndex([], idf)))
    assert empty.nearest({1: 1}) == []
