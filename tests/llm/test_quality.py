"""The quality classifier: held-out labels, the definition of its scores, and odd rows."""

import math
import random
import re
import zlib

import numpy as np
import pytest

import __spark_entry__ as entry
from gleaner.llm import quality

SCHEMA = "doc_id bigint, text string, label int, score double, _key bigint"


def made(spark, rows, parts=3):
    return spark.createDataFrame([(i, t, None, 0.5, 1) for i, t in rows], SCHEMA).repartition(parts)


def labelled(spark, rows):
    return spark.createDataFrame(rows, "doc_id bigint, quality int, toxic int")


def examples(n, seed=1):
    rng = random.Random(seed)
    words = [f"{a}{b}" for a in ("stone", "river", "glass", "winter") for b in ("s", "ed", "ing", "")]
    good = [" ".join(rng.choice(words) for _ in range(rng.randint(5, 60))) for _ in range(n)]
    bad = [" ".join(rng.choice(words).upper() + "!!" for _ in range(rng.randint(5, 60))) for _ in range(n)]
    again = [" ".join(w for _ in range(6) for w in [rng.choice(words)] * 7) for _ in range(n)]
    return good, bad, again


def test_unseen_words_are_judged_by_their_parts(spark):
    good, bad, again = examples(60)
    rows = list(enumerate(good + bad + again))
    model = quality.learn(made(spark, rows), labelled(spark, [(i, int(i < 60), 0) for i, _ in rows]))
    asked = [(0, "stoneings rivereds and glassing"), (1, "STONEINGS!! WINTEREDS!! OF!!"), (2, "wood " * 30), (3, good[0]), (4, good[0]), (5, None), (6, ""), (7, " \n"), (None, bad[0]), (3, bad[1])]
    out = quality.score(made(spark, asked), model, out="chance")
    assert out.columns == ["doc_id", "text", "label", "score", "_key", "chance"]
    got = {(r.doc_id, r.text): r.chance for r in out.collect()}
    assert len(got) == len(asked) and all(0 <= c <= 1 for c in got.values())
    assert got[0, asked[0][1]] > 0.5 > max(got[1, asked[1][1]], got[2, asked[2][1]], got[None, bad[0]])
    assert got[3, good[0]] == got[4, good[0]] and got[5, None] == got[6, ""] == got[7, " \n"] == 1 / (1 + math.exp(-model.bias))
    text = "stones " * 4 + "RIVER!! x"
    buckets, counts = quality.counts_of(text)
    odds = model.bias + float(model.adds[buckets] @ counts) / counts.sum()
    assert quality.score(made(spark, [(1, text)]), model, out="c").first().c == pytest.approx(1 / (1 + math.exp(-odds)))


def test_the_same_rows_give_the_same_model(spark):
    good, bad, _ = examples(20)
    rows = list(enumerate(good + bad))
    labels = [(i, int(i < 20), 0) for i, _ in rows]
    one = quality.learn(made(spark, rows, 2), labelled(spark, labels))
    two = quality.learn(made(spark, rows[::-1], 5), labelled(spark, labels[::-1] + [(None, 1, 0), (1, None, 0), (99, 1, 0)]))
    assert np.array_equal(one.adds, two.adds) and one.bias == two.bias


@pytest.mark.parametrize("labels", [[], [(0, 1, 0)], [(0, 0, 0), (1, 0, 0)]])
def test_little_to_learn_from(spark, labels):
    model = quality.learn(made(spark, [(0, "a b"), (1, None), (2, "")]), labelled(spark, labels))
    share = (sum(y for _, y, _ in labels[:1]) + 0.5) / (len(labels[:1]) + 1)
    chances = [r.c for r in quality.score(made(spark, [(0, "a b"), (1, None)]), model, out="c").collect()]
    assert chances == pytest.approx([share, share])
    assert quality.score(made(spark, []), model).count() == 0


def plain_buckets(text):
    """The features one by one: words, n-grams with blank ends, repeats."""
    mask, words = (1 << 64) - 1, re.findall(r"[^\x20\x09-\x0D]+", text)

    def bucket(h):
        return (((h ^ (h >> 32)) * int(quality.MIX)) & mask) >> (64 - quality.BITS)

    out = []
    for before, word in zip([None, *words], words):
        marked, h, power = f" {word}", 0, 1
        for c in marked:
            power = power * int(quality.WORD) & mask
            h = (h + ord(c) * power) & mask
        out += [bucket(h), *([quality.REPEAT] if before == word else [])]
        for n in quality.GRAMS:
            grams = [f" {word} "[i : i + n] for i in range(len(word) + 3 - n)]
            out += [bucket((sum(ord(c) * int(p) for c, p in zip(g, quality.PLACES)) + n) & mask) for g in grams]
    return sorted(out)


@pytest.mark.parametrize("text", ["a", " a a b  b\nb c a ", "été Ünï\x0b\x1c🙂🙂 ok", "x" * 3000 + " x", "one two two three " * 50, "", " \t\n", "\n\nab"])
def test_features_are_words_parts_and_repeats(text):
    for stretch in (1, 7, quality.STRETCH):
        found = [int(b) for part in quality.buckets_in(text, stretch) for b in part]
        assert sorted(found) == plain_buckets(text)


def test_op13_on_the_held_out_fold(spark, sf_dir):
    """On the table of 1,000 documents: the smallest has three texts of label 0 in the fold, of kinds it has no example of."""
    sf_dir = sf_dir.replace("sf0.001", "sf0.01")
    out = {r.doc_id: r for r in entry.queries()["op13_quality_classifier"](spark, sf_dir).collect()}
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    assert len(out) == docs.count()
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for i, r in out.items())
    held = [(out[r.doc_id].predicted, r.quality) for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect() if out[r.doc_id].held_out]
    assert np.mean([p == y for p, y in held]) >= 0.9
    assert np.mean([p for p, y in held if y == 1]) >= 0.95
