"""Long and hostile inputs: nothing is capped, and time grows with the length."""

import time

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from gleaner.llm import common, extraction, language, secrets, toxicity

CLASHES = "language string, rows int, place string, repeats string, kept_id int, _key int, _hash int"


def seconds(run, value):
    start = time.perf_counter()
    run(value)
    return time.perf_counter() - start


@pytest.mark.parametrize("n", [10, 63, 64, 2000])
def test_constants_propagate_along_any_chain(n):
    text = "\n".join(['K = "Zx9yW8vU7tS6q"', *[f'acc = acc + "piece{i}of7"' for i in range(n)], "api_key = acc + K"])
    found = [text[s:e] for kind, s, e, _, _ in secrets.findings(text) if kind == "pair"]
    assert len(found) == n + 1 and "Zx9yW8vU7tS6q" in found


def test_names_of_different_weight_meet_the_same_literal():
    text = 'x = "abcdefgh12345"\nuser_auth_id = x\nauth = x\npassword_hint = x\npassword: x\n'
    assert [(f[3], text[f[1] : f[2]]) for f in secrets.findings(text) if f[0] == "pair"] == [("password", "abcdefgh12345")]


@pytest.mark.parametrize("piece", ["a=", "key=Ab1", "a=b + ", "token=", 'a="', "pwd: 'x` ", "token = token + \"ab12cd34ef56\"\n"])
def test_secret_scan_is_linear(piece):
    assert seconds(secrets.findings, piece * 40_000) < 10


def test_values_that_end_together_score_as_alone():
    run = "key=" * 40 + "Ab1Cd2Ef3" * 30
    spans = {(at, len(run), True) for at in range(0, len(run) - 9, 7)}
    together = secrets.bare_scores(run, spans)
    assert all(together[s] == pytest.approx(secrets.literal_score(run[s[0] :], True)) for s in spans)
    assert secrets.bare_scores("x" * 100, {(0, 100, True), (10, 100, True)}) == {(0, 100, True): 0.0, (10, 100, True): 0.0}


@pytest.mark.parametrize("page", ["<div>" * 20_000 + "</p>" * 20_000, "<ul>" * 20_000 + "</table>" * 20_000, "<li>" * 40_000, "<table><tr><td>" * 9000 + "</p>" * 9000])
def test_end_tags_that_end_nothing_cost_nothing(page):
    assert seconds(extraction.parse, page) < 5


def test_words_are_whole_whatever_their_length():
    word = "a" * 41
    assert toxicity.terms_of(word)[0] == word != toxicity.terms_of("a" * 60)[0]
    for words_in in (toxicity.words_in, language.words_in):
        text = "wonderful " * 30 + "x" * 90 + " 7 end"
        found = [w for words in words_in(text, 25) for w in words]
        assert found == ["wonderful"] * 30 + ["x" * 90, "end"]
        assert list(words_in(None)) == [[]]


def test_long_words_count_for_the_language(spark):
    docs = spark.createDataFrame([(i, lang, word * 30) for i, (lang, word) in enumerate([("xx", "abc"), ("yy", "dfg")] * 10)], "doc_id int, lang string, text string")
    model = language.train(docs)
    assert [language.Scorer(model).score(w * 200)[0] for w in ("abc", "dfg", "bca")] == ["xx", "yy", "xx"]
    assert language.Scorer(model).score("77 !") == ("und", 0.0, False)


def test_bounded_ids_are_the_smallest_hashes(spark):
    keys = spark.range(0, 30_000).select((F.col("id") % 9_000).alias("k")).union(spark.createDataFrame([(None,)], "k bigint"))
    want = [r.k for r in keys.filter("k IS NOT NULL").distinct().orderBy(F.xxhash64("k"), "k").limit(500).collect()]
    assert sorted(r[0] for r in common.bounded_ids(keys, "k", 500).collect()) == sorted(want)
    assert common.bounded_ids(keys, "k", 10_000).count() == 9_000 and common.bounded_ids(keys.limit(0), "k", 5).count() == 0


def test_stages_keep_columns_whose_names_they_might_use(spark, tmp_path):
    text = "the house is here and so are we " * 4
    rows = [(1, text, "en", None, None, "l", 1, "p", "r", 5, 6, 7), (2, text, None, None, None, "l", 1, "p", "r", 5, 6, 7), (3, "we are here", None, None, None, "l", 2, "p", "r", 5, 6, 7)]
    docs = spark.createDataFrame(rows, f"doc_id bigint, text string, lang string, source string, n_chars bigint, {CLASHES}")
    names = docs.columns
    found = corpus_pipeline.language_id(spark, docs, str(tmp_path))
    assert found.columns == names and {r.lang for r in found.collect()} == {"en"}  # unnamed languages are filled in
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == names
    assert sorted((r.doc_id, r.language, r.rows, r.kept_id) for r in docs.collect()) == [(1, "l", 1, 5), (3, "l", 2, 5)]
