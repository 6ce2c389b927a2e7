"""The registered queries over the given tables, against brute force or held-out labels."""

import hashlib
import re
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
import pytest
from tokenizers import Tokenizer

import __spark_entry__ as entry
import corpus_pipeline
from gleaner.llm import hamming, packing, secrets

from test_operators import base_spans, brute_components, brute_fingerprint, brute_repeats


@pytest.fixture(scope="module")
def texts(sf_dir):
    t = pq.read_table(f"{sf_dir}/documents.parquet", columns=["doc_id", "text"]).to_pydict()
    return dict(zip(t["doc_id"], t["text"]))


def rows(spark, sf_dir, name):
    return {r[0]: r for r in entry.queries()[name](spark, sf_dir).collect()}


def test_names():
    names = entry.queries()
    assert [sum(n.startswith(f"op{i}_") for n in names) for i in range(1, 11)] == [1] * 10 and "pipeline" in names


def test_op1(spark, sf_dir, texts):
    out = rows(spark, sf_dir, "op1_secret_scan")
    for i, text in texts.items():
        spans = base_spans(text)
        assert out[i].base_sha256 == hashlib.sha256(",".join(spans).encode()).hexdigest()
        assert (out[i].n_assign, out[i].n_access, out[i].n_hex) == tuple(sum(s.startswith(k) for s in spans) for k in secrets.BASE_KINDS)


def test_op2_on_the_held_out_fold(spark, sf_dir):
    out = rows(spark, sf_dir, "op2_toxicity")
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for i, r in out.items())
    labels = pq.read_table(f"{sf_dir}/labels.parquet").to_pydict()
    clean = [out[i].predicted for i, t in zip(labels["doc_id"], labels["toxic"]) if t == 0 and out[i].held_out]
    assert np.mean(clean) <= 0.05


def test_op3(spark, sf_dir, texts):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    pieces = {}
    for r in entry.queries()["op3_packing"](spark, sf_dir).collect():
        pieces.setdefault(r.doc_id, []).append(r)
    for i, text in texts.items():
        ids, at = np.array([*tokenizer.encode(text, add_special_tokens=False).ids, packing.END_ID], "<u4"), 0
        for r in sorted(pieces[i], key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids)


def test_op4(spark, sf_dir, texts):
    out = rows(spark, sf_dir, "op4_substring_dedup")
    for i, kept, n, removed in brute_repeats(list(texts.items()), 13):
        assert (out[i].n_words, out[i].n_removed, out[i].kept_sha256) == (n, removed, hashlib.sha256(kept.encode()).hexdigest())


def test_op7(spark, sf_dir, texts):
    out = rows(spark, sf_dir, "op7_simhash")
    fps = {i: brute_fingerprint(t) for i, t in texts.items()}
    group, least = brute_components(set(fps.values())), {}
    for i in sorted(fps):
        least.setdefault(group[fps[i]], i)
    assert {i: (r.fingerprint, r.component_id) for i, r in out.items()} == {i: (f"{f:016x}", least[group[f]]) for i, f in fps.items()}


def test_op8_on_the_held_out_fold(spark, sf_dir):
    out = rows(spark, sf_dir, "op8_language_id")
    t = pq.read_table(f"{sf_dir}/documents.parquet", columns=["doc_id", "lang"]).to_pydict()
    held = [(out[i].lang_pred, lang) for i, lang in zip(t["doc_id"], t["lang"]) if out[i].held_out]
    assert np.mean([a == b for a, b in held]) > 0.95 and all(r.held_out == (zlib.crc32(str(i).encode()) % 3 == 1) for i, r in out.items())


def test_op9(spark, sf_dir):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{sf_dir}/embeddings.parquet'")
    want = sorted(con.execute(f"SELECT query_id, vec_id, distance, rank FROM ({hamming.OP9_SQL})").fetchall())
    assert sorted(map(tuple, entry.queries()["op9_exact_top_k"](spark, sf_dir).collect())) == want


def test_pipeline_matches_brute_force(spark, sf_dir, texts):
    kept = {i: t for i, t in sorted(texts.items()) if re.search(r"[^\W\d_]", t or "")}
    fps = {i: brute_fingerprint(t) for i, t in kept.items()}
    group, first = brute_components(set(fps.values())), {}
    for i in sorted(fps):
        first.setdefault(group[fps[i]], i)
    kept = {i: kept[i] for i in sorted(first.values())}
    left = {}
    for i, words, n, removed in brute_repeats(list(kept.items()), 13):
        if removed == 0 or removed < n:
            left[i] = words if removed else kept[i]
    clean = {i: secrets.masked(t, "[secret]", 0.5) for i, t in left.items()}
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    got = {}
    for r in corpus_pipeline.run(spark, sf_dir).collect():
        got.setdefault(r.doc_id, []).append((r.start, r.length, r.ids_crc32))
    assert got.keys() == clean.keys()
    for i, text in clean.items():
        ids, at = np.array([*tokenizer.encode(text, add_special_tokens=False).ids, packing.END_ID], "<u4"), 0
        for start, length, crc in sorted(got[i]):
            assert start == at and crc == zlib.crc32(ids[at : at + length].tobytes())
            at += length
        assert at == len(ids)


def test_language_stage_keeps_texts_that_no_model_can_judge(spark, sf_dir):
    texts_ = ["the house is here", "дім", None, "", " 12 _ !", "é"]
    for lang in (None, "und"):
        docs = spark.createDataFrame([(i, t, lang) for i, t in enumerate(texts_)], "doc_id bigint, text string, lang string")
        out = corpus_pipeline.language_id(spark, docs, sf_dir)
        assert out.columns == docs.columns and sorted(r.doc_id for r in out.collect()) == [0, 1, 5]


def test_stages_take_nulls_repeats_and_empty_tables(spark, sf_dir):
    rows_ = [(1, "the house is here and so are we", "en", None, None, "x"), (1, "the house is here and so are we", "en", None, None, "x"),
             (2, None, None, None, None, None), (None, "a loose text without an id", "en", "s", 3, None), (3, "", "en", "s", 0, "x"),
             (4, "token = 'abcdefgh12345678' " * 3, "en", "s", 3, "x")]
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint, kept string"
    for data in (rows_, []):
        docs = spark.createDataFrame(data, schema)
        for _, stage in corpus_pipeline.STAGES[:-1]:
            docs = stage(spark, docs, sf_dir)
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars", "kept"]
        out = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir).collect()
        assert {r.doc_id for r in out} == ({1, None, 4} if data else set())
