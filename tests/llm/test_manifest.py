"""The Merkle manifest against a plain tree in Python."""

import hashlib
import random
import zlib

import pytest

import __spark_entry__ as entry
from gleaner.llm import manifest

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, _pos bigint, _leaf string, _group string, path string"
COLUMNS = ["doc_id", "source", "lang", "n_chars", "text"]


def h(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf_of(row):
    return h("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def tree(digests):
    """(root, siblings of every node as (before, after) by level)."""
    paths = [[] for _ in digests]
    at = list(range(len(digests)))
    while len(digests) > 1:
        for i, place in enumerate(at):
            run = digests[place // 16 * 16 : place // 16 * 16 + 16]
            paths[i].append(("".join(run[: place % 16]), "".join(run[place % 16 + 1 :])))
        digests = [h("".join(digests[k : k + 16])) for k in range(0, len(digests), 16)]
        at = [place // 16 for place in at]
    return digests[0], paths


def fold(node, path):
    for before, after in path:
        node = h(before + node + after)
    return node


def brute(rows):
    """Output rows of op12 for rows of (doc_id, source, lang, n_chars, text)."""
    leaves = sorted(((r[1] is not None, (r[1] or "").encode()), r[0] is not None, r[0] or 0, leaf_of(r), r) for r in rows) if rows else []
    groups = {}
    for group, _, _, leaf, row in leaves:
        groups.setdefault(group, []).append((leaf, row))
    if not groups:
        return []
    trees = [tree([leaf for leaf, _ in own]) for own in groups.values()]
    root, upper = tree([t[0] for t in trees])
    out = []
    for own, (subroot, paths), over in zip(groups.values(), trees, upper):
        for (leaf, row), path in zip(own, paths):
            whole = path + over
            low = "".join(c.lower() if "A" <= c <= "Z" else c for c in row[4]) if row[4] is not None else None
            tampered = leaf_of((*row[:4], low)) if row[0] is not None and zlib.crc32(str(row[0]).encode()) % 5 == 0 else leaf
            end = fold(tampered, whole)
            out.append((row[0], leaf, subroot, root, h("".join(a + b for a, b in whole)), end, end == root))
    return sorted(out, key=repr)


def result(spark, rows, tmp_path, parts=3):
    data = [(i, t, lang, s, n, 5, "x", "y", "z") for i, s, lang, n, t in rows]
    spark.createDataFrame(data, SCHEMA).repartition(parts).write.mode("overwrite").parquet(f"{tmp_path}/documents.parquet")
    out = entry.queries()["op12_merkle_manifest"](spark, str(tmp_path))
    assert out.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    return sorted(map(tuple, out.collect()), key=repr)


def some(n, sources, seed=2, ids=None):
    rng = random.Random(seed)
    ids = ids or list(range(n))
    return [(i, rng.choice(sources), rng.choice(["en", None]), rng.choice([1, None]), rng.choice(["Text A", "text", "Ünï Z", "", None]) and f"Row {i} Ünï") for i in ids]


@pytest.mark.parametrize("rows", [
    [],
    [(7, "a", "en", 3, "One")],
    [(None, None, None, None, None)],
    some(300, ["a"] * 20 + ["b", None, "", "é", "Z"]),
    some(17, ["one"]),
    some(256, ["one"]) + [(1000, "two", None, None, None)],
    some(0, ["a", "b"], ids=[0, 63, 64, 65, -1, -64, -65, 1 << 40, (1 << 63) - 1, -(1 << 63), 65535, 65536, 1 << 33]),
    [(5, "a", "en", 1, "Same")] * 40 + [(5, "a", "en", 1, f"Other {k}") for k in range(20)] + [(None, "a", "en", 1, f"None {k % 9}") for k in range(30)] + some(50, ["a", "b"]),
    [(k, f"s{k}", None, None, "A lone Leaf") for k in range(40)],
], ids=["nothing", "one", "nulls", "hot", "seventeen", "256 and 1", "wide ids", "repeats", "lone leaves"])
def test_manifest_matches_brute_force(spark, rows, tmp_path):
    assert result(spark, rows, tmp_path) == brute(rows)


def test_op12(spark, sf_dir):
    docs = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select(*COLUMNS).collect()]
    out = sorted(map(tuple, entry.queries()["op12_merkle_manifest"](spark, sf_dir).collect()), key=repr)
    assert out == brute(docs) and {r[6] for r in out} == {True, False}


def test_places_need_no_more_than_a_word(spark):
    """The directory's sums are over the children of one node: at most 1024 words or 65,536 prefixes."""
    rows = spark.createDataFrame([(True, "g", True, w, 1) for w in (-5, 0, 1023, 1024, 1 << 50)], "_named boolean, _group string, _band boolean, _word bigint, _rows bigint")
    out = manifest.directory(rows.withColumn("_bits", manifest.F.lit(1))).orderBy("_word").collect()
    assert [(r._base, r._total) for r in out] == [(k, 5) for k in range(5)]
