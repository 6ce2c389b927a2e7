"""The gate with folded copies, against the rules written out one posting at a time."""

import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from gleaner.operators import gate
from gleaner.operators.verdicts import verdict_gate

DAY = datetime(2024, 1, 1)


def tables(spark):
    rnd = random.Random(5)
    pick = lambda p, n: f"{p}{rnd.randrange(n)}"
    jobs, copies, packages = [], [], []
    for i in range(400):
        jobs.append((i, "hot" if i % 3 == 0 else pick("k", 30), pick("s", 3), pick("u", 60), pick("l", 60) if i % 7 else "", pick("id", 200), pick("Title ", 12), rnd.choice([10, 400])))
    for i in range(150):
        copies.append((rnd.randrange(400), 1000 + i, pick("s", 3), pick("u", 60), pick("id", 200) if i % 2 else None, "Intern here" if i % 9 == 0 else None, pick("k", 30) if i % 3 else None))
    for i in range(300):
        closed = rnd.random() < 0.6
        packages.append((i, f"f{i}", "hot" if i % 3 == 0 else pick("k", 30), pick("s", 3), pick("u", 60), pick("l", 60), DAY + timedelta(days=rnd.randrange(50)), rnd.randrange(3), closed and rnd.random() < 0.3, closed))
    seen = [(f"id{rnd.randrange(200)}", DAY) for _ in range(60)] + [(f"repost:l{rnd.randrange(60)}", DAY) for _ in range(20)]
    return jobs, copies, packages, sorted(set(seen))


def brute(jobs, copies, packages, seen):
    store, links = {k for k, _ in seen}, {}
    for p in packages:
        if not p[8]:
            links.setdefault(p[5], p[1])
    out = {}
    for seq, key, source, url, link, id_, title, chars in jobs:
        mine = [c for c in copies if c[0] == seq]
        lookups = [(key, source, url)] + [(c[6], c[2], c[3]) for c in sorted(mine, key=lambda c: c[1]) if c[6]]
        best = None
        for k, s, u in lookups:
            for p in packages:
                if p[2] == k and p[3] == s and p[9] and p[4] != u and p[5] != link and (best is None or p[6] > best[6]):
                    best = p
        if best is not None and any(p[2] == k and p[3] == best[3] and not p[9] and p[6] > best[6] for k, _, _ in lookups for p in packages):
            best = None
        if not link or f"repost:{link}" in store:
            best = None
        same = [p[1] for k, s, u in lookups for p in packages if p[2] == k and p[3] == s and p[4] == u and not p[8]]
        other = [p[1] for k, s, u in lookups for p in packages if p[2] == k and p[3] != s and not p[8]]
        words = " ".join([title] + [c[5] for c in mine if c[5]]).lower().split()
        if best is None and any(i in store for i in [id_] + [c[4] for c in mine if c[4]]):
            kind, file = "seen", None
        elif same:
            kind, file = "packaged", same[0]
        elif link and link in links:
            kind, file = "packaged", links[link]
        elif other:
            kind, file = "dup", other[0]
        elif "intern" in words:
            kind, file = "excluded", None
        else:
            kind, file = ("low" if chars < 100 else "match"), None
        out[seq] = (kind, file, best[1] if best else None, kind in ("low", "match") and chars < 300)
    return out


def test_keyword_gate_with_copies(spark):
    jobs, copies, packages, seen = tables(spark)
    keys = spark.createDataFrame([j[:7] + (j[6].lower(),) for j in jobs], "seq bigint, canonical string, source string, url string, link string, id string, title string, title_norm string")
    texts = spark.createDataFrame([(j[0], "x" * j[7]) for j in jobs], "seq bigint, text string")
    c = spark.createDataFrame(copies, "keeper_seq bigint, seq bigint, alt_source string, alt_url string, merged_id string, merged_title string, merged_key string")
    p = spark.createDataFrame(packages, "seq bigint, file string, canonical string, source string, url string, link string, generated timestamp, reposts int, archived boolean, closed boolean")
    # Package links are keyed by url in the operator: give each package the url its link key comes from.
    links = p.filter("NOT archived").groupBy("link").agg(F.min_by("file", "seq").alias("file"))
    s = spark.createDataFrame(seen, "key string, last_seen timestamp")
    scorer = lambda df: df.withColumn("score", F.length("text")).withColumn("matched_role", F.lit(None).cast("string"))
    original = gate.package_links
    gate.package_links = lambda _: links
    try:
        got = gate.keyword_gate(keys, texts, s, p.withColumn("alt_links", F.lit("")), scorer, ["intern"], 100, copies=c)
        rows = {r["seq"]: (r["kind"], r["file"], r["repost_file"], r["retry"]) for r in got.collect()}
    finally:
        gate.package_links = original
    assert rows == brute(jobs, copies, packages, seen)


def test_null_verdict_is_not_a_rejection(spark):
    rows = [
        (1, None, False, False, True, False), (2, None, False, False, False, False), (3, None, False, True, False, True), (4, 40, False, False, False, False),
        (5, 60, False, False, False, False), (6, 60, False, True, False, True), (7, 40, True, False, False, False), (8, 90, True, False, False, False), (9, 40, False, True, False, True),
    ]
    df = spark.createDataFrame(rows, "seq int, llm_score int, suspect boolean, retry boolean, retry_first boolean, title_first boolean")
    got = {r["seq"]: (r["action"], r["stamped"]) for r in verdict_gate(df, 70, 50).collect()}
    assert got == {
        1: ("defer", False), 2: ("borderline", True), 3: ("hold", False), 4: ("drop", True), 5: ("borderline", True), 6: ("hold", False),
        7: ("borderline", True), 8: ("write", True), 9: ("drop", False),
    }
    advisory = {r["seq"]: r["action"] for r in verdict_gate(df, 0, 50).collect()}
    assert advisory[2] == "write" and advisory[4] == "write"


def test_failed_judge_calls_are_null_rows(spark):
    from gleaner.operators.verdicts import judge_with

    def judge(prompt):
        if "boom" in prompt:
            raise RuntimeError("down")
        return '{"score": 5}'

    df = spark.createDataFrame([(i, 10 - i, "t", "c", "l", "boom" if i == 1 else "fine") for i in range(5)], "seq bigint, score int, title string, company string, location string, text string")
    rows = {r["seq"]: r["failed"] for r in judge_with(df, judge, 3, 2).collect()}
    assert rows == {0: False, 1: True, 2: False}
