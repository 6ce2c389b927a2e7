"""Resolution and grouped windows against brute force, with one group that holds a third of all rows."""

import os
import random
from collections import defaultdict

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from gleaner.operators import dedup, skew
from gleaner.session import cut_lineage


def skewed(spark, n=3000):
    rnd = random.Random(7)
    rows = [(i, "hot" if i % 3 == 0 else f"g{rnd.randrange(40)}", rnd.randrange(100_000), i * 10 + rnd.randrange(10)) for i in range(n)]
    return spark.createDataFrame(rows, "seq bigint, g string, v bigint, at bigint").cache()


def test_ranked(spark):
    df = skewed(spark)
    got = skew.ranked(df, ["g"], F.floor(F.col("seq") / 50), [F.col("seq")], "r")
    want = df.withColumn("r", F.row_number().over(Window.partitionBy("g").orderBy("seq")).cast("bigint"))
    assert sorted(got.select("seq", "r").collect()) == sorted(want.select("seq", "r").collect())


def test_ranked_without_group(spark):
    df = skewed(spark)
    got = skew.ranked(df, [], F.floor(F.col("seq") / 50), [F.col("seq")], "r").select("seq", "r").collect()
    assert sorted(got) == [(i, i + 1) for i in range(3000)]


def test_running_min(spark):
    df = skewed(spark)
    got = skew.running_min(df, ["g"], -F.floor(F.col("seq") / 50), [F.col("seq").desc()], "v", "low")
    w = Window.partitionBy("g").orderBy(F.col("seq").desc()).rowsBetween(Window.unboundedPreceding, -1)
    want = df.withColumn("low", F.min("v").over(w))
    assert sorted(got.select("seq", F.coalesce("low", F.lit(-1))).collect()) == sorted(want.select("seq", F.coalesce("low", F.lit(-1))).collect())


def test_previous_value(spark):
    df = skewed(spark)
    got = skew.previous_value(df, ["g"], F.floor(F.col("at") / 500), [F.col("at")], "at", "p")
    want = df.withColumn("p", F.lag("at").over(Window.partitionBy("g").orderBy("at")))
    pick = lambda d: sorted(d.select("seq", F.coalesce("p", F.lit(-1))).collect())
    assert pick(got) == pick(want)


def brute_groups(rows):
    parent = {r[0]: r[0] for r in rows}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    first = {}
    for seq, canonical, link, *_ in rows:
        for key in ["c:" + canonical] + (["l:" + link] if link else []):
            if key in first:
                a, b = sorted((root(seq), root(first[key])))
                parent[b] = a
            first.setdefault(key, seq)
    return {r[0]: root(r[0]) for r in rows}


COLS = "seq bigint, canonical string, link string, source string, chars int, title string, url string, id string, title_norm string, posted timestamp, relisted timestamp, updated timestamp"


def keyed(spark, rows):
    full = [(s, c, l, src, n, f"t{s % 5}", f"u{s}", f"id{c}{s % 2}", f"t{s % 5}", None, None, None) for s, c, l, src, n in rows]
    return spark.createDataFrame(full, COLS).cache()


def postings(n=1500):
    rnd = random.Random(3)
    out = []
    for i in range(n):
        hot = i % 3 == 0
        canonical = "hot" if hot else f"c{rnd.randrange(n)}"
        link = "" if rnd.random() < 0.2 else f"l{rnd.randrange(n)}"
        out.append((i, canonical, link, f"s{rnd.randrange(4)}", rnd.randrange(50)))
    return out


@pytest.mark.parametrize("chunk", [dedup.CONTRACTED, 50, 1])
def test_components(spark, chunk):
    rows = postings()
    got = dict(dedup.components(keyed(spark, rows), chunk).collect())
    assert got == brute_groups(rows)


@pytest.mark.parametrize("chunk", [dedup.CONTRACTED, 3])
def test_components_of_a_long_chain(spark, chunk):
    n = 400
    rows = [(i, f"c{i // 2}", f"l{(i + 1) // 2}", "s", 1) for i in range(n)]
    random.Random(1).shuffle(rows)
    assert set(dict(dedup.components(keyed(spark, rows), chunk).collect()).values()) == {0}


def test_components_leave_one_table_and_shrink(spark, tmp_path, monkeypatch):
    """Links fall from round to round, and a run takes the tables of its rounds away."""
    sizes, folders = [], []

    def cut(df, folder=None):
        out = cut_lineage(df, folder)
        if folder and out.columns == ["a", "b"]:
            sizes.append(out.count())
        folders.append(folder)
        return out

    monkeypatch.setattr(dedup, "cut_lineage", cut)
    rows = [(i, f"c{i // 2}", f"l{(i + 1) // 2}", "s", 1) for i in range(200)]
    assert dedup.components(keyed(spark, rows), 4).count() == 200
    assert sizes == sorted(sizes, reverse=True) and sizes[-1] == 0 and len(sizes) > 2
    assert not os.path.exists(folders[0].removeprefix("file:")) and folders[-1] is None


def test_components_of_nothing(spark):
    assert dedup.components(keyed(spark, []).limit(0)).count() == 0
    assert dict(dedup.components(keyed(spark, [(3, "a", "", "s", 1), (1, "b", "", "s", 1)])).collect()) == {3: 3, 1: 1}


def brute_plan(rows, comp):
    groups = defaultdict(list)
    for r in rows:
        groups[comp[r[0]]].append(r)
    out = {}
    for g in groups.values():
        longest = max(g, key=lambda r: (r[4], -r[0]))
        by_source = defaultdict(list)
        for r in g:
            by_source[r[3]].append(r)
        top = max(len(v) for v in by_source.values())
        tied = [s for s, v in by_source.items() if len(v) == top]
        keeper = longest[3] if longest[3] in tied else tied[0]
        keepers = by_source[keeper]
        for k in keepers:
            out[k[0]] = ("keeper", k[0])
        for i, r in enumerate(r for r in g if r[3] != keeper):
            out[r[0]] = ("copy", keepers[i % len(keepers)][0])
    return out


def test_fold_plan(spark):
    rows = postings()
    k = keyed(spark, rows)
    comp = brute_groups(rows)
    grouped = k.join(dedup.components(k), "seq")
    plan = dedup.fold_plan(grouped, width=40)
    assert {r["seq"]: (r["role"], r["keeper_seq"]) for r in plan.collect()} == brute_plan(rows, comp)


def test_resolution_is_idempotent(spark):
    rows = postings(300)
    k = keyed(spark, rows)
    plan = dedup.fold_plan(k.join(dedup.components(k), "seq"))
    kept = [r["seq"] for r in plan.filter("role = 'keeper'").collect()]
    again = keyed(spark, [r for r in rows if r[0] in set(kept)])
    second = dedup.fold_plan(again.join(dedup.components(again), "seq"))
    # Keepers of one component share a source, so a second pass finds nothing to fold unless a bridge is gone.
    assert second.filter("role = 'copy'").count() == 0
