"""A whole run against the same rules applied to one posting after another."""

import random

import pytest
from pyspark.sql import functions as F

from gleaner.operators import run as rn

COLS = "seq bigint, id string, source string, title string, url string, link string, canonical string, kind string, score int, retry boolean, repost_file string"


def made(seed, n=120):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        kind = rng.choice(["match"] * 5 + ["low", "low", "seen", "dup", "excluded"])
        ident = f"id{rng.randrange(n // 2)}"
        link = rng.choice(["", f"l{i}", f"l{rng.randrange(9)}"])
        repost = f"pkg-{i}" if link and rng.random() < 0.3 else None
        rows.append((i, ident, f"s{i % 3}", f"t{i}", f"https://x/{i}", link, f"c{i}", kind, rng.randrange(20, 30) if kind in ("match", "low") else None, kind in ("match", "low") and rng.random() < 0.4, repost))
    seen = [f"{m}id{k}" for m in (rn.TITLE_ONLY, rn.TITLE_ONLY_VERDICT, rn.RETRY) for k in range(n // 2) if rng.random() < 0.5] + [f"repost:l{k}" for k in range(4)]
    verdicts = [(i, rng.choice([10, 45, 55, 69, 70, 95]), rng.random() < 0.2) for i in range(n) if rng.random() < 0.7]
    copies = [(rng.randrange(n), 1000 + i, f"merged{i}" if rng.random() < 0.7 else None) for i in range(40)]
    return rows, seen, verdicts, copies


def brute(rows, seen, verdicts, copies, budget):
    """Postings in order: gate outcome, identities judged once, the strongest first, and what the store holds after it."""
    store, said = set(seen), {s: (v, sus) for s, v, sus in verdicts}
    written, actions, stamped, judged_of = set(), {}, {}, {}
    merged = {}
    for keeper, _, m in copies:
        merged.setdefault(keeper, []).append(m)

    def stamp(row, own_link=True):
        written.add(row[1])
        written.update(m for m in merged.get(row[0], []) if m)
        if row[5] and (row[10] or (own_link and f"repost:{row[5]}" in store)):
            written.add(f"repost:{row[5]}")

    first = {}
    for row in rows:
        if row[7] == "match":
            held = first.get(row[1])
            if held is None:
                first[row[1]] = [row, []]
            elif held[0][9] and not row[9]:
                held[1].append(held[0])
                held[0] = row
            else:
                held[1].append(row)
            continue
        marker = rn.TITLE_ONLY + row[1]
        stamped[row[0]] = not (row[9] and marker not in store)
        if stamped[row[0]]:
            stamp(row)
        else:
            written.add(marker)
    order = sorted(first.values(), key=lambda f: (-f[0][8], f[0][0]))
    for place, (row, others) in enumerate(order):
        seq, ident = row[0], row[1]
        score, suspect = said.get(seq, (None, False))
        if place >= budget:
            action, done = "deferred", False
        elif score is None and rn.RETRY + ident not in store:
            action, done = "defer", False
            written.add(rn.RETRY + ident)
        elif score is None or (score < 70 and (score >= 50 or suspect)):
            held = row[9] and rn.TITLE_ONLY_VERDICT + ident not in store
            action, done = ("hold", False) if held else ("borderline", True)
        elif score < 70:
            done = not (row[9] and rn.TITLE_ONLY_VERDICT + ident not in store)
            action = "drop"
        else:
            action, done = "write", True
        if action == "hold" or (action == "drop" and not done):
            written.add(rn.TITLE_ONLY_VERDICT + ident)
        for r in [row, *others]:
            actions[r[0]], judged_of[r[0]], stamped[r[0]] = action, seq, done
            if done:
                stamp(r, r is row)
    ways = {r[0]: (actions.get(r[0]), judged_of.get(r[0]), stamped[r[0]]) for r in rows}
    return ways, written


@pytest.mark.parametrize(("seed", "budget"), [(1, 1000), (2, 12), (3, 0)])
def test_a_run_does_what_one_posting_after_another_would(spark, seed, budget):
    rows, seen, verdicts, copies = made(seed)
    decisions = spark.createDataFrame(rows, COLS).repartition(3)
    store = spark.createDataFrame([(k,) for k in seen], "key string")
    told = spark.createDataFrame(verdicts, "seq bigint, llm_score int, suspect boolean")
    folded = spark.createDataFrame(copies, "keeper_seq bigint, seq bigint, merged_id string")
    plan = decisions.select(F.col("seq").alias("component"), "seq", F.lit("keeper").alias("role"), F.col("seq").alias("keeper_seq")).unionByName(
        folded.select(F.col("keeper_seq").alias("component"), "seq", F.lit("copy").alias("role"), "keeper_seq")
    )
    once, judged = rn.judged_matches(decisions, store, told, budget, 70, 50)
    ways = rn.lineage(plan, decisions, once, judged, store)
    want, written = brute(rows, seen, verdicts, copies, budget)
    got = ways.collect()
    assert {r.seq: (r.action, r.judged_seq, r.stamped) for r in got if r.role == "keeper"} == want
    assert {r.seq: r.keeper_seq for r in got if r.role == "copy"} == {s: k for k, s, _ in copies}
    assert all(r.package_seq == (r.judged_seq if r.action in ("write", "borderline") else None) and (r.tier == "borderline") == (r.action == "borderline") for r in got)
    assert {r.key for r in rn.run_stamps(decisions, ways, judged, store, folded).collect()} == written
    if budget == 1000:
        assert {r.action for r in got} >= {"write", "borderline", "drop", "defer", "hold", None}
