"""Streams against their batch forms; sinks and readers on files."""

import json
import random
from datetime import datetime, timedelta, timezone

import numpy as np
import pytest
from pyspark.sql import functions as F

from gleaner.operators import health
from gleaner.operators.sinks import write_packages
from gleaner.sources.records import read_frontmatter
from gleaner.streaming import runs, stateful


def dealt(spark, folder, batches, schema):
    """A stream of one micro-batch a list of rows."""
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)


def run(stream, name, folder):
    """(rows, state rows after every batch of each stateful operator)."""
    query = (
        stream.writeStream.format("parquet").option("checkpointLocation", f"{folder}/offsets").option("path", f"{folder}/rows")
        .outputMode("append").trigger(availableNow=True).start()
    )
    query.awaitTermination()
    sizes = [[op["numRowsTotal"] for op in json.loads(p.json)["stateOperators"]] for p in query.recentProgress]
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{folder}/rows").collect(), sizes


def test_sightings_forget_what_is_past_its_ttl(spark, tmp_path):
    start = datetime(2024, 1, 1)
    at = lambda minutes: start + timedelta(minutes=minutes)
    hour = 60
    batches = [
        [(k, at(k)) for k in range(50)],
        [(100, at(20 * hour)), (1, at(23 * hour)), (1, at(23 * hour) + timedelta(seconds=1))],
        [(2, at(24 * hour + 1)), (3, at(24 * hour + 4)), (1, at(46 * hour))],  # 2 and 3 are 23:59 and 24:01 away
        [(101, at(80 * hour))],
        [(1, at(90 * hour)), (101, at(91 * hour))],
    ]
    stream = dealt(spark, str(tmp_path / "in"), batches, "key bigint, ts timestamp")
    got, sizes = run(stateful.first_sightings(stream, 24), "sightings", str(tmp_path / "out"))
    rows = sorted(((k, t) for b in batches for k, t in b), key=lambda r: r[1])
    want, last, end = set(), {}, at(91 * hour) - timedelta(minutes=10)
    for key, t in rows:
        if (key not in last or t - last[key] > timedelta(hours=24)) and t.replace(second=0) + timedelta(minutes=1) <= end:
            want.add((key, int(t.replace(tzinfo=timezone.utc).timestamp() * 1_000_000)))
        last[key] = t
    assert {(r["key"], r["first_at"]) for r in got} == want
    # the keyed state holds the two keys of the last day; before, it held fifty
    keyed = [s[0] for s in sizes if s]
    assert max(keyed) >= 50 and keyed[-1] <= 2


def test_marks_of_links_leave_the_state(spark, tmp_path):
    batches = [[(1, "a", 0, 1), (1, "a", 0, 2), (2, "b", 3, 3)], [(1, "a", 90, 4), (1, "b", 95, 5)], [(1, "a", 181, 6), (9, "z", 400, 7)], [(1, "a", 401, 8), (9, "z", 402, 9)]]
    batches = [[(v, link, 15_000 + day, seq) for v, link, day, seq in b] for b in batches]
    stream = dealt(spark, str(tmp_path / "in"), batches, "vacancy bigint, link string, day bigint, seq bigint")
    got, sizes = run(stateful.repost_marks(stream), "marks", str(tmp_path / "out"))
    assert sorted(r["seq"] for r in got) == [1, 3, 5, 6, 7, 8]
    keyed = [s[0] for s in sizes if s]
    assert keyed[-1] < max(keyed)


def test_strikes_over_batches_and_slices(spark, tmp_path):
    start = datetime(2024, 1, 1)
    rng = random.Random(3)
    rows = [(rng.choice([1, 1, 1, 1, *range(2, 9)]), i, start + timedelta(minutes=i)) for i in range(600)]
    stream = dealt(spark, str(tmp_path / "in"), [rows[:200], rows[200:201], rows[201:450], rows[450:]], "key bigint, seq bigint, at timestamp")
    got, sizes = run(stateful.two_strikes(stream, 7), "strikes", str(tmp_path / "out"))
    want = []
    for key in {r[0] for r in rows}:
        want += [(key, r[1], o) for r, o in zip([r for r in rows if r[0] == key], ["defer", "final"])]
    assert sorted(map(tuple, got)) == sorted(want)
    assert len(sizes[0]) == 2


@pytest.mark.parametrize("stretch", [1, 2, 5, 1000])
def test_changes_over_batches_and_stretches(spark, tmp_path, stretch):
    rng = random.Random(stretch)
    rows = [(t, s, rng.choice("ab")) for s in range(60) for t in (1, 2, 3) if rng.random() < 0.8]
    stream = dealt(spark, str(tmp_path / "in"), [rows[:40], rows[40:70], rows[70:71], rows[71:]], "thread bigint, scan bigint, key string")
    got, _ = run(stateful.changed_states(stream, stretch), "changes", str(tmp_path / "out"))
    want = []
    for thread in (1, 2, 3):
        held = None
        for _, scan, key in [r for r in rows if r[0] == thread]:
            if key != held:
                want.append((thread, scan, key))
            held = key
    assert sorted(map(tuple, got)) == sorted(want)


def test_degradations_keep_ten_numbers_a_source(spark, tmp_path):
    rng = random.Random(5)
    start = datetime(2024, 1, 1)
    rows = [(s, start + timedelta(hours=h), 0 if s == "never" or rng.random() < 0.2 else rng.randint(1, 30)) for h in range(60) for s in ("a", "b", "never")]
    schema = "source string, run timestamp, found bigint"
    stream = dealt(spark, str(tmp_path / "in"), [rows[i : i + 30] for i in range(0, 180, 30)] + [rows[170:]], schema)
    got, sizes = run(stateful.degradation_stream(stream), "ring", str(tmp_path / "out"))
    want = health.degradations(spark.createDataFrame(rows, schema)).select("source", "run", "found", "median", "reason", "runs_before").collect()
    assert sorted(map(tuple, got), key=repr) == sorted(map(tuple, want), key=repr) and got
    assert len({s[0] for s in sizes[1:] if s}) == 1  # what it holds does not grow


def brute_watch(rows, limits, until):
    """Minute by minute, the state as one process would keep it."""
    jobs, tick, out = {}, 0, []
    for minute in sorted({t.replace(second=0, microsecond=0) + timedelta(minutes=1) for _, t in rows}):
        if minute > until:
            break
        own = [(j, t) for j, t in rows if minute - timedelta(minutes=1) <= t < minute]
        tick += len(own)
        for job, t in sorted(own, key=lambda r: r[1]):
            jobs[job] = [t, tick, None]
        for job, held in jobs.items():
            hours, runs_ = limits.get(job, (12, 12))
            told = held[2] and minute - held[2] < timedelta(days=1)
            if job not in {j for j, _ in own} and minute - held[0] >= timedelta(hours=hours) and tick - held[1] >= runs_ and not told:
                held[2] = minute
                out.append((job, int((minute - held[0]) / timedelta(hours=1) + 0.5), tick - held[1]))
    return sorted(out)


def test_watchdog_needs_both_rules_and_reminds_daily(spark, tmp_path):
    start = datetime(2024, 1, 1)
    rng = random.Random(8)
    steady = [("steady", start + timedelta(hours=h, seconds=h)) for h in range(0, 120)]
    rows = steady + [("quiet", start), ("busy", start + timedelta(hours=3)), ("back", start), ("back", start + timedelta(hours=50)), ("slow", start)]
    rows += [(f"j{rng.randint(0, 5)}", start + timedelta(minutes=rng.randint(0, 120 * 60))) for _ in range(60)]
    rows.sort(key=lambda r: r[1])
    limits = {"slow": (72, 60), "busy": (2, 500)}
    stream = dealt(spark, str(tmp_path / "in"), [rows[:50], rows[50:51], rows[51:120], rows[120:]], "job string, at timestamp")
    got, _ = run(stateful.watchdog(stream, limits, buckets=3), "watchdog", str(tmp_path / "out"))
    want = brute_watch(rows, limits, rows[-1][1] - timedelta(hours=1))
    assert sorted((r["job"], r["hours"], r["runs"]) for r in got) == want
    assert {r["job"] for r in got} >= {"quiet", "back", "slow"} and not {"busy", "steady"} & {r["job"] for r in got}
    assert sum(r["job"] == "quiet" for r in got) > 2


def beats(spark, folder, rows):
    spark.createDataFrame(rows, "job string, at timestamp").coalesce(1).write.mode("append").parquet(folder)


def test_silent_jobs_alert_once(spark, tmp_path):
    start = datetime(2024, 1, 1)
    folder = str(tmp_path / "in")
    hourly = [("steady", start + timedelta(hours=h)) for h in range(40)]
    beats(spark, folder, hourly[:3] + [("quiet", start)])
    stream = spark.readStream.schema("job string, at timestamp").option("maxFilesPerTrigger", 1).parquet(folder)
    out = runs.run_folder(spark, "silent-test")
    for part in (hourly[3:20], hourly[20:]):
        runs.run_to_table(stateful.silent_jobs(stream), "silent", out)
        beats(spark, folder, part)
    got = runs.run_to_table(stateful.silent_jobs(stream), "silent", out).collect()
    assert [r["job"] for r in got] == ["quiet"]


def test_outbox_drops_repeats_and_late_alerts(spark, tmp_path):
    day = datetime(2024, 1, 1)
    folder, out = str(tmp_path / "in"), runs.run_folder(spark, "outbox-test")
    (tmp_path / "in").mkdir()
    schema = "queued_at timestamp, body string"
    batches = [[(day, "a"), (day, "a"), (day, "b")], [(day + timedelta(days=9), "c")], [(day, "late"), (day + timedelta(days=9), "c")]]
    stream = spark.readStream.schema(schema).parquet(folder)
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)
        table = runs.run_to_table(stateful.outbox(stream), "outbox", out)
    assert sorted(r["body"] for r in table.collect()) == ["a", "b", "c"]


def test_packages_are_partitioned_by_archive_and_day(spark, tmp_path):
    rows = spark.range(10).select(F.col("id").alias("seq"), F.lit(False).alias("archived"), F.lit("2024-02-01").cast("date").alias("day"))
    path = str(tmp_path / "packages")
    write_packages(rows, path)
    back = spark.read.parquet(path).filter("archived = false AND day = DATE '2024-02-01'")
    assert back.count() == 10 and "PartitionFilters: [isnotnull(archived" in back._jdf.queryExecution().executedPlan().toString()


def test_frontmatter_files(spark, tmp_path):
    (tmp_path / "a.md").write_text("---\r\ntitle: QA: lead\r\nscore: 1\r\nscore: 2\r\n---\nx<!--cover:start-->\nhi\n<!--cover:end-->")
    (tmp_path / "b.md").write_text("no block")
    rows = {r["file"].rsplit("/", 1)[1]: (r["meta"], r["section"]) for r in read_frontmatter(spark, str(tmp_path)).collect()}
    assert rows == {"a.md": ({"title": "QA: lead", "score": "2"}, "hi"), "b.md": (None, "")}


def test_a_large_batch_is_several_files(spark, sf_dir, monkeypatch):
    """Every range of the order is a batch of its own, written by several tasks; those of few rows are filled up."""
    from gleaner.plans import streams
    from gleaner.plans.views import Tables

    monkeypatch.setattr(streams, "FILE_ROWS", 30)
    rows = spark.range(100).select(F.when(F.col("id") < 97, F.col("id")).otherwise(F.col("id") * 3).alias("v"))
    stream, seen = streams.in_batches(Tables(spark, sf_dir), rows, "v", 3), []
    folder = streams.runs.run_folder(spark, "seen")
    streams.runs.run_batches(stream, lambda batch, n: seen.append((batch.rdd.getNumPartitions(), sorted(r.v for r in batch.collect()))), folder)
    assert [v for _, v in seen] == [list(range(97)), [291, 294, 297]]


def test_no_rows_have_no_end():
    assert stateful._ends(np.ones(0, bool)).tolist() == [] and stateful._ends(np.array([True, False, True])).tolist() == [False, True, True]
