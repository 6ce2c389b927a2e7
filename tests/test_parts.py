"""Tables of parts, archive runs over them, and state that grows by its changes."""

import os
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from gleaner.operators.sinks import archive_run, package_store
from gleaner.sources.parts import PartTable
from gleaner.streaming import runs

DAY = datetime(2024, 1, 1)
SCHEMA = "file string, url string, generated timestamp, tier string, closed_at timestamp, archived boolean, day date"


def packages(spark, n=40):
    rows = [
        (f"f{i}", f"u{i}", DAY + timedelta(days=i % 5), "borderline" if i % 8 == 0 else None, None, i % 10 == 9, (DAY + timedelta(days=i % 5)).date())
        for i in range(n)
    ]
    return rows, spark.createDataFrame(rows, SCHEMA)


def state_of(spark, rows):
    return spark.createDataFrame([(r[1], "closed", None, r[2]) for r in rows if r[2] == DAY + timedelta(days=1) and not r[5] and r[3] is None], "url string, status string, note string, updated_at timestamp")


def content(df):
    return sorted((r.file, r.archived, r.closed_at is not None, r.day) for r in df.collect())


def test_an_archive_run_switches_whole_parts(spark, tmp_path):
    rows, df = packages(spark)
    store = package_store(spark, str(tmp_path), SCHEMA)
    store.commit(append=df)
    reader, before = store.read(), content(store.read())
    untouched = {p: f for p, f in store.manifest().items() if p in ("live/2024-01-03", "live/2024-01-05")}
    now = F.lit("2024-01-20 00:00:00").cast("timestamp")
    archive_run(store, state_of(spark, rows), now)
    closed = {r[0] for r in rows if r[2] == DAY + timedelta(days=1) and not r[5] and r[3] is None}
    assert {f for f, archived, marked, _ in content(store.read()) if archived and marked} == closed
    assert len(content(store.read())) == len(rows)
    # the day that lost all but its borderline rows was replaced, days that nothing left were not written
    assert {p: f for p, f in store.manifest().items() if p in untouched} == untouched
    assert content(reader) == before and content(store.read(version=0)) == before
    again = store.manifest()
    archive_run(store, state_of(spark, rows), now)
    assert store.manifest() == again


def test_emptied_parts_are_dropped(spark, tmp_path):
    rows = [("a", "u1", DAY, None, None, False, DAY.date()), ("b", "u2", DAY + timedelta(days=1), None, None, False, (DAY + timedelta(days=1)).date())]
    store = package_store(spark, str(tmp_path), SCHEMA)
    store.commit(append=spark.createDataFrame(rows, SCHEMA))
    state = spark.createDataFrame([("u1", "closed", None, DAY)], "url string, status string, note string, updated_at timestamp")
    archive_run(store, state, F.lit("2024-03-01 00:00:00").cast("timestamp"))
    assert sorted(store.manifest()) == ["archived/2024-01-01", "live/2024-01-02"]


def test_a_killed_writer_leaves_the_old_table(spark, tmp_path, monkeypatch):
    rows, df = packages(spark)
    store = package_store(spark, str(tmp_path), SCHEMA)
    store.commit(append=df)
    before, manifest = content(store.read()), store.manifest()
    now = F.lit("2024-01-20 00:00:00").cast("timestamp")
    with monkeypatch.context() as m:
        m.setattr(store.files, "put", lambda *a: (_ for _ in ()).throw(KeyboardInterrupt()))
        with pytest.raises(KeyboardInterrupt):
            archive_run(store, state_of(spark, rows), now)
    assert content(store.read()) == before and store.manifest() == manifest
    archive_run(store, state_of(spark, rows), now)
    after = content(store.read())
    assert after != before
    folders = len(os.listdir(tmp_path / "data"))
    store.vacuum(keep=1)
    assert content(store.read()) == after and len(os.listdir(tmp_path / "data")) < folders and store.versions() == [1]


def test_parts_take_any_name_and_two_writers_collide(spark, tmp_path):
    table = PartTable(spark, str(tmp_path), "k string, v int", F.col("k"))
    rows = spark.createDataFrame([("a/b", 1), ("ä %=x", 2), ("plain", 3)], "k string, v int")
    table.commit(append=rows, version=0)
    assert sorted(table.manifest()) == ["a/b", "plain", "ä %=x"]
    assert [r.v for r in table.read(["ä %=x"]).collect()] == [2]
    with pytest.raises(FileExistsError):
        table.commit(append=rows, version=0)
    table.commit(replace=rows.filter("v = 9"), parts=["a/b"])
    assert sorted(r.v for r in table.read().collect()) == [2, 3] and PartTable(spark, str(tmp_path / "none"), "k string", F.col("k")).read().count() == 0


def size_of(folder):
    return sum(os.path.getsize(os.path.join(d, f)) for d, _, fs in os.walk(folder) for f in fs if f.endswith(".parquet"))


def test_state_grows_by_its_changes(spark, tmp_path):
    table = runs.StateTable(spark, str(tmp_path), "k int, v int", ["k"], buckets=4, fold=3)
    table.start(spark.range(20_000).select(F.col("id").cast("int").alias("k"), F.lit(0).alias("v")))
    want = {k: 0 for k in range(20_000)}
    base = size_of(tmp_path)
    for n in range(10):
        change = {n: 100 + n, 500 + n: n, 30_000 + n: n}
        gone = [n + 50, 30_000 + n - 1]
        rows = spark.createDataFrame(list(change.items()), "k int, v int")
        touched = rows.select("k").union(spark.createDataFrame([(g,) for g in gone], "k int"))
        for _ in range(2):  # a replayed batch finds what it found before, and gives the same table
            found = {r.k: r.v for r in table.before(n, touched).collect()}
            assert found == {k: want[k] for k in [*change, *gone] if k in want}
            table.write(rows, n, touched)
        want = {k: v for k, v in (want | change).items() if k not in gone}
        assert size_of(f"{tmp_path}/deltas/batch={n}") < base / 5
    assert {r.k: r.v for r in table.latest().collect()} == want
    restarted = runs.StateTable(spark, str(tmp_path), "k int, v int", ["k"], buckets=4, fold=3)
    assert restarted.latest().count() == len(want) and len(restarted.deltas()) <= 7 and len(restarted.base.versions()) == 2


def test_state_of_nothing(spark, tmp_path):
    table = runs.StateTable(spark, str(tmp_path), "k int, v int", ["k"])
    assert table.latest().count() == 0 and table.deltas() == []
    table.write(spark.createDataFrame([(1, 2)], "k int, v int"), 0)
    table.write(spark.createDataFrame([], "k int, v int"), 1, spark.createDataFrame([(1,)], "k int"))
    assert table.before(1).count() == 1 and table.latest().count() == 0
