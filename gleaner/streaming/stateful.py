"""Stateful stream operators."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from gleaner import fixed
from gleaner.streaming.runs import use_rocksdb


def in_time(stream: DataFrame, now: Column, ts: str = "ts") -> DataFrame:
    """Stamps before 2000 or more than a day ahead are rejected before they can move a watermark."""
    low = F.lit("2000-01-01 00:00:00").cast("timestamp")
    return stream.filter((F.col(ts) >= low) & (F.col(ts) <= now + F.expr("INTERVAL 1 DAY")))


def outbox(queue: DataFrame, max_age: str = f"{fixed.OUTBOX_MAX_AGE_DAYS} days") -> DataFrame:
    """Alerts to send (queued_at, body): late ones fall behind the watermark, repeats inside it are dropped."""
    return queue.withWatermark("queued_at", max_age).dropDuplicatesWithinWatermark(["body"])


MINUTE_MS, DAY_MS = 60_000, 86_400_000


#: Groups that the keys of a stateful step are dealt into, and the parts that a group's table of keys is held in. A batch
#: costs a group a few dozen calls, and a key none of its own.
BUCKETS, SLOTS = 64, 64


def _sorted(rows: Iterator[pd.DataFrame], by: list[str]) -> pd.DataFrame:
    """All rows of a group in a batch; callers have folded or sliced them first, so that they are few."""
    return pd.concat(list(rows)).sort_values(by)


def dealt(stream: DataFrame, *keys: str, buckets: int = BUCKETS):
    """The stream grouped by a bucket of its keys, for processors that hold a table of keys."""
    return stream.withColumn("bucket", F.pmod(F.xxhash64(*keys), F.lit(buckets))).groupBy("bucket")


class _Dealt(StatefulProcessor):
    """State of a bucket of keys: Arrow tables with a row a key, a slot of the first column each.

    All rows of a batch are looked at together; what is written are the slots of the keys that a batch touches.
    """

    schema: list[tuple[str, pa.DataType]]

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.kept = handle.getMapState("kept", "slot int", "rows binary")

    def held(self) -> pd.DataFrame:
        tables = [pa.ipc.open_stream(bytes(v[0])).read_all() for _, v in self.kept.iterator()]
        return pa.concat_tables([pa.schema(self.schema).empty_table(), *tables]).to_pandas()

    def _slots(self, rows: pd.DataFrame) -> np.ndarray:
        own = pd.util.hash_array(rows[self.schema[0][0]].to_numpy(object), categorize=False) % SLOTS
        return own.astype(int)

    def keep(self, rows: pd.DataFrame, touched: pd.DataFrame) -> None:
        own = self._slots(rows)
        place = np.argsort(own, kind="stable")
        table = pa.Table.from_pandas(rows.iloc[place], pa.schema(self.schema), preserve_index=False)
        edges = np.searchsorted(own[place], np.arange(SLOTS + 1))
        for slot in np.unique(self._slots(touched)).tolist():
            first, end = edges[slot], edges[slot + 1]
            if first < end:
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, table.schema) as out:
                    out.write_table(table.slice(first, end - first))
                self.kept.updateValue((slot,), (sink.getvalue().to_pybytes(),))
            else:
                self.kept.removeKey((slot,))

    def retime(self, before: pd.Series, after: pd.Series) -> None:
        """One timer a bucket, at what is due first."""
        old, new = (None if due.empty else int(due.min()) for due in (before, after))
        if old != new:
            if old is not None:
                self.handle.deleteTimer(old)
            if new is not None:
                self.handle.registerTimer(new)

    def close(self) -> None:
        pass


def _in_runs(held: pd.DataFrame, rows: pd.DataFrame, keys: list[str], order: list[str]) -> tuple[pd.DataFrame, np.ndarray]:
    """What is held, then the rows (``new``), of one key after another, and where a key starts. A null is a key as well."""
    both = pd.concat([held.assign(new=False), rows.assign(new=True)], ignore_index=True)
    codes = [pd.factorize(both[k])[0] for k in keys]
    place = np.lexsort([*(both[o].to_numpy() for o in reversed(order)), both["new"].to_numpy(bool), *codes])
    starts = np.ones(len(both), bool)
    starts[1:] = np.logical_or.reduce([c[place][1:] != c[place][:-1] for c in codes])
    return both.iloc[place].reset_index(drop=True), starts


def _before(values: np.ndarray) -> np.ndarray:
    return np.concatenate([values[:1], values[:-1]])


def _newest(values: pd.Series, starts: np.ndarray) -> np.ndarray:
    """The highest value of the key so far."""
    return values.groupby(starts.cumsum()).cummax().to_numpy()


def _ends(starts: np.ndarray) -> np.ndarray:
    """Where a key ends. No rows have no end."""
    return np.append(starts[1:], True)[: len(starts)]


class _LastSeen(_Dealt):
    """State: the last stamp of each key, in epoch microseconds; a timer clears those whose TTL has run out."""

    schema = [("key", pa.string()), ("last_at", pa.int64())]

    def __init__(self, ttl_ms: int):
        self.ttl_ms = ttl_ms

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        held = self.held()
        new = pd.concat(list(rows))[["key", "first_at", "last_at"]]
        both, starts = _in_runs(held.assign(first_at=held["last_at"]), new, ["key"], ["first_at"])
        last = _newest(both["last_at"], starts)
        fresh = both["new"].to_numpy(bool) & (starts | (both["first_at"].to_numpy() - _before(last) > self.ttl_ms * 1000))
        after = both.assign(last_at=last)[["key", "last_at"]][_ends(starts)]
        self.keep(after, new)
        self.retime(self._expiry(held["last_at"]), self._expiry(after["last_at"]))
        if fresh.any():
            yield both.loc[fresh, ["key", "first_at"]]

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        held = self.held()
        alive = self._expiry(held["last_at"]) > max(timerValues.getCurrentWatermarkInMs(), expiredTimerInfo.getExpiryTimeInMs())
        rest = held[alive]
        self.keep(rest, held[~alive])
        if not rest.empty:
            self.handle.registerTimer(int(self._expiry(rest["last_at"]).min()))
        return
        yield

    def _expiry(self, last: pd.Series) -> pd.Series:
        # a window that is still open may reach back a minute: only then can no stamp within the TTL come any more
        return last // 1000 + 1 + self.ttl_ms + MINUTE_MS


def first_sightings(stream: DataFrame, ttl_hours: int, late: str = "10 minutes") -> DataFrame:
    """(key, first_at): events whose key was not seen for ``ttl_hours`` (last-seen TTL). stream: key, ts.

    Events are first folded to one row per key and minute. A minute is far shorter than the TTL, so only
    its first event can be new; a hot key costs the stateful step one row a minute, not one per event.
    A key whose TTL has run out leaves the state, so it holds only what was seen within the TTL.
    """
    use_rocksdb(stream.sparkSession)
    folded = (
        stream.withWatermark("ts", late).groupBy("key", F.window("ts", "1 minute").alias("w"))
        .agg(F.min("ts").alias("lo"), F.max("ts").alias("hi"))
        .select(F.col("key").cast("string").alias("key"), F.window_time("w").alias("at"), F.unix_micros("lo").alias("first_at"), F.unix_micros("hi").alias("last_at"))
    )
    found = dealt(folded, "key").transformWithStateInPandas(
        statefulProcessor=_LastSeen(ttl_hours * 3_600_000), outputStructType="key string, first_at bigint",
        outputMode="Append", timeMode="EventTime",
    )
    return found.select(F.col("key").cast("bigint").alias("key"), "first_at")


class _FirstTwo(_Dealt):
    """State: how many rows of each slice were passed on, two at most. Rows are looked at a batch of Arrow at a time."""

    schema = [("key", pa.string()), ("slice", pa.int64()), ("n", pa.int64())]

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        by = ["key", "slice"]
        head = None
        for pdf in rows:
            both = pdf[[*by, "seq", "at"]] if head is None else pd.concat([head, pdf[[*by, "seq", "at"]]])
            head = both.sort_values(["at", "seq"]).groupby(by, dropna=False, sort=False).head(2)
        held = self.held()
        n = head[by].merge(held, "left", by)["n"].fillna(0).to_numpy(int)
        passed = head[head.groupby(by, dropna=False, sort=False).cumcount().to_numpy() + n < 2]
        counted = pd.concat([held, passed[by].assign(n=1)])
        self.keep(counted.groupby(by, dropna=False, as_index=False, sort=False)["n"].sum(), passed)
        if len(passed):
            yield passed[["key", "slice", "seq", "at"]]


class _Strikes(_Dealt):
    """State: how often each key was turned down, up to two."""

    schema = [("key", pa.string()), ("n", pa.int64())]

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        pdf, held = _sorted(rows, ["at", "seq"])[["key", "seq"]], self.held()
        n = pdf[["key"]].merge(held, "left", "key")["n"].fillna(0).to_numpy(int)
        place = pdf.groupby("key", dropna=False, sort=False).cumcount().to_numpy() + n
        told = pdf.assign(outcome=np.where(place == 0, "defer", "final"))[place < 2]
        counted = pd.concat([held, told[["key"]].assign(n=1)])
        self.keep(counted.groupby("key", dropna=False, as_index=False, sort=False)["n"].sum(), told)
        if len(told):
            yield told[["key", "seq", "outcome"]]


def two_strikes(stream: DataFrame, slices: int = 64) -> DataFrame:
    """(key, seq, outcome): the first "no" defers, the second is final, later ones change nothing. stream: key, seq, at.

    A key's rows are dealt into slices that pass on their first two, once and for all; the key itself sees two rows a
    slice, however hot it is.
    """
    use_rocksdb(stream.sparkSession)
    rows = stream.select(F.col("key").cast("string").alias("key"), F.pmod(F.xxhash64("seq"), F.lit(slices)).alias("slice"), "seq", F.unix_micros("at").alias("at"))
    sliced = dealt(rows, "key", "slice").transformWithStateInPandas(
        statefulProcessor=_FirstTwo(), outputStructType="key string, slice bigint, seq bigint, at bigint", outputMode="Append", timeMode="None",
    )
    told = dealt(sliced, "key").transformWithStateInPandas(
        statefulProcessor=_Strikes(), outputStructType="key string, seq bigint, outcome string",
        outputMode="Append", timeMode="None",
    )
    return told.select(F.col("key").cast("bigint").alias("key"), "seq", "outcome")


class _Changed(_Dealt):
    """State: the last message key of each stretch of scans. Gives the changes inside them, and the edges they have in a batch.

    An edge is the stretch's first scan, once, or a later batch's (then without a ``key``), with the key it ends on.
    """

    schema = [("thread", pa.string()), ("part", pa.int64()), ("key", pa.string())]

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        new = pd.concat(list(rows))[["thread", "part", "scan", "key"]]
        both, starts = _in_runs(self.held().assign(scan=0), new, ["thread", "part"], ["scan"])
        self.keep(both[_ends(starts)][["thread", "part", "key"]], new)
        codes, fresh = pd.factorize(both["key"])[0], both["new"].to_numpy(bool)
        inside = both[fresh & ~starts & (codes != _before(codes))][["thread", "scan", "key"]].assign(edge=False, last=None)
        run = starts.cumsum() - 1
        first = fresh & (starts | ~_before(fresh))  # the stretch's first scan of the batch
        edges = both[first][["thread", "scan", "key"]].assign(edge=True, last=both["key"].to_numpy(object)[_ends(starts)][run[first]])
        edges["key"] = edges["key"].astype(object).where(starts[first], None)
        yield pd.concat([inside, edges]) if len(inside) else edges


class _Edges(_Dealt):
    """State: the key that the newest stretch of each thread ends on."""

    schema = [("thread", pa.string()), ("last", pa.string())]

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        new = pd.concat(list(rows))[["thread", "scan", "key", "last"]]
        both, starts = _in_runs(self.held().assign(scan=0, key=None), new, ["thread"], ["scan"])
        self.keep(both[_ends(starts)][["thread", "last"]], new)
        codes = pd.factorize(pd.concat([both["key"], both["last"]]))[0]
        own, last = codes[: len(both)], codes[len(both) :]
        moved = both["new"].to_numpy(bool) & (own >= 0) & (starts | (own != _before(last)))
        if moved.any():
            yield both[moved][["thread", "scan", "key"]]


def changed_states(stream: DataFrame, stretch: int = 1024) -> DataFrame:
    """(thread, scan, key): scans in which a thread's state key moved. stream: thread, scan, key.

    Scans of a thread come in order from batch to batch. Each stretch of them compares its own; only its first and last
    key go to the thread, so a thread with a third of all rows is as many tasks' work as it has stretches.
    """
    use_rocksdb(stream.sparkSession)
    scans = stream.select(F.col("thread").cast("string").alias("thread"), F.floor(F.col("scan") / stretch).alias("part"), "scan", "key")
    inside = dealt(scans, "thread", "part").transformWithStateInPandas(
        statefulProcessor=_Changed(), outputStructType="thread string, scan bigint, key string, edge boolean, last string",
        outputMode="Append", timeMode="None",
    )
    between = dealt(inside.filter("edge"), "thread").transformWithStateInPandas(
        statefulProcessor=_Edges(), outputStructType="thread string, scan bigint, key string", outputMode="Append", timeMode="None",
    )
    moved = inside.filter("NOT edge").select("thread", "scan", "key").union(between)
    return moved.select(F.col("thread").cast("bigint").alias("thread"), "scan", "key")


class _RepostMarks(_Dealt):
    """State: per vacancy and link, the day it was last listed on; a timer clears the marks that have run out."""

    schema = [("vacancy", pa.string()), ("link", pa.string()), ("day", pa.int64())]

    def __init__(self, ttl_days: int):
        self.ttl_days = ttl_days

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        held = self.held()
        new = pd.concat(list(rows))[["vacancy", "link", "day", "seq"]]
        both, starts = _in_runs(held.assign(seq=0), new, ["vacancy", "link"], ["day", "seq"])
        newest = _newest(both["day"], starts)
        fresh = both["new"].to_numpy(bool) & (starts | (both["day"].to_numpy() - _before(newest) > self.ttl_days))
        after = both.assign(day=newest)[["vacancy", "link", "day"]][_ends(starts)]
        self.keep(after, new)
        self.retime(self._expiry(held["day"]), self._expiry(after["day"]))
        if fresh.any():
            yield both.loc[fresh, ["vacancy", "link", "seq"]]

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        held = self.held()
        alive = self._expiry(held["day"]) > max(timerValues.getCurrentWatermarkInMs(), expiredTimerInfo.getExpiryTimeInMs())
        rest = held[alive]
        self.keep(rest, held[~alive])
        if not rest.empty:
            self.handle.registerTimer(int(self._expiry(rest["day"]).min()))
        return
        yield

    def _expiry(self, day: pd.Series) -> pd.Series:
        return (day + self.ttl_days + 1) * DAY_MS


def repost_marks(stream: DataFrame, ttl_days: int = fixed.SEEN_TTL_DAYS, late: str = "7 days") -> DataFrame:
    """(vacancy, link, seq): the one listing per new link that gets a fresh look; every later listing re-stamps
    the mark. stream: vacancy, link, day, seq. Dealt by vacancy and link, so one vacancy's links spread.

    Marks leave the state when they run out.
    """
    use_rocksdb(stream.sparkSession)
    stamped = stream.withColumn("at", F.timestamp_seconds(F.col("day") * 86_400)).withWatermark("at", late)
    rows = stamped.withColumn("vacancy", F.col("vacancy").cast("string"))
    found = dealt(rows, "vacancy", "link").transformWithStateInPandas(
        statefulProcessor=_RepostMarks(ttl_days), outputStructType="vacancy string, link string, seq bigint",
        outputMode="Append", timeMode="EventTime",
    )
    return found.select(F.col("vacancy").cast("bigint").alias("vacancy"), "link", "seq")


class _Silence(_Dealt):
    """State: each job's last stamp and whether its silence was told; a timer fires when the next one is overdue."""

    schema = [("job", pa.string()), ("at_ms", pa.int64()), ("told", pa.bool_())]

    def __init__(self, limits: dict[str, tuple[int, int]], default: tuple[int, int]):
        self.limits, self.default = limits, default

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        held = self.held()
        new = pd.concat(list(rows))[["job", "first_ms", "at_ms"]].assign(told=False)
        both, starts = _in_runs(held.assign(first_ms=held["at_ms"]), new, ["job"], ["first_ms"])
        newest, told = _newest(both["at_ms"], starts), both["told"].to_numpy(bool)
        since = _before(newest)
        late = both["first_ms"].to_numpy() - since >= self._wait(both["job"])
        silent = both["new"].to_numpy(bool) & ~starts & late & ~_before(told)
        after = both.assign(at_ms=newest)[["job", "at_ms", "told"]][_ends(starts)]
        self.keep(after, new)
        self.retime(self._due(held), self._due(after))
        if silent.any():
            yield pd.DataFrame({"job": both["job"].to_numpy(object)[silent], "silent_since_ms": since[silent]})

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        held = self.held()
        now = max(timerValues.getCurrentWatermarkInMs(), expiredTimerInfo.getExpiryTimeInMs())
        silent = ~held["told"].to_numpy(bool) & (held["at_ms"].to_numpy() + self._wait(held["job"]) <= now)
        after = held.assign(told=held["told"].to_numpy(bool) | silent)
        self.keep(after, held[silent])
        due = self._due(after)
        if not due.empty:
            self.handle.registerTimer(int(due.min()))
        if silent.any():
            yield held[silent][["job", "at_ms"]].rename(columns={"at_ms": "silent_since_ms"})

    def _wait(self, jobs: pd.Series) -> np.ndarray:
        hours = {job: own[0] for job, own in self.limits.items()}
        return np.array([hours.get(job, self.default[0]) for job in jobs], np.int64) * 3_600_000

    def _due(self, state: pd.DataFrame) -> pd.Series:
        open_ = state[~state["told"].to_numpy(bool)]
        return open_["at_ms"] + self._wait(open_["job"])


def silent_jobs(stream: DataFrame, limits: dict[str, tuple[int, int]] | None = None, late: str = "1 hour") -> DataFrame:
    """(job, silent_since_ms): jobs without a stamp for their limit, once per outage. stream: job, at.

    Stamps are folded per job and minute before the keyed state, as in ``first_sightings``. An outage that lies within one
    batch is told like one that a timer finds.
    """
    use_rocksdb(stream.sparkSession)
    folded = (
        stream.withWatermark("at", late).groupBy("job", F.window("at", "1 minute").alias("w")).agg(F.min("at").alias("first"), F.max("at").alias("last"))
        .select("job", F.window_time("w").alias("at"), F.unix_millis("first").alias("first_ms"), F.unix_millis("last").alias("at_ms"))
    )
    return dealt(folded, "job").transformWithStateInPandas(
        statefulProcessor=_Silence(limits or fixed.HEARTBEAT_LIMITS, fixed.HEARTBEAT_DEFAULT),
        outputStructType="job string, silent_since_ms bigint", outputMode="Append", timeMode="EventTime",
    )


#: The last alert of a job that had none.
NEVER = -(2**62)


class _Watch(_Dealt):
    """State of a bucket of jobs: each job's last stamp with the stamps counted up to it and the last alert, and the count.

    A batch holds all minutes that the watermark has closed since the last one: how many stamps they had, and the bucket's
    own. Between two stamps of a job both rules are a search in the minutes' ends and in their running count, made for all
    jobs of the bucket together, once more for every day that one of them is told again.
    """

    schema = [("job", pa.string()), ("at", pa.int64()), ("tick", pa.int64()), ("alerted", pa.int64())]

    def __init__(self, limits: dict[str, tuple[int, int]], default: tuple[int, int]):
        self.limits, self.default = limits, default

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.total = handle.getValueState("total", "n bigint")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        pdf = pd.concat(list(rows))
        counts = pdf["n"].notna()
        counted = pdf[counts].sort_values("minute")
        if counted.empty:
            return
        ends = counted["minute"].to_numpy(np.int64)
        ticks = (self.total.get()[0] if self.total.exists() else 0) + counted["n"].to_numpy(np.int64).cumsum()
        self.total.update((int(ticks[-1]),))
        own = pdf.loc[~counts, ["job", "minute", "at_ms"]]
        here = ends.searchsorted(own["minute"].to_numpy(np.int64))
        new = pd.DataFrame({"job": own["job"].to_numpy(object), "at": own["at_ms"].to_numpy(np.int64), "tick": ticks[here], "alerted": NEVER, "here": here})
        both, starts = _in_runs(self.held().assign(here=-1), new, ["job"], ["here"])
        job, last, fresh = both["job"].to_numpy(object), _ends(starts), both["new"].to_numpy(bool)
        until = np.where(last, len(ends), np.append(both["here"].to_numpy(np.int64)[1:], 0))
        at, tick, told = (both[c].to_numpy(np.int64) for c in ("at", "tick", "alerted"))
        hours, runs = self._limits(both["job"])
        alerted = told.copy()
        i = np.maximum(ends.searchsorted(at + hours * 3_600_000), ticks.searchsorted(tick + runs))
        i = np.maximum(i, ends.searchsorted(alerted + DAY_MS))
        out, open_ = [], np.flatnonzero(i < until)
        while len(open_):
            alerted[open_] = ends[i[open_]]
            age = ((alerted[open_] - at[open_]) / 3_600_000 + 0.5).astype(np.int64)
            out.append(pd.DataFrame({"job": job[open_], "at_ms": alerted[open_], "hours": age, "runs": ticks[i[open_]] - tick[open_]}))
            i[open_] = np.maximum(i[open_], ends.searchsorted(alerted[open_] + DAY_MS))
            open_ = open_[i[open_] < until[open_]]
        after = both.assign(alerted=alerted)[["job", "at", "tick", "alerted"]]
        self.keep(after[last], after[last & (fresh | (alerted != told))])
        if out:
            yield pd.concat(out)

    def _limits(self, jobs: pd.Series) -> tuple[np.ndarray, np.ndarray]:
        limits = np.array([self.limits.get(job, self.default) for job in jobs], np.int64).reshape(len(jobs), 2)
        return limits[:, 0], limits[:, 1]


def watchdog(stream: DataFrame, limits: dict[str, tuple[int, int]] | None = None, late: str = "1 hour", buckets: int = BUCKETS) -> DataFrame:
    """(job, at_ms, hours, runs): jobs both old by the clock and out-run by other stamps. stream: job, at.

    Looked at after every minute with a stamp: a job whose last stamp is ``hours`` old, with ``runs`` stamps of any job in
    later minutes, is told once an outage, and again a day after it was last told. Stamps are folded to one row a job and
    minute, and to one count a minute, of which every bucket of jobs gets a copy.
    """
    use_rocksdb(stream.sparkSession)
    marked = stream.withWatermark("at", late)
    by_minute = F.window("at", "1 minute").alias("w")
    minute = (F.unix_millis(F.window_time("w")) + 1).alias("minute")
    none = lambda kind: F.lit(None).cast(kind)
    counts = marked.groupBy(by_minute).agg(F.count(F.lit(1)).alias("n")).select(
        F.explode(F.sequence(F.lit(0), F.lit(buckets - 1)).cast("array<bigint>")).alias("bucket"), F.window_time("w").alias("at"), minute,
        none("string").alias("job"), none("bigint").alias("at_ms"), "n",
    )
    own = marked.groupBy(by_minute, "job").agg(F.max("at").alias("last")).select(
        F.pmod(F.xxhash64("job"), F.lit(buckets)).cast("bigint").alias("bucket"), F.window_time("w").alias("at"), minute,
        "job", F.unix_millis("last").alias("at_ms"), none("bigint").alias("n"),
    )
    return counts.unionByName(own).groupBy("bucket").transformWithStateInPandas(
        statefulProcessor=_Watch(limits or fixed.HEARTBEAT_LIMITS, fixed.HEARTBEAT_DEFAULT),
        outputStructType="job string, at_ms bigint, hours bigint, runs bigint", outputMode="Append", timeMode="EventTime",
    )


class _Ring(StatefulProcessor):
    """State: the found counts of the source's last runs, oldest first, and the last run; nothing older is kept."""

    def __init__(self, history: int):
        self.history = history

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.counts = handle.getListState("counts", "found bigint")
        self.last = handle.getValueState("last", "run bigint")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        pdf = _sorted(rows, ["run_us"])
        ring = [r[0] for r in self.counts.get()] if self.counts.exists() else []
        last = self.last.get()[0] if self.last.exists() else None
        out = []
        for run, found in zip(pdf["run_us"].tolist(), pdf["found"].tolist()):
            if last is not None and run <= last:
                continue  # a run that is told again, or comes too late to be judged
            n = len(ring)
            ordered = sorted(ring)
            median = (ordered[(n - 1) // 2] + ordered[n // 2]) / 2 if n else 0.0
            if median >= fixed.MIN_MEDIAN and found < median * fixed.DEGRADE_RATIO:
                out.append((key[0], run, found, median, "degraded", n))
            elif found == 0 and n >= fixed.NEVER_RUNS and not any(ring):
                out.append((key[0], run, found, median, "never-succeeded", n))
            ring, last = [*ring, found][-self.history :], run
        self.counts.put([(f,) for f in ring])
        self.last.update((last,))
        if out:
            yield pd.DataFrame(out, columns=["source", "run_us", "found", "median", "reason", "runs_before"])

    def close(self) -> None:
        pass


def degradation_stream(counts: DataFrame, history: int = fixed.HISTORY_LEN) -> DataFrame:
    """(source, run, found, median, reason, runs_before) as ``health.degradations`` gives them. stream: source, run, found.

    Runs of a source come in order from batch to batch; an earlier one than the last judged is passed over. The state is
    ``history`` numbers a source for good.
    """
    use_rocksdb(counts.sparkSession)
    judged = counts.select("source", F.unix_micros("run").alias("run_us"), F.col("found").cast("bigint").alias("found")).groupBy("source").transformWithStateInPandas(
        statefulProcessor=_Ring(history), outputStructType="source string, run_us bigint, found bigint, median double, reason string, runs_before int",
        outputMode="Append", timeMode="None",
    )
    return judged.select("source", F.timestamp_micros("run_us").alias("run"), "found", "median", "reason", "runs_before")
