"""Processors that hold a table of keys: many keys a call, nulls among them."""

import random

import pandas as pd
import pytest

from gleaner.streaming import stateful


class Handle:
    """State and timers of one bucket."""

    def __init__(self):
        self.map, self.timers, self.calls = {}, set(), 0

    def getMapState(self, name, key, value):
        return self

    def iterator(self):
        return list(self.map.items())

    def updateValue(self, key, value):
        self.calls += 1
        self.map[key] = value

    def removeKey(self, key):
        self.map.pop(key, None)

    def registerTimer(self, at):
        self.timers.add(at)

    def deleteTimer(self, at):
        self.timers.remove(at)


def fed(processor, batches):
    handle = Handle()
    processor.init(handle)
    out = [r for b in batches for pdf in processor.handleInputRows((0,), iter([b]), None) for r in pdf.itertuples(index=False, name=None)]
    return out, handle


def test_a_bucket_of_keys_is_read_and_written_by_slots():
    rng = random.Random(1)
    keys = [None, *map(str, range(3000))]
    rows = sorted((rng.randrange(10**12), rng.choice(keys)) for _ in range(9000))
    batches = [pd.DataFrame([(k, t, t) for t, k in rows[i : i + 3000]], columns=["key", "first_at", "last_at"]) for i in (0, 3000, 6000)]
    got, handle = fed(stateful._LastSeen(86_400_000), batches)
    want, last = [], {}
    for t, k in rows:
        if k not in last or t - last[k] > 86_400_000_000:
            want.append((k, t))
        last[k] = t
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert handle.calls <= 3 * stateful.SLOTS and len(handle.timers) == 1


@pytest.mark.parametrize("slices", [1, 4])
def test_strikes_of_many_keys(slices):
    rng = random.Random(2)
    rows = [(rng.choice([None, *"abcdefg"]), s % slices, s, s) for s in range(60)]
    frames = [pd.DataFrame(rows[i : i + 20], columns=["key", "slice", "seq", "at"]) for i in (0, 20, 40)]
    passed, _ = fed(stateful._FirstTwo(), frames)
    told, _ = fed(stateful._Strikes(), [pd.DataFrame(passed, columns=["key", "slice", "seq", "at"])])
    want = []
    for k in {r[0] for r in rows}:
        want += [(k, r[2], o) for r, o in zip([r for r in rows if r[0] == k], ["defer", "final"])]
    assert sorted(told, key=repr) == sorted(want, key=repr)


def test_silence_is_told_by_a_timer_once():
    Due = type("Due", (), {"getExpiryTimeInMs": lambda self: 43_200_000 * 2, "getCurrentWatermarkInMs": lambda self: 43_200_000 * 2})()
    processor = stateful._Silence({}, (12, 12))
    got, handle = fed(processor, [pd.DataFrame([("a", 0, 0), ("b", 5, 5), ("a", 90_000_000, 90_000_000)], columns=["job", "first_ms", "at_ms"])])
    assert got == [("a", 0)]
    told = [r for pdf in processor.handleExpiredTimer((0,), Due, Due) for r in pdf.itertuples(index=False, name=None)]
    assert told == [("b", 5)]
    assert list(processor.handleExpiredTimer((0,), Due, Due)) == []


def test_a_bucket_of_watched_jobs_is_read_and_written_by_slots():
    class Counted(Handle):
        def getValueState(self, name, kind):
            total = type("Total", (), {"n": None, "exists": lambda s: s.n is not None, "get": lambda s: (s.n,), "update": lambda s, v: setattr(s, "n", v[0])})
            return total()

    minute, day = 60_000, 86_400_000
    jobs = [None, *(f"j{i}" for i in range(3000))]
    first = [(job, minute, i, None) for i, job in enumerate(jobs)] + [(None, minute, None, 3001)]
    later = [(None, day * d, None, 20) for d in range(1, 4)]
    last = [("j7", day * 4, day * 4 - 5, None), (None, day * 4, None, 1), (None, day * 5, None, 1)]
    handle, processor = Counted(), stateful._Watch({"j1": (12, 40)}, (12, 12))
    processor.init(handle)
    told = []
    for rows in (first, later, last):
        frame = pd.DataFrame(rows, columns=["job", "minute", "at_ms", "n"])
        told += [r for pdf in processor.handleInputRows((0,), iter([frame]), None) for r in pdf.itertuples(index=False, name=None)]
    assert handle.calls <= 3 * stateful.SLOTS
    days = lambda job: [at // day for j, at, _, _ in told if j == job]
    assert days("j5") == days(None) == [1, 2, 3, 4, 5] and days("j1") == [2, 3, 4, 5] and days("j7") == [1, 2, 3]
    assert {r[3] for r in told if r[0] == "j5"} == {20, 40, 60, 61, 62} and [r[2] for r in told if r[0] == "j5"][0] == 24
