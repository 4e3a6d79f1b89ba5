"""What the follower keeps for a file, driven without a stream."""

import numpy as np
import pandas as pd
import pytest

from gridspark.streaming.follow import BUCKET_US, REDUCED, _Follower, pack, reduced, unpack

START = 1_704_088_800_000_000  # a full hour, in microseconds
COLUMNS = [c.split()[0] for c in REDUCED.split(", ")]


class Value:
    row = None

    def exists(self):
        return self.row is not None

    def get(self):
        return self.row

    def update(self, row):
        self.row = row


class Map(dict):
    containsKey, updateValue, removeKey = dict.__contains__, dict.__setitem__, dict.__delitem__  # noqa: N815
    getValue, iterator = dict.__getitem__, dict.items  # noqa: N815


class Handle:
    def getValueState(self, *_):  # noqa: N802
        return Value()

    def getMapState(self, *_):  # noqa: N802
        return Map()


def follower(**options):
    f = _Follower(None, **options)
    f.init(Handle())
    manifest = pd.DataFrame([("a", True, "t2m", 3, 3, START, False, 0, 0, None)], columns=COLUMNS)
    assert not list(f.handleInputRows(("a",), iter([manifest]), None))
    return f


def feed(f, times, values, parts=3):
    """The last event of a batch of polls, read in several parts."""
    polls = pd.DataFrame({"file_id": "a", "at_us": times, "missing": np.isnan(values)})
    cut = [polls.iloc[k::parts] for k in range(parts)]
    events = list(f.handleInputRows(("a",), reduced(p for p in cut if len(p)), None))
    return events[-1].iloc[0] if events else None


def test_times_come_back_whole():
    times = np.random.default_rng(1).integers(0, BUCKET_US, 1000)
    assert unpack(pack(times)).tolist() == sorted(times.tolist()) and len(unpack(pack(times[:0]))) == 0


@pytest.mark.parametrize("order", ["forwards", "backwards", "mixed"])
def test_a_million_misses_are_a_small_state(order):
    """Polls every second for twelve days, the value last or first: the same answer, and a state of some kilobytes."""
    at = START + np.arange(1_000_000) * 1_000_000
    values = np.where(np.arange(1_000_000) >= 999_000, 1.0, np.nan)
    batches = np.array_split(np.arange(1_000_000), 50)
    batches = {"forwards": batches, "backwards": batches[::-1], "mixed": [batches[i] for i in np.random.default_rng(2).permutation(50)]}[order]
    f, last = follower(), None
    for batch in batches:
        event = feed(f, at[batch], values[batch])
        last = last if event is None else event
        assert sum(len(times) for _, times in f.missed.values()) < 30_000
    assert (last.na_poll_count, last.total_poll_count) == (999_000, 999_001) and last.latency_ms == 999_000_000.0


def test_any_order_gives_what_a_plain_count_gives():
    rng = np.random.default_rng(3)
    for _ in range(30):
        n = int(rng.integers(1, 60))
        at = START + rng.integers(0, 5 * BUCKET_US, n)
        at[rng.random(n) < 0.2] = at[0]
        values = np.where(rng.random(n) < 0.2, 1.0, np.nan)
        f, last, order = follower(), None, rng.permutation(n)
        for batch in np.array_split(order, int(rng.integers(1, 8))):
            if len(batch):
                event = feed(f, at[batch], values[batch])
                last = last if event is None else event
        seen = at[~np.isnan(values)]
        if not len(seen):
            assert last is None
            continue
        assert last.na_poll_count == (np.isnan(values) & (at < seen.min())).sum()
        assert last.latency_ms == (seen.min() // 1000 - START // 1000)


def test_settled_hours_are_a_number():
    """Older hours keep their count only; a value in time counts all of them, one that is too late is left out."""
    f = follower(settle_us=2 * BUCKET_US)
    at = START + np.arange(600) * 60_000_000
    for batch in np.array_split(np.arange(600), 20):
        assert feed(f, at[batch], np.full(len(batch), np.nan)) is None
        assert len(f.missed) <= 4
    assert feed(f, [START + BUCKET_US], np.array([1.0])) is None
    assert feed(f, [START + 30_000_000], np.array([np.nan])) is None
    event = feed(f, [at[-1] + 1, at[-1] - 30_000_000], np.array([1.0, 2.0]))
    assert event.na_poll_count == 600 and event.latency_ms == (at[-1] - 30_000_000 - START) // 1000


def test_a_batch_reads_and_writes_the_row_of_a_file_once():
    calls = []

    class Counted(Value):
        def __getattribute__(self, name):
            if name in ("exists", "get", "update"):
                calls.append(name)
            return super().__getattribute__(name)

    f = follower()
    row, f.file = f.file.row, Counted()
    f.file.row = row
    assert feed(f, np.array([START + 5, START + 9]), np.array([np.nan, 1.0]))["na_poll_count"] == 1
    assert calls == ["get", "update"]


class Slot:
    """The state of a slot, as Spark hands it out, and a clock."""

    exists, get, hasTimedOut, now, due = False, None, False, 0, None  # noqa: N815

    def getCurrentProcessingTimeMs(self):  # noqa: N802
        return self.now

    def update(self, row):
        self.exists, self.get = True, row

    def remove(self):
        self.exists, self.get = False, None

    def setTimeoutDuration(self, ms):  # noqa: N802
        self.due = self.now + ms


def rows_of(polls=(), manifests=()):
    """Rows of a batch, in two parts: manifests ``(file, release)`` and polls ``(file, time, value)``."""
    told = pd.DataFrame([(f, True, "t2m", 3, 3, at, False, 0, 0, None) for f, at in manifests], columns=COLUMNS)
    polls = pd.DataFrame(polls, columns=["file_id", "at_us", "value"])
    return iter([told, *reduced([polls.assign(missing=polls.pop("value").isna())])])


def test_a_call_takes_all_files_of_a_slot():
    """Many files, one of them without a name, in a call per batch: what each file alone gives, and those without rows stay."""
    rng = np.random.default_rng(4)
    files = [*map(str, range(40)), None]
    polls = [(files[k], START + int(at), v) for k, at, v in zip(
        rng.integers(0, 41, 3000), rng.integers(0, 20 * BUCKET_US, 3000), np.where(rng.random(3000) < 0.1, 1.0, np.nan), strict=True)]
    slot, follow, last = Slot(), _Follower(None), {}
    for batch in ([], *[polls[k::7] for k in range(7)], [p for p in polls if p[0] == "3"]):
        told = [] if batch else [(f, START) for f in files]
        for events in follow((0,), rows_of(batch, told), slot):
            assert events.groupby("file_id", dropna=False).size().max() == 1
            last |= {None if pd.isna(e.file_id) else e.file_id: e for e in events.itertuples()}
    for file in files[:3] + files[4:]:
        own = [(at, v) for f, at, v in polls if f == file]
        first = min(at for at, v in own if v == v)
        assert last[file].na_poll_count == sum(v != v and at < first for at, v in own)
        assert last[file].latency_ms == first // 1000 - START // 1000
    assert len(last) == 41


def test_files_of_a_slot_are_forgotten_one_by_one():
    hour = 3_600_000
    slot, follow = Slot(), _Follower(24 * hour)
    assert not list(follow((0,), rows_of([("b", START + 5, np.nan)], [("a", START), ("b", START)]), slot))
    slot.now = 20 * hour
    assert not list(follow((0,), rows_of([("b", START + 6, np.nan)]), slot))
    assert slot.due == 24 * hour
    slot.now = 25 * hour  # "a" is due, before Spark has told so
    events = next(follow((0,), rows_of([("a", START + 9, 1.0), ("b", START + 9, 1.0)]), slot))
    assert events["file_id"].tolist() == ["b"] and events["na_poll_count"].tolist() == [2]
    slot.now, slot.hasTimedOut = 49 * hour, True
    assert not list(follow((0,), iter(()), slot)) and not slot.exists
