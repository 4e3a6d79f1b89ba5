"""Following manifests until a consumer sees their data."""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, functions as F, types as T
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from gridspark.functions.axes import StepAxis, with_step_index
from gridspark.functions.scalars import is_missing, parse_iso

EVENT = ("file_id string, variable string, forecast_hour int, step_index int, "
         "producer_release_utc timestamp, consumer_visible_utc timestamp, latency_ms double, "
         "na_poll_count long, total_poll_count long, revision int")
# Known manifest (if any), time of the earliest poll with a value (if any), number of polls
# before it, how often the file was reported, polls that are only a number, and the newest poll.
STATE = T.StructType([
    T.StructField("variable", T.StringType()),
    T.StructField("forecast_hour", T.IntegerType()),
    T.StructField("step_index", T.IntegerType()),
    T.StructField("release_us", T.LongType()),
    T.StructField("visible_us", T.LongType()),
    T.StructField("na_polls", T.LongType()),
    T.StructField("revision", T.IntegerType()),
    T.StructField("settled", T.LongType()),
    T.StructField("newest_us", T.LongType()),
])
# Polls that saw nothing, by hour: how many, and their times within the hour.
BUCKET_US = 3_600_000_000
BUCKET = T.StructType([T.StructField("bucket", T.LongType())])
MISSED = T.StructType([T.StructField("n", T.LongType()), T.StructField("times", T.BinaryType())])
# Files are dealt to so many slots by their hash. What is known of the files of a slot is kept together, as an Arrow table.
SLOTS = 256
KEPT = T.StructType([T.StructField("files", T.BinaryType())])
# What the polls of a batch come to before the shuffle: a row per file with its earliest value, and one per hour with misses.
REDUCED = ("file_id string, is_manifest boolean, variable string, forecast_hour int, step_index int, "
           "at_us bigint, seen boolean, bucket bigint, newest_us bigint, misses binary")
_COLUMNS = ["is_manifest", "variable", "forecast_hour", "step_index", "at_us", "seen", "bucket", "newest_us", "misses"]


# Steps of so many bytes are kept as they are, behind a zero that no compressed ones begin with.
PLAIN = 64


def _packed(steps: bytes) -> bytes:
    return b"\0" + steps if len(steps) <= PLAIN else zlib.compress(steps, 1)


def pack(times: np.ndarray) -> bytes:
    """Times within an hour as compressed steps; those of a regular poller take next to nothing."""
    return _packed(np.diff(np.sort(times), prepend=0).astype("<u4").tobytes())


def unpack(data: bytes) -> np.ndarray:
    steps = np.frombuffer(data, "<u4", offset=1) if data[:1] == b"\0" else np.frombuffer(zlib.decompress(data), "<u4")
    return np.cumsum(steps, dtype=np.int64)


def _size(data: bytes) -> int:
    """How many times are packed."""
    return (len(data) - 1) // 4 if data[:1] == b"\0" else len(unpack(data))


class _Value:
    """The row of a file while it is at hand."""

    def __init__(self, row: tuple | None):
        self.row = row

    def get(self) -> tuple | None:
        return self.row

    def update(self, row: tuple) -> None:
        self.row = row


class _Hours(dict):
    """Its hours."""

    containsKey, getValue = dict.__contains__, dict.__getitem__  # noqa: N815
    updateValue, removeKey, iterator = dict.__setitem__, dict.__delitem__, dict.items  # noqa: N815


class _Kept:
    """The state of one file, taken from its slot."""

    def __init__(self, row: dict | None):
        self.value = _Value(tuple(row[n] for n in STATE.names) if row else None)
        hours = zip(row["bucket"], row["n"], row["times"], strict=True) if row else ()
        self.hours = _Hours(((bucket,), (size, times)) for bucket, size, times in hours)

    def getValueState(self, *_) -> _Value:  # noqa: N802
        return self.value

    def getMapState(self, *_) -> _Hours:  # noqa: N802
        return self.hours

    def row(self, file: str | None, heard_ms: int) -> tuple:
        hours = self.hours
        return (file, *self.value.row, heard_ms, [b for b, in hours], [n for n, _ in hours.values()], [t for _, t in hours.values()])


_ARROW = {"string": pa.string(), "int": pa.int32(), "bigint": pa.int64()}
# A file of a slot: its state, when it was last heard of, and its hours.
_FILE = pa.schema([
    ("file_id", pa.string()), *[(f.name, _ARROW[f.dataType.simpleString()]) for f in STATE.fields], ("heard_ms", pa.int64()),
    ("bucket", pa.list_(pa.int64())), ("n", pa.list_(pa.int64())), ("times", pa.list_(pa.binary()))])


def _read(state: GroupState, oldest_ms: int | None) -> pa.Table:
    """The files of a slot that were heard of since ``oldest_ms``."""
    if not state.exists:
        return _FILE.empty_table()
    table = pa.ipc.open_stream(bytes(state.get[0])).read_all()
    return table if oldest_ms is None else table.filter(pa.compute.greater(table["heard_ms"], oldest_ms))


def _write(state: GroupState, table: pa.Table, forget_ms: int | None, now_ms: int) -> None:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, _FILE) as out:
        out.write_table(table.combine_chunks())
    state.update((bytearray(sink.getvalue()),))
    if forget_ms is not None:
        state.setTimeoutDuration(max(1, pa.compute.min(table["heard_ms"]).as_py() + forget_ms - now_ms))


class _Follower:
    """An event per file when its manifest and a poll with a value are known, and again when it changes.

    The answer is a function of the polls and manifests read so far and not of the batches
    they came in: the earliest poll with a value, and all polls before it. Only the hour of that
    poll is ever looked into; all others are numbers to be added.
    """

    def __init__(self, forget_ms: int | None, settle_us: int | None = None):
        self.forget_ms, self.settle_us = forget_ms, settle_us

    def init(self, handle: _Kept) -> None:
        self.file = handle.getValueState("followed", STATE, self.forget_ms)
        self.missed = handle.getMapState("missed_by_hour", BUCKET, MISSED, self.forget_ms)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        event = self.advance(key[0], (r for part in rows for r in zip(*(part[c].tolist() for c in _COLUMNS), strict=True)))
        if event:
            yield events_of([event])

    def advance(self, file: str | None, rows: Iterable[tuple]) -> tuple | None:
        """The event of a file after these rows, if it has a new one."""
        known = tuple(self.file.get() or (None, None, None, None, None, 0, 0, 0, None))
        variable, hour, step, release, visible, na_polls, revision, settled, newest = known
        closed, last = self._closed(newest), newest
        fresh, first = {}, visible
        # The rows of a file come in any order.
        for is_manifest, var, at_hour, at_step, at_us, seen, bucket, newest_us, misses in rows:
            if is_manifest:
                # The newest manifest of a file counts, whenever it is read.
                told = (int(at_us), var, int(at_hour), int(at_step))
                if release is None or told > (release, variable, hour, step):
                    release, variable, hour, step = told
                continue
            last = int(newest_us) if last is None else max(last, int(newest_us))
            if not seen:
                fresh.setdefault(int(bucket), []).append(bytes(misses))
            elif (closed is None or bucket >= closed) and (first is None or at_us < first):
                first = int(at_us)
        if first != visible:
            na_polls = settled + self._before(first)
        for bucket, packed in fresh.items():
            if first is not None and bucket * BUCKET_US >= first:
                continue
            if first is not None and (bucket + 1) * BUCKET_US > first:
                times = np.concatenate([unpack(p) for p in packed])
                packed = [pack(times[times < first - bucket * BUCKET_US])]
            n = sum(map(_size, packed))
            na_polls += n
            if closed is not None and bucket < closed:
                settled += n
            elif n:
                if self.missed.containsKey((bucket,)):
                    had, times = self.missed.getValue((bucket,))
                    n, packed = n + had, [times, *packed]
                self.missed.updateValue((bucket,), (n, packed[0] if len(packed) == 1 else pack(np.concatenate([unpack(p) for p in packed]))))
        if self._closed(last) != closed:
            settled += self._settle(self._closed(last))
        now = (variable, hour, step, release, first, na_polls)
        event = None
        if release is not None and first is not None and (revision == 0 or now != known[:6]):
            revision += 1
            event = (file, variable, hour, step, release, first, (first // 1000 - release // 1000) / 1.0, na_polls, na_polls + 1, revision)
        self.file.update((*now, revision, settled, last))
        return event

    def _closed(self, newest: int | None) -> int | None:
        """The hour before which nothing is looked into any more."""
        return None if self.settle_us is None or newest is None else (newest - self.settle_us) // BUCKET_US

    def _before(self, first: int) -> int:
        """How many of the polls kept are before ``first``; the others go."""
        n, limit = 0, first // BUCKET_US
        for (bucket,), (size, times) in list(self.missed.iterator()):
            if bucket < limit:
                n += size
                continue
            left = unpack(times) if bucket == limit else np.empty(0, np.int64)
            left = left[left < first - limit * BUCKET_US]
            if len(left):
                self.missed.updateValue((bucket,), (len(left), pack(left)))
            else:
                self.missed.removeKey((bucket,))
            n += len(left)
        return n

    def _settle(self, closed: int) -> int:
        n = 0
        for (bucket,), (size, _) in list(self.missed.iterator()):
            if bucket < closed:
                n += size
                self.missed.removeKey((bucket,))
        return n

    def __call__(self, key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        """The files of a slot, one after the other; those that have no rows are kept as they are."""
        now_ms = state.getCurrentProcessingTimeMs()
        table = _read(state, None if self.forget_ms is None else now_ms - self.forget_ms)
        rows, files, events = {}, [], []
        for part in () if state.hasTimedOut else parts:
            for file, *row in zip(part["file_id"].tolist(), *(part[c].tolist() for c in _COLUMNS), strict=True):
                rows.setdefault(file, []).append(row)
        heard = pa.array([f in rows for f in table["file_id"].to_pylist()], pa.bool_())
        known = {r["file_id"]: r for r in table.filter(heard).to_pylist()}
        for file, own in rows.items():
            kept = _Kept(known.get(file))
            self.init(kept)
            event = self.advance(file, own)
            if event:
                events.append(event)
            files.append(kept.row(file, now_ms))
        columns = zip(*files, strict=True) if files else [[]] * len(_FILE)
        touched = pa.table([pa.array(c, f.type) for c, f in zip(columns, _FILE, strict=True)], schema=_FILE)
        table = pa.concat_tables([table.filter(pa.compute.invert(heard)), touched])
        if len(table):
            _write(state, table, self.forget_ms, now_ms)
        elif state.exists:
            state.remove()
        if events:
            yield events_of(events)


def events_of(rows: list[tuple]) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=[c.split()[0] for c in EVENT.split(", ")])
    for name in ("producer_release_utc", "consumer_visible_utc"):
        out[name] = pd.to_datetime(out[name], unit="us")
    return out


def reduced(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Of the polls of a file in a batch, the earliest with a value, and by hour those before it."""
    none = np.iinfo(np.int64).max
    for batch in batches:
        file, files = pd.factorize(batch["file_id"], use_na_sentinel=False)
        files = np.array([None if pd.isna(f) else f for f in files], dtype=object)
        at, missing = batch["at_us"].to_numpy(np.int64), batch["missing"].to_numpy(bool)
        newest, first = np.full(len(files), np.iinfo(np.int64).min), np.full(len(files), none)
        np.maximum.at(newest, file, at)
        np.minimum.at(first, file[~missing], at[~missing])
        seen = np.flatnonzero(first != none)
        before = missing & (at < first[file])
        file, at = file[before], at[before]
        hour = at // BUCKET_US
        order = np.lexsort((at, hour, file))
        file, hour, at = file[order], hour[order], at[order] - hour[order] * BUCKET_US
        new = np.ones(len(at), bool)
        new[1:] = (file[1:] != file[:-1]) | (hour[1:] != hour[:-1])
        steps = np.diff(at, prepend=0)
        steps[new] = at[new]
        steps, starts = steps.astype("<u4").tobytes(), np.flatnonzero(new)
        ends = [*starts[1:].tolist(), len(at)] if len(starts) else []
        packed = [_packed(steps[4 * i:4 * j]) for i, j in zip(starts.tolist(), ends, strict=True)]
        file, hour = file[starts], hour[starts]
        yield pd.DataFrame({
            "file_id": np.concatenate([files[seen], files[file]]), "is_manifest": False, "variable": None, "forecast_hour": 0, "step_index": 0,
            "at_us": np.concatenate([first[seen], np.zeros(len(file), np.int64)]), "seen": np.arange(len(seen) + len(file)) < len(seen),
            "bucket": np.concatenate([first[seen] // BUCKET_US, hour]), "newest_us": np.concatenate([newest[seen], newest[file]]),
            "misses": [None] * len(seen) + packed})


def follow_visibility(manifests: DataFrame, polls: DataFrame, axis: StepAxis = StepAxis(),
                      forget_after_hours: float | None = None, settle_after_hours: float | None = None) -> DataFrame:
    """Stream of visibility events from a manifest stream and a stream of poll samples.

    ``polls(file_id, poll_ts, value)``: a missing value is a poll that saw nothing yet.
    Hours off the axis are skipped, and so are polls without a time. If an earlier poll or a newer manifest is read after a
    file was reported, it is reported again with the next ``revision``: the last one
    (``latest_events``) does not depend on the order or the batches in which files came.

    Polls after the earliest value of their batch are dropped before the shuffle; the others of a batch are a row per
    file and hour. State is a row per file, with an entry for every hour with polls before its earliest value: their number
    and compressed times. It is kept by slots, and a batch writes the slots whole that it has a file of. With ``settle_after_hours``, hours that are so much older than the file's
    newest poll become a number, so that the state of a file that is polled for ever stays small: a value that is read
    later than that is left out. A query that runs for ever should give ``forget_after_hours``: a file that nothing was heard of for
    that long is forgotten. It needs a continuous trigger, as its clock keeps ``availableNow`` busy.
    """
    forget_ms = None if forget_after_hours is None else int(forget_after_hours * 3_600_000)
    settle_us = None if settle_after_hours is None else int(settle_after_hours * BUCKET_US)
    known = with_step_index(manifests, axis).where(F.col("step_index").isNotNull())
    left = known.select(
        "file_id", F.lit(True).alias("is_manifest"), "variable", "forecast_hour", "step_index",
        F.unix_micros(parse_iso("producer_release_utc")).alias("at_us"), F.lit(False).alias("seen"), F.lit(0).cast("long").alias("bucket"),
        F.lit(0).cast("long").alias("newest_us"), F.lit(None).cast("binary").alias("misses")).where("at_us IS NOT NULL")
    samples = polls.where(F.col("poll_ts").isNotNull()).select(
        "file_id", F.unix_micros("poll_ts").alias("at_us"), is_missing("value").alias("missing"))
    # A call of a Python function takes milliseconds, and so does each look at transformWithStateInPandas' state: a call is for many files.
    rows = left.unionByName(samples.mapInPandas(reduced, REDUCED)).withColumn("slot", F.pmod(F.xxhash64("file_id"), F.lit(SLOTS)).cast("int"))
    return rows.groupBy("slot").applyInPandasWithState(
        _Follower(forget_ms, settle_us).__call__, EVENT, KEPT, "append",
        GroupStateTimeout.NoTimeout if forget_ms is None else GroupStateTimeout.ProcessingTimeTimeout)


def latest_events(events: DataFrame) -> DataFrame:
    """The last revision of every file's event, combined before the shuffle."""
    rest = [c for c in events.columns if c not in ("file_id", "revision")]
    last = F.max(F.struct("revision", *rest)).alias("_e")
    return events.groupBy("file_id").agg(last).select("file_id", *[f"_e.{c}" for c in rest], "_e.revision")


def run_for(query: StreamingQuery, max_runtime_seconds: float) -> None:
    """Let a follower run for at most that long, and stop it."""
    if not query.awaitTermination(max_runtime_seconds):
        query.stop()
