import json
import os
import time
from datetime import datetime, timedelta

import pytest
from tests.grids import GRID, manifest, payload
from pyspark.sql import functions as F

from gridspark.functions.axes import StepAxis
from gridspark.operators import store
from gridspark.runtime import LOCAL_STREAM_SETTINGS, STREAM_SETTINGS
from gridspark.sources import files
from gridspark.sources.manifests import MANIFEST
from gridspark.streaming import arrivals, waiting
from gridspark.streaming.follow import follow_visibility, latest_events, run_for
from gridspark.streaming.ingest import IngestConfig, IngestManager, start_ingest

SPEC = store.StoreSpec(variables=("t2m", "u10"), members=3, n_lat=GRID[0], n_lon=GRID[1], axis=StepAxis(2, 2, 2))
ONCE = {"availableNow": True}


def collect(spark, stream, name, path):
    query = (stream.writeStream.format("parquet").option("path", str(path / name))
             .option("checkpointLocation", str(path / f"{name}_cp")).trigger(**ONCE).start())
    query.awaitTermination()
    return spark.read.parquet(str(path / name)), query


def config(landing, tmp_path, **kw):
    return IngestConfig(**{
        "landing": str(landing), "store": str(tmp_path / "store"), "checkpoint": str(tmp_path / "cp"),
        "logs": str(tmp_path / "logs"), "spec": SPEC, "trigger": ONCE, **kw})


def test_arrivals(spark, landing, tmp_path):
    rows, query = collect(spark, arrivals.arrivals(spark, str(landing), max_files=3), "a", tmp_path)
    assert rows.count() == 7 and rows.columns == ["path", "size", "modified"]
    assert [p["numInputRows"] for p in query.recentProgress if p["numInputRows"]] == [3, 3, 1] or \
        sum(p["numInputRows"] for p in query.recentProgress) == 7
    plan = query._jsq.explainInternal(False)
    assert "content" not in plan.split("ReadSchema")[-1].split("\n")[0]


def test_clean_start(spark, landing, tmp_path):
    since = datetime.utcnow() + timedelta(seconds=1)
    time.sleep(1.2)
    (landing / "late.grib2").write_bytes(payload("t2m", 0))
    rows, _ = collect(spark, arrivals.arrivals(spark, str(landing), since=since), "a", tmp_path)
    assert [r.path.rsplit("/", 1)[1] for r in rows.collect()] == ["late.grib2"]


def test_manifest_stream(spark, landing, tmp_path):
    rows, _ = collect(spark, arrivals.manifests(spark, str(landing)), "m", tmp_path)
    assert rows.count() == 9 and rows.where("corrupt").count() == 1


def test_duplicate_manifests_are_dropped(spark, landing, tmp_path):
    (landing / "again.grib2.json").write_text((landing / "t2m_0.grib2.json").read_text())
    rows, _ = collect(spark, arrivals.manifests(spark, str(landing), dedupe="1 day"), "m", tmp_path)
    good = rows.where("NOT corrupt")
    assert good.count() == 8 and good.select("file_id").distinct().count() == 8
    # One that cannot be read yet is not lost.
    assert [r.manifest_path.rsplit("/", 1)[1] for r in rows.where("corrupt").collect()] == ["half.grib2.json"]


def test_late_manifests_are_not_dropped(spark, tmp_path):
    """Manifests of any age come through, in whatever order they arrive."""
    folder = tmp_path / "late"
    folder.mkdir()
    stream = arrivals.manifests(spark, str(folder), max_files=1, dedupe="1 hour")
    for name, day in (("new", 20), ("old", 10), ("older", 1)):
        (folder / f"{name}.grib2.json").write_text(manifest(name, "t2m", 1, f"/x/{name}", f"2024-01-{day:02}T06:00:00.000Z"))
        query = (stream.writeStream.format("parquet").option("path", str(tmp_path / "out"))
                 .option("checkpointLocation", str(tmp_path / "cp")).trigger(**ONCE).start())
        query.awaitTermination()
    (folder / "copy.grib2.json").write_text((folder / "old.grib2.json").read_text())
    query = (stream.writeStream.format("parquet").option("path", str(tmp_path / "out"))
             .option("checkpointLocation", str(tmp_path / "cp")).trigger(**ONCE).start())
    query.awaitTermination()
    assert sorted(r.file_id for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["new", "old", "older"]


def test_late_manifests_make_cheap_batches(spark, tmp_path, monkeypatch):
    """Eleven batches: the files read before are not written again after ten, no file of the checkpoint is written with a second
    one for its sum, state is in no more parts than there are cores, and settings are as before afterwards."""
    from gridspark.plans import roundtrips
    from gridspark.plans.registry import Tables

    names = ("spark.sql.shuffle.partitions", *STREAM_SETTINGS, *LOCAL_STREAM_SETTINGS)
    spark.range(1100).select(
        F.col("id").alias("event_id"), F.col("id").alias("user_id"), F.lit("view").alias("event_type"), F.lit(1.0).alias("value"),
        F.timestamp_seconds(F.col("id") + 1_704_067_200).alias("ts")).write.parquet(str(tmp_path / "events.parquet"))
    monkeypatch.setattr(roundtrips, "new_dir", lambda _, label: str(tmp_path / label))
    old = spark.conf.get(names[0])
    spark.conf.set(names[0], "40")
    try:
        before = {k: spark.conf.get(k, None) for k in names}
        rows = roundtrips.late_manifests(Tables(spark, str(tmp_path))).agg(F.count("*"), F.sum("copies")).first()
        assert {k: spark.conf.get(k, None) for k in names} == before
    finally:
        spark.conf.set(names[0], old)
    assert tuple(rows) == (1100, 1100)
    checkpoint = tmp_path / "late" / "checkpoint"
    read = [p.name for p in (checkpoint / "sources" / "0").iterdir() if not p.name.startswith(".")]
    assert len(read) == 11 and not [n for n in read if n.endswith(".compact")]
    parts = [p for p in (checkpoint / "state" / "0").iterdir() if p.name.isdigit()]
    assert len(parts) == spark.sparkContext.defaultParallelism
    assert not [p for p in checkpoint.rglob("*.changelog.crc") if not p.name.startswith(".")]


@pytest.mark.parametrize("order", [[0, 1, 2, 3], [3, 2, 1, 0], [2, 0, 3, 1]])
@pytest.mark.parametrize("per_trigger", [1, 10])
def test_follower_does_not_depend_on_batches(spark, tmp_path, order, per_trigger):
    """Four polls of one file, in any order and any batches: the same last event."""
    released = datetime(2024, 1, 1, 6)
    polls, seen = tmp_path / "polls", tmp_path / "manifests"
    polls.mkdir(), seen.mkdir()
    (seen / "a.grib2.json").write_text(manifest("a", "t2m", 3, "/x/a"))
    samples = [(2, None), (5, 1.0), (9, None), (12, 2.0)]
    for n, k in enumerate(order):
        path = polls / f"{n}.json"
        path.write_text(json.dumps({"file_id": "a", "poll_ts": (released + timedelta(seconds=samples[k][0])).isoformat() + "Z", "value": samples[k][1]}))
        os.utime(path, (1_700_000_000 + n, 1_700_000_000 + n))
    stream = follow_visibility(
        arrivals.manifests(spark, str(seen)).where("NOT corrupt"),
        spark.readStream.schema("file_id string, poll_ts timestamp, value double").option("maxFilesPerTrigger", per_trigger).json(str(polls)))
    query = (stream.writeStream.format("parquet").option("path", str(tmp_path / "out"))
             .option("checkpointLocation", str(tmp_path / "cp")).trigger(**ONCE).start())
    query.awaitTermination()
    events = spark.read.parquet(str(tmp_path / "out"))
    last = latest_events(events).first()
    assert (last.latency_ms, last.na_poll_count, last.total_poll_count) == (5000.0, 1, 2)
    assert sorted(r.revision for r in events.collect()) == list(range(1, events.count() + 1))


def test_ingest_by_manifest(spark, landing, tmp_path):
    seen = []

    def on_batch(result):
        seen.append(result)
        raise RuntimeError("callback is broken")

    manager = IngestManager(spark, config(landing, tmp_path, max_files=4, publish_to=str(tmp_path / "pub")))
    assert manager.status() == {"state": "not started"} and manager.metrics() == {}
    with pytest.raises(RuntimeError):
        manager.await_termination(1)
    manager.start(on_batch=on_batch)
    assert manager.await_termination(120) and not manager.is_active
    assert manager.status()["state"] == "stopped" and manager.status()["recent_progress"]

    for place in ("store", "pub"):
        rows = store.open_store(spark, str(tmp_path / place))
        assert rows.count() == 18 and rows.where("release_ts IS NULL").count() == 0
    log = spark.read.parquet(str(tmp_path / "logs" / "write_log"))
    assert log.count() == 7 and log.where("NOT success").count() == 1
    batches = manager.batch_log()
    assert len(seen) == batches.count() >= 2
    totals = batches.agg(F.sum("files_processed"), F.sum("files_failed"), F.sum("unresolved")).first()
    assert tuple(totals) == (7, 1, 1)
    assert batches.where("publish_error IS NOT NULL").count() == 0
    metrics = manager.metrics()
    assert metrics["total_files_processed"] == 7 and metrics["total_files_failed"] == 1

    # New files later: progress is kept, only they are read.
    (landing / "new.grib2").write_bytes(payload("t2m", 0, members=1))
    (landing / "new.grib2.json").write_text(
        manifest("new", "t2m", 0, landing / "new.grib2", "2024-01-01T07:00:00.000Z"))
    manager.start()
    manager.await_termination(120)
    assert spark.read.parquet(str(tmp_path / "logs" / "write_log")).count() == 8
    assert store.open_store(spark, str(tmp_path / "store")).count() == 18


def test_replay_from_a_new_checkpoint_changes_nothing(spark, landing, tmp_path):
    start_ingest(spark, config(landing, tmp_path)).awaitTermination()
    first = {(r.variable, r.step_index, r.number, tuple(r["values"]))
             for r in store.open_store(spark, str(tmp_path / "store")).collect()}
    start_ingest(spark, config(landing, tmp_path, checkpoint=str(tmp_path / "cp2"))).awaitTermination()
    again = [(r.variable, r.step_index, r.number, tuple(r["values"]))
             for r in store.open_store(spark, str(tmp_path / "store")).collect()]
    assert set(again) == first and len(again) == 18
    # The second stream counts its batches from 0 as well, and keeps the logs of the first.
    assert spark.read.parquet(str(tmp_path / "logs" / "batch_log")).count() == 2


def test_batch_without_payload_is_logged(spark, tmp_path):
    folder = tmp_path / "landing"
    folder.mkdir()
    (folder / "gone.grib2.json").write_text(manifest("gone", "t2m", 0, folder / "gone.grib2"))
    manager = IngestManager(spark, config(folder, tmp_path))
    manager.start()
    manager.await_termination(60)
    row = manager.batch_log().first()
    assert (row.files_processed, row.unresolved, row.corrupt) == (0, 1, 0) and not (tmp_path / "store").exists()


def test_half_written_manifest_is_read_again(spark, landing, tmp_path):
    start_ingest(spark, config(landing, tmp_path)).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "logs" / "batch_log")).first().corrupt == 1
    (landing / "v.grib2").write_bytes(payload("t2m", 2))
    (landing / "half.grib2.json").write_text(manifest("half", "t2m", 2, landing / "v.grib2"))
    (landing / "next.grib2.json").write_text(manifest("next", "u10", 0, landing / "u10_0.grib2"))
    start_ingest(spark, config(landing, tmp_path)).awaitTermination()
    log = spark.read.parquet(str(tmp_path / "logs" / "write_log"))
    assert log.where("path LIKE '%/v.grib2' AND success").count() >= 1


@pytest.mark.parametrize("name", ["half", "with space", "per%20cent"])
def test_completed_manifest_is_read_though_nothing_else_arrives(spark, tmp_path, name):
    """Also one cut short several times, one that never becomes whole, and any name."""
    folder = tmp_path / "landing"
    folder.mkdir()
    (folder / "v.grib2").write_bytes(payload("t2m", 2))
    (folder / "never.grib2.json").write_text("{")
    place, whole = folder / f"{name}.grib2.json", manifest("half", "t2m", 2, folder / "v.grib2")
    seen = []
    for text in (whole[:9], whole[:40], whole, None):
        if text is not None:
            place.write_text(text)
        start_ingest(spark, config(folder, tmp_path), on_batch=seen.append).awaitTermination()
    assert [(r["files_processed"], r["corrupt"]) for r in seen] == [(0, 2), (0, 2), (1, 1)]
    assert store.open_store(spark, str(tmp_path / "store")).count() == 3
    waits = spark.read.parquet(str(tmp_path / "logs" / "waiting_manifests")).collect()
    assert [r.manifest_path.rsplit("/", 1)[1] for r in waits] == ["never.grib2.json"]


def test_completed_manifest_is_read_within_a_trigger(spark, tmp_path):
    """A running stream, a manifest completed, and no other file."""
    folder = tmp_path / "landing"
    folder.mkdir()
    (folder / "v.grib2").write_bytes(payload("t2m", 2))
    (folder / "half.grib2.json").write_text("{")
    manager = IngestManager(spark, config(folder, tmp_path, trigger={"processingTime": "500 milliseconds"}))
    manager.start()
    try:
        for done, text in ((1, None), (2, manifest("half", "t2m", 2, folder / "v.grib2"))):
            if text:
                (folder / "half.grib2.json").write_text(text)
            deadline = time.time() + 60
            while time.time() < deadline and ((rows := manager.batch_log()) is None or rows.count() < done):
                time.sleep(0.5)
        assert manager.metrics()["total_files_processed"] == 1
    finally:
        manager.stop()
    # Triggers without a change are no batches.
    assert manager.batch_log().count() == 2


def test_manifest_of_any_kind_of_damage():
    whole = json.loads(manifest("a", "t2m", 1, "/x/a"))
    assert waiting.parse(json.dumps(whole).encode()) == tuple(whole[f.name] for f in MANIFEST.fields)
    for change in ({"file_id": None}, {"forecast_hour": "1"}, {"forecast_hour": True}, {"landing_path": 5}):
        assert waiting.parse(json.dumps(whole | change).encode()) is None
    assert waiting.parse(json.dumps(whole | {"variable": None, "more": [1]}).encode())[1] is None
    assert waiting.parse(b"") is None and waiting.parse(b"[1]") is None and waiting.parse(b"\xff") is None


def test_unpublished_partitions_are_published_later(spark, landing, tmp_path):
    """A publish that fails heals with the next batch, and a rewritten partition has one copy of a slot."""
    target = tmp_path / "published"
    target.write_text("a file in the way")
    start_ingest(spark, config(landing, tmp_path, publish_to=str(target))).awaitTermination()
    target.unlink()
    for n in range(2):
        (landing / f"more{n}.grib2.json").write_text(manifest(f"more{n}", "t2m", 0, landing / "t2m_0.grib2", f"2024-01-01T07:00:0{n}.000Z"))
        start_ingest(spark, config(landing, tmp_path, publish_to=str(target))).awaitTermination()
        slots = store.open_store(spark, str(target)).groupBy("variable", "step_index", "number").count().collect()
        assert len(slots) == 18 and all(r["count"] == 1 for r in slots)


def test_publish_failure_is_reported(spark, landing, tmp_path):
    (tmp_path / "blocked").write_text("a file where a folder should be")
    start_ingest(spark, config(landing, tmp_path, publish_to=str(tmp_path / "blocked" / "x"))).awaitTermination()
    row = spark.read.parquet(str(tmp_path / "logs" / "batch_log")).first()
    assert row.publish_error and row.files_successful == 6


def test_backlog(spark, landing, tmp_path):
    manager = IngestManager(spark, config(landing, tmp_path, source="files"))
    assert manager.backlog().first().files_outstanding == 7
    manager.start()
    manager.await_termination(60)
    rest = manager.backlog().first()
    assert rest.files_outstanding == 1 and rest.bytes_outstanding == (landing / "short.grib2").stat().st_size


def test_jobs_of_a_batch(spark, landing, tmp_path):
    """Counters are taken while rows are written: a batch of good files needs no job only to count."""
    for name in ("short.grib2", "short.grib2.json", "gone.grib2.json", "half.grib2.json"):
        (landing / name).unlink()
    query = start_ingest(spark, config(landing, tmp_path, source="files"))
    query.awaitTermination()
    jobs = spark.sparkContext.statusTracker().getJobIdsForGroup(str(query.runId))
    row = spark.read.parquet(str(tmp_path / "logs" / "batch_log")).first()
    assert (row.files_processed, row.files_successful, row.files_failed, row.unresolved, row.corrupt) == (6, 6, 0, 0, 0)
    print("jobs", len(jobs))
    assert len(jobs) <= 14


def test_stop(spark, landing, tmp_path):
    manager = IngestManager(spark, config(landing, tmp_path, trigger={"processingTime": "0 seconds"}))
    manager.start()
    assert manager.is_active
    with pytest.raises(RuntimeError):
        manager.start()
    deadline = time.time() + 60
    while not manager.metrics() and time.time() < deadline:
        time.sleep(0.5)
    assert not manager.await_termination(0.1)
    manager.stop()
    assert not manager.is_active and manager.metrics()["total_files_processed"] == 7


def test_follow_visibility(spark, tmp_path):
    """Manifests and polls in several batches; a poll may come before its manifest."""
    released = datetime(2026, 1, 20, 12, 26, 37, 257000)

    def at(seconds):
        return (released + timedelta(seconds=seconds)).isoformat(timespec="milliseconds")

    polls, seen = tmp_path / "polls", tmp_path / "manifests"
    polls.mkdir(), seen.mkdir()

    def poll(n, rows):
        (polls / f"{n}.json").write_text("\n".join(
            json.dumps({"file_id": f, "poll_ts": at(s), "value": v}) for f, s, v in rows))

    for name, hour in (("a", 93), ("b", 0), ("off", 91), ("never", 2)):
        (seen / f"{name}.grib2.json").write_text(manifest(name, "t2m", hour, f"/x/{name}", at(0) + "Z"))
    poll(1, [("a", 1, None), ("a", 2, None), ("b", 1, None), ("off", 1, 5.0), ("late", 1, 4.0), ("never", 1, None)])
    stream = follow_visibility(
        arrivals.manifests(spark, str(seen)).where("NOT corrupt"),
        spark.readStream.schema("file_id string, poll_ts timestamp, value double")
        .option("maxFilesPerTrigger", 1).json(str(polls)))

    def run():
        query = (stream.writeStream.format("parquet").option("path", str(tmp_path / "out"))
                 .option("checkpointLocation", str(tmp_path / "cp")).trigger(**ONCE).start())
        query.awaitTermination()
        return {r.file_id: r for r in spark.read.parquet(str(tmp_path / "out")).collect()}

    assert run() == {}
    poll(2, [("a", 7.076, 281.5), ("a", 8, 281.6), ("b", 2, None)])
    (seen / "late.grib2.json").write_text(manifest("late", "u10", 1, "/x/late", at(0) + "Z"))
    first = run()
    assert set(first) == {"a", "late"}
    assert (first["a"].latency_ms, first["a"].step_index) == (7076.0, 91)
    assert (first["a"].na_poll_count, first["a"].total_poll_count) == (2, 3)
    assert first["late"].variable == "u10" and first["late"].na_poll_count == 0
    poll(3, [("a", 20, 1.0), ("b", 3, 1.5)])
    started = (stream.writeStream.format("noop").option("checkpointLocation", str(tmp_path / "cp3")).start())
    run_for(started, 0.2)
    assert not started.isActive
    events = run()
    assert set(events) == {"a", "b", "late"} and events["a"].latency_ms == 7076.0
    assert (events["b"].na_poll_count, events["b"].total_poll_count, events["b"].latency_ms) == (2, 3, 3000.0)


def test_listing_option_for_vanished_files(spark, landing):
    assert files.list_files(spark, str(landing), ignore_missing=True).count() == 7


def test_follower_with_expiry_runs_continuously(spark, tmp_path):
    polls, seen = tmp_path / "polls", tmp_path / "manifests"
    polls.mkdir(), seen.mkdir()
    (seen / "a.grib2.json").write_text(manifest("a", "t2m", 3, "/x/a"))
    (polls / "1.json").write_text(json.dumps({"file_id": "a", "poll_ts": "2024-01-01T06:00:09Z", "value": 1.0}))
    stream = follow_visibility(
        arrivals.manifests(spark, str(seen)).where("NOT corrupt"),
        spark.readStream.schema("file_id string, poll_ts timestamp, value double").json(str(polls)),
        forget_after_hours=24)
    query = (stream.writeStream.format("memory").queryName("expiring")
             .option("checkpointLocation", str(tmp_path / "cp")).start())
    deadline = time.time() + 40
    while time.time() < deadline and spark.table("expiring").isEmpty():
        time.sleep(0.5)
    query.stop()
    assert [(r.file_id, r.latency_ms) for r in spark.table("expiring").collect()] == [("a", 9000.0)]
