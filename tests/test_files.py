"""Listings, manifests, decoding, references, publishing, conversion, reports."""

import base64
import io
import json

import numpy as np
import pytest
from tests.grids import GRID, field, header, manifest, payload
from pyspark.sql import functions as F

from gridspark.functions.axes import StepAxis
from gridspark.operators import joins, publish, store
from gridspark.sinks import convert, reports
from gridspark.sources import files, ingest, logs, manifests, refs
from gridspark.sources.messages import Message
from gridspark.streaming.ingest import run_batch

SPEC = store.StoreSpec(variables=("t2m", "u10"), members=3, n_lat=GRID[0], n_lon=GRID[1], axis=StepAxis(2, 2, 2))


def good(spark, landing):
    return files.list_files(spark, str(landing)).where(~F.col("path").rlike(r"/(short|empty)\.grib2$"))


def everything(spark, landing):
    """Paths as manifests name them: a listing by Spark leaves out files of length 0."""
    return spark.createDataFrame([(str(p),) for p in sorted(landing.glob("*.grib2"))], "path string")


# -- listings and manifests ---------------------------------------------------------

def test_listing(spark, landing):
    (landing / "x.GRB2").write_bytes(b"1")
    (landing / "deep").mkdir()
    (landing / "deep" / "y.grb").write_bytes(b"12")
    names = {r.path.rsplit("/", 1)[1]: r["size"] for r in files.list_files(spark, str(landing)).collect()}
    assert "y.grb" in names and "t2m_0.grib2" in names and "t2m_0.grib2.json" not in names
    assert "empty.grib2" not in names
    relative = files.relative_to(files.list_files(spark, str(landing)), str(landing))
    assert relative.where("path = 'deep/y.grb'").count() == 1


def test_manifests_tolerate_half_written_ones(spark, landing):
    rows = manifests.read_manifests(spark, str(landing))
    assert rows.count() == 9
    assert manifests.readable(rows).count() == 8
    assert [r.manifest_path.rsplit("/", 1)[1] for r in manifests.quarantine(rows).collect()] == ["half.grib2.json"]


def test_resolve_and_missing(spark, landing):
    known = manifests.readable(manifests.read_manifests(spark, str(landing)))
    listing = files.list_files(spark, str(landing)).withColumn("path", F.regexp_replace("path", "^file:", ""))
    assert joins.resolve(known, listing).count() == 7
    assert [r.file_id for r in joins.missing(known, listing).collect()] == ["gone"]


def test_manifests_written_one_per_file(spark, landing, tmp_path):
    out = str(tmp_path / "out")
    rows = manifests.readable(manifests.read_manifests(spark, str(landing)))
    assert manifests.write_manifests(rows, out).collect() and len(list((tmp_path / "out").iterdir())) == 8
    back = manifests.read_manifests(spark, out)
    names = manifests.MANIFEST.names
    assert back.select(*names).exceptAll(rows.select(*names)).count() == 0
    text = next((tmp_path / "out").glob("t2m_step002*")).read_text()
    assert text.startswith('{\n  "file_id"') and json.loads(text)["forecast_hour"] == 2
    assert next((tmp_path / "out").glob("t2m_step002*")).name == \
        "t2m_step002_emit-20240101T060000.000Z_id-t2m2.grib2.json"


def test_latest_manifest_and_dedupe(spark):
    rows = spark.createDataFrame(
        [("a", "2024-01-01T00:00:01.000Z", "m1", 1), ("a", "2024-01-01T00:00:02.000Z", "m2", 2), ("b", "", "m3", 3)],
        "file_id string, producer_release_utc string, manifest_path string, v int")
    assert {r.file_id: r.v for r in manifests.latest_manifest(rows).collect()} == {"a": 2, "b": 3}
    assert manifests.dedupe(rows.unionByName(rows)).count() == 3


# -- decoding --------------------------------------------------------------------------

def test_decode(spark, landing):
    rows = ingest.decode_files(good(spark, landing)).collect()
    assert len(rows) == 6 * 3
    for r in rows:
        assert r.error is None and r.n_members == 3 and (r.n_lat, r.n_lon) == GRID
        assert r["values"] == [float(v) for v in field(r.variable, r.forecast_hour, r.number)]
        assert r.cycle_time.hour == 6 and r.valid_time.hour == 6 + r.forecast_hour


def test_bad_files_are_rows(spark, landing):
    rows = ingest.decode_files(everything(spark, landing)).where("error IS NOT NULL").collect()
    assert {r.source_path.rsplit("/", 1)[1]: r.error for r in rows}.keys() == {"short.grib2", "empty.grib2"}
    assert any("cut short" in r.error for r in rows) and any("no message" in r.error for r in rows)


def test_bands(spark, landing):
    rows = ingest.decode_files(good(spark, landing), bands=3).where("variable = 'u10' AND forecast_hour = 1")
    parts = {(r.number, r.lat_start): r["values"] for r in rows.collect()}
    assert {k[1] for k in parts} == {0, 3}
    assert parts[(2, 0)] + parts[(2, 3)] == [float(v) for v in field("u10", 1, 2)]


def test_member_from_metadata(spark, tmp_path):
    first, second = payload("t2m", 0)[:len(payload("t2m", 0)) // 3], payload("t2m", 0)[len(payload("t2m", 0)) // 3:]
    (tmp_path / "t.grib2").write_bytes(second + first)
    listing = files.list_files(spark, str(tmp_path))
    by_position = {r.number: r["values"][0] for r in ingest.decode_files(listing).collect()}
    by_number = {r.number: r["values"][0] for r in ingest.decode_files(listing, member_from="metadata").collect()}
    assert by_position == {0: 20.0, 1: 40.0, 2: 0.0} and by_number == {0: 0.0, 1: 20.0, 2: 40.0}


def test_metadata_only(spark, landing):
    rows = ingest.decode_metadata(good(spark, landing)).collect()
    assert len(rows) == 6 and all(r.ensemble_member == 0 and r.n_ensemble == 3 for r in rows)
    assert {(r.variable, r.forecast_hour) for r in rows} == {(v, h) for v in ("t2m", "u10") for h in range(3)}


def test_raw_decoder_takes_the_shape_from_the_row(spark, tmp_path):
    (tmp_path / "a.grib2").write_bytes(b"".join(field("t2m", 1, m).tobytes() for m in range(2)))
    (tmp_path / "b.grib2").write_bytes(b"\0" * 30)
    listing = files.list_files(spark, str(tmp_path)).withColumns({
        "Nj": F.lit(GRID[0]), "Ni": F.lit(GRID[1]), "shortName": F.lit("2t"), "step": F.lit(1),
        "dataDate": F.lit(20240101), "dataTime": F.lit(0)})
    rows = ingest.decode_files(listing, "raw")
    assert [r["values"][0] for r in rows.where("error IS NULL").orderBy("number").collect()] == [100.0, 120.0]
    assert rows.where("error IS NOT NULL AND variable IS NULL OR error LIKE '%no multiple%'").count() == 1


def test_own_decoder(spark, landing):
    described = header("t2m", 0, 0, 1) | {"Nj": 1, "Ni": 2}

    def zeros(file, size, context):
        yield Message(described, 0, 8)

    rows = ingest.decode_files(good(spark, landing), zeros)
    assert rows.count() == 6 and rows.where("n_lat = 1 AND n_lon = 2 AND error IS NULL").count() == 6


def test_batch_isolates_failures(spark, landing, tmp_path):
    (landing / "far.grib2").write_bytes(payload("t2m", 77))
    (landing / "other.grib2").write_bytes(payload("zz", 0))
    (landing / "big.grib2").write_bytes(payload("t2m", 0, members=4))
    path = str(tmp_path / "store")
    log = {r.path.rsplit("/", 1)[1]: r for r in run_batch(everything(spark, landing), path, SPEC).collect()}
    assert len(log) == 11
    assert {n for n, r in log.items() if not r.success} == {
        "far.grib2", "other.grib2", "big.grib2", "short.grib2", "empty.grib2"}
    assert log["far.grib2"].error == "forecast hour 77 not in step mapping" and log["far.grib2"].step_index == -1
    assert log["big.grib2"].error == "ensemble size 4 for 3 slots"
    assert log["u10_2.grib2"].n_members == 3 and log["u10_2.grib2"].step_index == 2
    assert store.open_store(spark, path).count() == 18


def test_partial_ensemble_is_written(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "t.grib2").write_bytes(payload("t2m", 0, members=2))
    path = str(tmp_path / "store")
    assert run_batch(files.list_files(spark, str(tmp_path / "in")), path, SPEC).first().success
    assert store.open_store(spark, path).count() == 2


def test_user_processor(spark, landing, tmp_path):
    path = str(tmp_path / "store")
    log = run_batch(good(spark, landing), path, SPEC, process=lambda d: d.where("variable = 't2m'"))
    assert log.count() == 3 and store.open_store(spark, path).count() == 9


# -- references -------------------------------------------------------------------------

def test_index_and_read_back(spark, landing):
    indexed = refs.index_files(everything(spark, landing), inline_threshold=50)
    summary = {r.ref_set.rsplit("/", 1)[1]: r for r in refs.index_summary(indexed).collect()}
    assert not summary["short.grib2"].success and not summary["empty.grib2"].success
    assert summary["t2m_0.grib2"].success and summary["t2m_0.grib2"].n_refs == 6
    combined = refs.combine(indexed)
    assert combined.where("variable = 'shape'").count() == 1
    assert combined.agg(F.max("concat_index")).first()[0] == 5
    got = refs.open_refs(combined, "u10").orderBy("concat_index", "chunk_key").collect()
    want = [list(map(float, field("u10", h, m))) for h in range(3) for m in range(3)]
    assert [r["values"] for r in got] == want and all(r.length == 80 for r in got)


def test_short_entries_are_inline(spark, landing):
    indexed = refs.index_files(good(spark, landing), inline_threshold=100).where("variable = 't2m'")
    assert indexed.where("path IS NOT NULL").count() == 0
    assert refs.open_refs(indexed).agg(F.sum(F.size("values"))).first()[0] == 9 * 20


def test_identical_dims(spark, landing):
    indexed = refs.index_files(good(spark, landing))
    assert refs.check_identical(indexed, ["shape"]).first().identical
    steps = refs.check_identical(indexed, ["step"]).first()
    assert not steps.identical and steps.n_sets == 6


def test_reference_json(spark, landing, tmp_path):
    folder = tmp_path / "refs"
    folder.mkdir()
    raw = str(tmp_path / "raw.bin")
    (tmp_path / "raw.bin").write_bytes(np.arange(10, dtype="<f4").tobytes())
    one = base64.b64encode(np.array([7], "<f4").tobytes()).decode()
    for name, offset in (("b", 8), ("a", 0), ("master", 4)):
        (folder / f"{name}.json").write_text(json.dumps({"version": 1, "refs": {
            ".zgroup": "{}", "t2m/0.0": [raw, offset, 8], "x/0": f"base64:{one}"}}))
    loaded = refs.load_json(spark, str(folder))
    assert loaded.count() == 6 and loaded.where("ref_set LIKE '%master%'").count() == 0
    opened = refs.open_refs(refs.open_many(spark, str(folder)).where("variable IN ('t2m', 'x')"))
    assert {(r.concat_index, r.variable): r["values"] for r in opened.collect()} == {
        (0, "t2m"): [0.0, 1.0], (1, "t2m"): [2.0, 3.0], (0, "x"): [7.0], (1, "x"): [7.0]}
    single = refs.load_json(spark, str(folder / "master.json"))
    assert refs.open_refs(single, "t2m").first()["values"] == [1.0, 2.0]
    round_trip = refs.parse_entries(refs.to_json(single))
    assert round_trip.select(*single.columns).exceptAll(single).count() == 0


def test_reference_json_is_read_a_part_at_a_time(monkeypatch):
    """Whatever the part, the same entries; and no more text is held than the longest entry asks for."""
    entries = {"a/0": ["/x y.bin", 0, 12], "quote\" /0": 'te"xt, [1, 2] }', "long": "base64:" + "A" * 3000, "n": 17, "u": "\u00e9\u4e00\U0001f600", "o": {"k": [1, {}]}, "": ""}
    want = [(k, v if isinstance(v, str) else json.dumps(v, separators=(",", ":"))) for k, v in entries.items()]
    for form in ({}, {"indent": 2}, {"ensure_ascii": False}):
        text = json.dumps({"version": 1, "templates": {"refs": {"not": "these"}}, "refs": entries, "gen": []}, **form).encode()
        for size in (1, 2, 7, 100, 1 << 20):
            monkeypatch.setattr(refs, "TEXT_AT_ONCE", size)
            assert list(refs.entries_of(io.BytesIO(text))) == want
    for bad in (b'{"refs": {"a": "b"', b'{"refs": {"a" "b"}}', b"no json", b'{"refs": {"a": "b"} "c": 1}'):
        with pytest.raises(ValueError):
            list(refs.entries_of(io.BytesIO(bad)))
    assert list(refs.entries_of(io.BytesIO(b'{"refs": {}}'))) == list(refs.entries_of(io.BytesIO(b'{"refs": null, "x": 1}'))) == []


def test_many_references_in_one_file(spark, tmp_path):
    (tmp_path / "big.json").write_text(json.dumps({"refs": {f"v/{i}": ["/raw.bin", 4 * i, 4] for i in range(200_000)}}))
    loaded = refs.load_json(spark, str(tmp_path / "big.json"))
    assert tuple(loaded.selectExpr("count(*)", "max(offset)", "count(DISTINCT chunk_key)").first()) == (200_000, 799_996, 200_000)
    (tmp_path / "cut.json").write_text('{"refs": {"a": "b", ')
    with pytest.raises(Exception, match="cut.json is no reference file"):
        refs.load_json(spark, str(tmp_path / "cut.json")).collect()


def test_range_beyond_the_file_fails(spark, tmp_path):
    (tmp_path / "raw.bin").write_bytes(b"\0" * 8)
    bad = spark.createDataFrame([("s", "v", "v/0", str(tmp_path / "raw.bin"), 4, 8, None)],
                                "ref_set string, variable string, chunk_key string, path string, offset long, "
                                "length long, inline string")
    with pytest.raises(Exception, match="ends before"):
        refs.open_refs(bad).collect()


# -- publishing ----------------------------------------------------------------------------

def listing(spark, root):
    return files.relative_to(files.list_files(spark, str(root), "*"), str(root))


def test_publish(spark, tmp_path):
    src, dst = tmp_path / "src", tmp_path / "dst"
    for name, text in (("a=1 x/f.parquet", "one"), ("a=2/f.parquet", "two"), ("a=3/g.txt", "three")):
        (src / name).parent.mkdir(parents=True)
        (src / name).write_text(text)
    dst.mkdir()
    (dst / "old.parquet").write_text("old")

    def actions(**kw):
        return {r.path: r.action for r in publish.plan(listing(spark, src), listing(spark, dst), **kw).collect()}

    assert actions() == {"a=1 x/f.parquet": "new", "a=2/f.parquet": "new", "a=3/g.txt": "new", "old.parquet": "extra"}
    assert actions(include="*.parquet;*.nc", delete=True)["old.parquet"] == "delete"
    assert "a=3/g.txt" not in actions(exclude="*.txt")
    dry = publish.incremental(listing(spark, src), listing(spark, dst), str(src), str(dst), dry_run=True)
    assert dry.count() == 3 and not (dst / "a=2").exists()
    log = publish.incremental(listing(spark, src), listing(spark, dst), str(src), str(dst))
    assert log.where("success").count() == 3 and (dst / "a=1 x/f.parquet").read_text() == "one"
    assert (dst / "old.parquet").exists() and set(actions().values()) == {"same", "extra"}
    (src / "a=2/f.parquet").write_text("twenty")
    assert actions()["a=2/f.parquet"] == "changed"
    log = publish.incremental(listing(spark, src), listing(spark, dst), str(src), str(dst), delete=True)
    assert {r.path: r.action for r in log.collect()} == {"a=2/f.parquet": "changed", "old.parquet": "delete"}
    assert (dst / "a=2/f.parquet").read_text() == "twenty" and not (dst / "old.parquet").exists()
    assert not list(dst.rglob("_part.*"))


def test_publish_isolates_failures(spark, tmp_path):
    plan = spark.createDataFrame([("gone", "new", 1)], "path string, action string, size long")
    row = publish.apply(plan, str(tmp_path / "src"), str(tmp_path / "dst")).first()
    assert not row.success and row.error


# -- conversion and reports ----------------------------------------------------------------

def test_convert_individual(spark, landing, tmp_path):
    out = str(tmp_path / "out")
    status = {r.source_path.rsplit("/", 1)[1]: r.success for r in
              convert.individual(everything(spark, landing), out).collect()}
    assert status == {**{f"{v}_{h}.grib2": True for v in ("t2m", "u10") for h in range(3)},
                      "short.grib2": False, "empty.grib2": False}
    one = spark.read.parquet(out).where("source_name = 'u10_1'")
    assert one.count() == 3 and one.select("valid_hours").first()[0] == 473352 + 7


@pytest.mark.parametrize("layout", ["time", "ensemble"])
def test_convert_stacked(spark, landing, tmp_path, layout):
    out = str(tmp_path / "out")
    for _ in range(2):
        convert.stacked(files.list_files(spark, str(landing)), out, layout=layout)
    rows = spark.read.parquet(out)
    assert rows.count() == 18
    assert {(r.concat_index, r.variable, r.forecast_hour) for r in rows.collect()} == {
        (3 * i + h, v, h) for i, v in enumerate(("t2m", "u10")) for h in range(3)}


def test_logs_round_trip(spark, tmp_path):
    events = spark.createDataFrame(
        [("a", "t2m", 1, 1, "2026-01-20T12:26:37.257Z", "2026-01-20T12:26:44.333Z", 7076.0, 7, 8)], logs.VISIBILITY)
    reports.write_jsonl(events, str(tmp_path / "j"))
    assert logs.read_jsonl(spark, str(tmp_path / "j")).collect() == events.collect()
    for part in ("x_1", "x_2"):
        reports.write_csv(events, str(tmp_path / part))
    back = logs.read_csv(spark, str(tmp_path / "x_*"))
    assert back.count() == 2 and dict(back.dtypes)["latency_ms"] == "double"


def test_report_keeps_every_row(spark, tmp_path):
    tests = spark.range(100).withColumn("case", F.col("id") % 2)
    reports.write_report(tests.groupBy("case").count(), tests, str(tmp_path / "r"), ["case"])
    assert spark.read.json(str(tmp_path / "r" / "summary")).count() == 2
    assert spark.read.json(str(tmp_path / "r" / "tests" / "case=1")).count() == 50


def test_manifest_helper_is_pretty_printed():
    assert manifest("a", "t2m", 1, "/x").count("\n") == 8


def test_reference_files_are_written_by_tasks(spark, tmp_path, monkeypatch):
    """A file per payload file, without a Spark writer per folder and without their names in the driver."""
    from gridspark.plans import roundtrips
    from gridspark.plans.registry import Tables

    spark.createDataFrame([(v, [float(v)] * 64, v % 3) for v in range(120)], "vec_id long, embedding array<float>, label int").write.parquet(
        f"{tmp_path}/embeddings.parquet")
    counts, put = [], roundtrips.put_texts
    monkeypatch.setattr(roundtrips, "put_texts", lambda files: counts.append(put(files)) or counts[-1])
    rows = roundtrips.reference_json_round_trip(Tables(spark, str(tmp_path))).collect()
    assert counts == [9] and sum(r.n_refs for r in rows) == 120 and sum(r.n_bytes for r in rows) == 120 * 256
    assert sorted(r.concat_index for r in rows) == list(range(9))
