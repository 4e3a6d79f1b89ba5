"""Selections equal filtered cells; statistics equal numpy."""

from datetime import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridspark.functions.axes import cells
from gridspark.operators import selection, stats

N_LAT, N_LON, MEMBERS, STEPS = 7, 6, 3, 4
CUBE = np.random.default_rng(1).normal(280, 5, (STEPS, MEMBERS, N_LAT, N_LON)).astype("f4")
CUBE[1, :, 2, 3] = np.nan
CUBE[2, 0] = np.nan


@pytest.fixture(scope="module", params=[N_LAT, 3])
def fields(spark, request):
    """The cube with whole grids, and cut into bands of three latitudes."""
    rows = []
    for s in range(STEPS):
        for m in range(MEMBERS):
            for top in range(0, N_LAT, request.param):
                band = CUBE[s, m, top:top + request.param]
                rows.append((datetime(2024, 1, 1), "t2m", s, m, top, len(band), N_LON,
                             [float(v) for v in band.ravel()]))
    return spark.createDataFrame(
        rows, "cycle_time timestamp, variable string, step_index int, number int, lat_start int, n_lat int, "
              "n_lon int, values array<float>").cache()


def got(df):
    return {(r.step_index, r.number, r.lat_idx, r.lon_idx): r.value for r in cells(df).collect()}


def same(df, index):
    want = {i: CUBE[i] for i in index}
    have = got(df)
    assert have.keys() == want.keys()
    assert all(np.float32(have[i]) == v or (np.isnan(v) and np.isnan(have[i])) for i, v in want.items())


def grid(steps=range(STEPS), members=range(MEMBERS), lats=range(N_LAT), lons=range(N_LON)):
    return [(s, m, a, o) for s in steps for m in members for a in lats for o in lons]


def test_step_and_ranges(fields):
    same(selection.step(fields, "t2m", 1), grid([1]))
    same(selection.steps(fields, "t2m", slice(1, 3)), grid([1, 2]))
    same(selection.steps(fields, "t2m", [0, 3, 9]), grid([0, 3]))
    assert selection.step(fields, "u10", 1).count() == 0


@pytest.mark.parametrize("lat, lon", [
    (slice(0, 7), slice(0, 6)), (slice(2, 5), slice(1, 4)), (slice(3, 4), slice(5, 6)),
    (slice(5, 99), slice(4, 99)), (slice(2, None), slice(None, 2)), (slice(3, 3), slice(0, 6)),
    (slice(99, 120), slice(0, 6)), (slice(0, 7), slice(50, 60))])
def test_box(fields, lat, lon):
    lats, lons = range(N_LAT)[lat], range(N_LON)[lon]
    same(selection.box(fields, lat, lon), grid(lats=lats, lons=lons))


def test_box_of_a_box(fields):
    inner = selection.box(selection.box(fields, slice(1, 6), slice(0, 5)), slice(2, 4), slice(1, 3))
    same(inner, grid(lats=[2, 3], lons=[1, 2]))


def test_hyperslab(fields):
    picked = selection.hyperslab(fields, "t2m", slice(1, 4), [0, 2], slice(2, 6), slice(3, 5))
    same(picked, grid([1, 2, 3], [0, 2], range(2, 6), [3, 4]))


def test_point(fields, spark):
    def values(df):
        return {(r.step_index, r.number): r.value for r in df.collect()}

    whole = fields.withColumn("grid_lat", F.lit(N_LAT))
    at = values(selection.point(whole, 4, 2))
    assert {k: np.float32(v) for k, v in at.items() if k[0] != 2} == {
        (s, 0): CUBE[s, 0, 4, 2] for s in (0, 1, 3)}
    last = values(selection.point(whole, -1, -1, number=-1))
    assert np.float32(last[(0, 2)]) == CUBE[0, 2, -1, -1]
    clamped = values(selection.point(whole, 180, 360, clamp=True))
    assert np.float32(clamped[(0, 0)]) == CUBE[0, 0, -1, -1]
    assert values(selection.point(fields, 180, 360, clamp=True)).keys() == clamped.keys()
    assert np.float32(values(selection.point(fields, -2, 0))[(0, 0)]) == CUBE[0, 0, -2, 0]
    assert selection.point(whole, 180, 360).count() == 0


@pytest.mark.parametrize("mean", [stats.ensemble_mean, stats.ensemble_mean_blocks])
def test_ensemble_mean(fields, mean):
    rows = {(r.step_index, r.lat_idx, r.lon_idx): r for r in mean(fields).collect()}
    assert len(rows) == STEPS * N_LAT * N_LON
    for (s, a, o), r in rows.items():
        column = CUBE[s, :, a, o].astype("f8")
        valid = column[~np.isnan(column)]
        assert r.n_members == len(valid)
        assert r.mean is None if not len(valid) else r.mean == pytest.approx(valid.mean())


def test_statistics(fields):
    data = CUBE.astype("f8").ravel()
    valid = data[~np.isnan(data)]
    assert stats.global_mean(fields).first().mean == pytest.approx(valid.mean())
    d = stats.describe(fields).first()
    assert (d.min, d.max) == (valid.min(), valid.max())
    assert d["mean"] == pytest.approx(valid.mean()) and d["std"] == pytest.approx(valid.std())
    assert stats.nan_pct(fields).first().nan_pct == pytest.approx(np.isnan(data).mean() * 100)
    empty = stats.valid_stats(fields.where("step_index = 2 AND number = 0")).first()
    assert (empty.nan_pct, empty.data_min, empty.data_mean) == (100.0, None, None)


def test_info_and_size(fields):
    info = stats.store_info(fields).first()
    assert (info.n_steps, info.n_members, info.n_lat, info.n_lon, info.chunks) == (4, 3, 7, 6, "1x3x7x6")
    size = stats.size_estimate(fields).first()
    assert size.chunk_bytes == 3 * 42 * 4 and size.total_bytes == 4 * size.chunk_bytes


def test_size_of_the_published_store(spark):
    """50 x 361 x 720 float32 chunks: 49.58 MiB each, 580 of them in four variables 28.08 GiB."""
    rows = [("t2m", s, m, 0, 361, 720) for s in range(145) for m in range(50)]
    dims = spark.createDataFrame(
        rows, "variable string, step_index int, number int, lat_start int, n_lat int, n_lon int")
    size = stats.size_estimate(dims).first()
    assert size.chunk_bytes == 51_984_000 and round(size.chunk_mib, 2) == 49.58
    assert round(4 * size.total_gib, 2) == 28.08


def test_stack_is_ordered_and_bounded(fields):
    whole = fields.where("step_index = 0 AND lat_start = 0")
    members = stats.stack(whole, MEMBERS).first().members
    assert [m.number for m in members] == [0, 1, 2]
    with pytest.raises(Exception, match="beyond the ensemble axis"):
        stats.stack(whole, 2).collect()


def test_selection_reaches_the_scan(fields, spark, tmp_path):
    fields.write.partitionBy("cycle_time", "variable", "step_index").parquet(str(tmp_path / "s"))
    picked = selection.box(selection.step(spark.read.parquet(str(tmp_path / "s")), "t2m", 1), slice(2, 4), slice(0, 2))
    plan = picked._jdf.queryExecution().executedPlan().toString()
    scan = plan[plan.index("FileScan"):]
    assert "PartitionFilters: [isnotnull(variable" in scan and "step_index" in scan.split("PushedFilters")[0]
    assert "LessThan(lat_sta" in scan
