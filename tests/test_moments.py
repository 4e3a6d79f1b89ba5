from datetime import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridspark.operators import moments, ranking, stats, store

CYCLE = datetime(2024, 1, 1)
COLUMNS = ("cycle_time timestamp, variable string, step_index int, number int, lat_start int, n_lat int, n_lon int, "
           "values array<float>, source_path string, release_ts timestamp")


def grids(spark, members=7, seed=1, n_lat=6, n_lon=5, offset=1e6):
    """Two variables in two bands each, with missing cells, a grid without valid cells, and values far from 0."""
    rng = np.random.default_rng(seed)
    rows = []
    for v, shift in (("t2m", offset), ("u10", 0.0)):
        for m in range(members):
            values = (shift + rng.normal(size=(n_lat, n_lon))).astype("f4")
            values[rng.random(values.shape) < 0.2] = np.nan
            if m == 3:
                values[:] = np.nan
            for top in (0, 4):
                part = values[top:top + 4]
                rows.append((CYCLE, v, 0, m, top, len(part), n_lon, part.ravel().tolist(), f"{v}-{m}", CYCLE))
    return spark.createDataFrame(rows, COLUMNS), rows


def test_statistics_of_a_store_read_no_grid(spark, tmp_path):
    fields, rows = grids(spark)
    path = str(tmp_path / "store")
    for odd in (0, 1):
        store.write_region(fields.where(F.col("number") % 2 == odd), path)
    found = moments.describe(store.open_moments(spark, path))
    schemas = [line for line in found._jdf.queryExecution().executedPlan().toString().split("\n") if "ReadSchema" in line]
    assert schemas and all("values" not in line for line in schemas)
    for r in found.collect():
        cells = np.array([x for row in rows if row[1] == r.variable for x in row[7]], np.float64)
        good = cells[~np.isnan(cells)]
        assert (r.n_cells, r.n) == (len(cells), len(good))
        assert (r.min, r.max) == (good.min(), good.max()) and r.nan_pct == pytest.approx(100 * (1 - len(good) / len(cells)))
        assert r.mean == pytest.approx(good.mean(), rel=1e-12) and r.std == pytest.approx(good.std(), rel=1e-9)
    all_cells = np.array([x for row in rows for x in row[7]])
    assert moments.global_mean(store.open_moments(spark, path)).first().mean == pytest.approx(np.nanmean(all_cells))
    assert moments.describe(store.open_moments(spark, path), []).first().n == np.isfinite(all_cells).sum()
    assert {r.variable: r.nan_pct for r in moments.nan_pct(store.open_moments(spark, path)).collect()} == pytest.approx(
        {r.variable: r.nan_pct for r in stats.nan_pct(store.open_store(spark, path)).collect()})


def test_a_store_without_moments_gets_them(spark, tmp_path):
    fields, _ = grids(spark)
    path = str(tmp_path / "store")
    fields.select(*store.FIELDS.names).write.partitionBy(*store.PARTITION).parquet(path)
    with pytest.raises(Exception, match="without moments"):
        moments.describe(store.open_moments(spark, path)).collect()
    before = store.open_store(spark, path).count()
    store.add_moments(spark, path)
    assert store.open_store(spark, path).count() == before
    assert moments.describe(store.open_moments(spark, path)).count() == 2


def test_no_valid_cell(spark):
    rows = spark.createDataFrame([("a", [float("nan")] * 3), ("b", None), ("c", [])], "variable string, values array<float>")
    got = {r.variable: r for r in moments.describe(rows.withColumn("moments", moments.of("values"))).collect()}
    assert (got["a"].n_cells, got["a"].n, got["a"].mean, got["a"].std) == (3, 0, None, None) and got["b"].n_cells == got["c"].n_cells == 0


def test_mean_arrays_equal_mean_cells(spark):
    fields, _ = grids(spark, offset=280.0)
    many = fields.repartition(9)
    key = ["cycle_time", "variable", "step_index", "lat_idx", "lon_idx"]
    got = {tuple(r[k] for k in key): (r["mean"], r.n_members) for r in stats.mean_cells(stats.ensemble_mean_arrays(many)).collect()}
    want = {tuple(r[k] for k in key): (r["mean"], r.n_members) for r in stats.ensemble_mean(fields).collect()}
    assert got.keys() == want.keys()
    assert all(got[k][1] == want[k][1] and got[k][0] == pytest.approx(want[k][0]) for k in want)
    plan = stats.ensemble_mean_arrays(many)._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan


def test_mean_arrays_of_full_grids(spark):
    """50 members of 361 x 720 cells, as one slot dealt over many tasks."""
    fields = spark.range(0, 50, numPartitions=10).select(
        F.lit(CYCLE).alias("cycle_time"), F.lit("t2m").alias("variable"), F.lit(0).alias("step_index"), F.lit(0).alias("lat_start"),
        F.lit(361).alias("n_lat"), F.lit(720).alias("n_lon"),
        F.transform(F.sequence(F.lit(0), F.lit(361 * 720 - 1)), lambda i: ((i % 97) + F.col("id")).cast("float")).alias("values"))
    row = stats.ensemble_mean_arrays(fields).select(F.size("mean").alias("n"), F.array_min("n_members").alias("low"), "mean").collect()
    assert len(row) == 1 and (row[0].n, row[0].low) == (361 * 720, 50)
    assert np.allclose(np.array(row[0]["mean"]), np.arange(361 * 720) % 97 + 24.5)


@pytest.mark.parametrize("buckets", [None, 3, 64])
def test_row_numbers_in_two_levels(spark, monkeypatch, buckets):
    """Also with so many buckets that blocks of them are added up, a hot value and NULLs."""
    monkeypatch.setattr(ranking, "BLOCK", 4)
    rows = spark.range(0, 5000, numPartitions=7).select("id", F.when(F.col("id") % 3 == 0, 7).when(F.col("id") % 11 > 0, F.col("id") % 50).alias("x"))
    got = {r.id: r.n for r in ranking.global_row_number(rows, ["x", "id"], "n", buckets).collect()}
    plain = sorted(((r.x is not None, r.x or 0, r.id) for r in rows.collect()))
    assert got == {i: n for n, (*_, i) in enumerate(plain)}
