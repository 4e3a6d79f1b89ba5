import math
from datetime import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridspark.functions.axes import nearest_index
from gridspark.operators import selection, stats, store


def brute(axis, value, circle=None):
    if value is None or math.isnan(value) or not len(axis):
        return None
    if circle:
        start = min(axis[0], axis[-1])
        value = start + (value - start) % circle
    apart = [min(abs(a - value), circle - abs(a - value)) if circle else abs(a - value) for a in axis]
    return apart.index(min(apart))


RNG = np.random.default_rng(6)
UNEVEN = np.unique(RNG.normal(scale=40, size=37).round(3)).tolist()
AXES = {"up": [float(x) for x in range(-90, 91, 3)], "down": [90 - 0.5 * i for i in range(361)], "uneven": UNEVEN, "uneven down": UNEVEN[::-1],
        "one": [7.0], "two": [1.0, 2.0], "none": []}


@pytest.mark.parametrize("name", list(AXES))
def test_nearest_value_of_any_axis(spark, name):
    axis = AXES[name]
    values = [*RNG.uniform(-120, 120, 200).tolist(), *axis, None, float("nan"), 1.5, 1e6, -1e6]
    if len(axis) > 1:
        values += [(a + b) / 2 for a, b in zip(axis, axis[1:], strict=False)][:20]
    rows = spark.createDataFrame([(i, v, axis) for i, v in enumerate(values)], "id int, v double, axis array<double>")
    got = {r.id: r.i for r in rows.select("id", nearest_index(F.col("axis"), F.col("v")).alias("i")).collect()}
    assert got == {i: brute(axis, v) for i, v in enumerate(values)}


@pytest.mark.parametrize("axis", [[0.5 * i for i in range(720)], [-180.0 + i for i in range(360)], [10.0, 30.0, 200.0, 330.0], [300.0, 200.0, 20.0]])
def test_nearest_value_on_a_circle(spark, axis):
    values = [*RNG.uniform(-800, 800, 300).tolist(), 359.9, 0.0, -0.1, 720.0]
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "id int, v double")
    found = rows.select("id", nearest_index(F.array(*[F.lit(a) for a in axis]), F.col("v"), 360.0).alias("i")).collect()
    assert {r.id: r.i for r in found} == {i: brute(axis, v, 360.0) for i, v in enumerate(values)}


def test_selection_by_degrees(spark, tmp_path):
    """Stored coordinates, bands, several points in one cell, a point beyond the grid, the last member of the axis."""
    lat, lon = [60.0, 50.0, 45.0, 10.0, -20.0], [0.0, 90.0, 180.0, 270.0]
    grid = np.arange(20, dtype="f4").reshape(5, 4)
    rows = [(datetime(2024, 1, 1), "t2m", 0, m, top, n, 4, (grid[top:top + n] + 100 * m).ravel().tolist(), "a", None) for m in (0, 2) for top, n in ((0, 3), (3, 2))]
    fields = spark.createDataFrame(rows, "cycle_time timestamp, variable string, step_index int, number int, lat_start int, n_lat int, n_lon int, "
                                         "values array<float>, source_path string, release_ts timestamp")
    path = str(tmp_path / "store")
    store.write_region(fields, path)
    store.save_axes(spark.createDataFrame([(lat, lon)], "latitude array<double>, longitude array<double>"), path)
    axes = store.open_axes(spark, path)
    assert store.open_store(spark, path).count() == 4  # the coordinates are no fields
    points = spark.createDataFrame([("a", 47.6, 359.0), ("b", 47.4, -1.0), ("c", 99.0, 135.1), ("d", -80.0, 100.0), ("e", None, 1.0), ("f", 46.0, 1.0)],
                                   "name string, latitude double, longitude double")
    got = {(r.name, r.number): r.value for r in selection.at_points(store.open_store(spark, path), points, axes).collect()}
    want = {"a": grid[1, 0], "b": grid[2, 0], "c": grid[0, 2], "d": grid[4, 1], "f": grid[2, 0]}
    assert got == {(k, m): v + 100 * m for k, v in want.items() for m in (0, 2)}
    assert [r.value for r in selection.nearest(store.open_store(spark, path), axes, 11.0, 260.0, 2).collect()] == [grid[3, 3] + 200]
    assert selection.nearest(store.open_store(spark, path), axes, 11.0, 260.0, -1, members=4).count() == 0
    assert [r.number for r in selection.nearest(store.open_store(spark, path), axes, 11.0, 260.0, -2, members=4).collect()] == [2]
    seen = stats.verify(store.open_store(spark, path), axes=axes).first()
    assert (seen.lat_first, seen.lat_last, seen.lon_first, seen.lon_last) == (60.0, -20.0, 0.0, 270.0)
    short = store.open_store(spark, path).where("lat_start = 0")
    assert stats.verify(short, axes=axes).first().lat_last == 45.0
