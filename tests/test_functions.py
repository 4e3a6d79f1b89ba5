from datetime import datetime

import pytest
from pyspark.sql import functions as F

from gridspark.functions import axes, chunking, naming, scalars
from gridspark.functions.axes import StepAxis


@pytest.fixture
def one(spark):
    def value(column):
        return spark.range(1).select(column.alias("v")).first()["v"]
    return value


def test_default_step_axis(one, spark):
    hours = one(StepAxis().column())
    assert len(hours) == 145
    assert hours[:5] == [0, 1, 2, 3, 4] and hours[90:95] == [90, 93, 96, 99, 102]
    assert hours[109] == 150 and hours[144] == 360
    index = {r.forecast_hour: r.step_index for r in StepAxis().table(spark).collect()}
    assert (index[0], index[90], index[93]) == (0, 90, 91)
    assert 91 not in index


def test_short_axes(one):
    assert one(StepAxis(2, 2, 2).column()) == [0, 1, 2]
    assert one(StepAxis(0, 6, 12).column()) == [0, 3, 6, 12]


def test_step_lookup_keeps_misses(spark):
    df = spark.createDataFrame([(90,), (91,), (93,)], "forecast_hour int")
    rows = {r.forecast_hour: r.step_index for r in axes.with_step_index(df).collect()}
    assert rows == {90: 90, 91: None, 93: 91}


def test_linspace(one):
    lat, lon = one(axes.linspace(90, -90, 361)), one(axes.linspace(0, 359.5, 720))
    assert len(lat) == 361 and lat[0] == 90 and lat[-1] == -90 and lat[1] == 89.5
    assert len(lon) == 720 and lon[-1] == 359.5 and lon[1] == 0.5
    assert one(axes.linspace(7, 9, 1)) == [7.0]


def test_grid_description(spark):
    row = axes.describe_grid(axes.coordinates(spark)).first()
    assert (row.n_lat, row.n_lon, row.lat_increment, row.lon_increment) == (361, 720, 0.5, 0.5)
    assert row.lat_descending


def test_times(one):
    assert one(scalars.floor_cycle(F.lit("2024-01-01 11:59:59"))) == datetime(2024, 1, 1, 6)
    assert one(scalars.grib_time(F.lit(20251231), F.lit(1830))) == datetime(2025, 12, 31, 18, 30)
    assert one(scalars.valid_time(F.lit("2024-01-01").cast("timestamp"), F.lit(360))) == datetime(2024, 1, 16)
    assert one(scalars.epoch_hours(F.lit("1970-01-02 03:00:00"))) == 27.0
    assert one(scalars.from_epoch_hours(F.lit(27.5))) == datetime(1970, 1, 2, 3, 30)
    assert one(scalars.iso_ms(F.lit("2026-01-20 12:26:37.2579"))) == "2026-01-20T12:26:37.257Z"


def test_latency(one):
    start = scalars.parse_iso(F.lit("2026-01-20T12:26:37.257Z"))
    end = scalars.parse_iso(F.lit("2026-01-20T12:26:44.333Z"))
    assert one(scalars.latency_ms(start, end)) == 7076.0


def test_missing_values(one):
    assert one(scalars.is_missing(F.lit(float("nan")))) is True
    assert one(scalars.is_missing(F.lit(None).cast("double"))) is True
    assert one(scalars.is_missing(F.lit(0.0))) is False
    assert one(scalars.member_index(F.lit(0))) is None
    assert one(scalars.member_index(F.lit(1))) == 0


def test_throughput_is_ratio_of_sums(spark):
    df = spark.createDataFrame([(10.0, 1000.0), (10.0, 3000.0)], "mb double, ms double")
    assert df.agg(scalars.throughput("mb", "ms").alias("v")).first().v == 5.0
    assert df.where("false").agg(scalars.throughput("mb", "ms").alias("v")).first().v == 0.0


def test_emit_name_and_both_encodings(one):
    name = one(naming.emit_name(F.lit("t2m"), F.lit(3), F.lit("2025-12-23T14:00:33.123Z"), F.lit("ab1")))
    assert name == "t2m_step003_emit-20251223T140033.123Z_id-ab1.grib2"
    for text in (name, name.replace(".123Z", "123Z"), f"/x/{name}.json"):
        parsed = one(naming.parse_emit_name(F.lit(text)))
        assert parsed.asDict() == {"variable": "t2m", "forecast_hour": 3, "file_id": "ab1",
                                   "producer_release_utc": "2025-12-23T14:00:33.123Z"}
    assert one(naming.parse_emit_name(F.lit("t2m.grib2"))) is None


@pytest.mark.parametrize("cf, short, want", [
    ("u100", "10u", "u100"), ("unknown", "10u", "u10"), (None, "2t", "t2m"), (None, "zz", "zz"), ("", "sp", "sp")])
def test_cf_name(one, cf, short, want):
    assert one(naming.cf_name(F.lit(cf).cast("string"), F.lit(short))) == want


@pytest.mark.parametrize("path, want", [
    ("/Volumes/c/s/v/a/b", ("c.s.v", "a/b")), ("/volumes/c/s/v/", ("c.s.v", None)), ("/Volumes/c/s", None),
    ("/mnt/c/s/v", None)])
def test_volume_path(one, path, want):
    got = one(naming.parse_volume(F.lit(path)))
    assert (got if got is None else tuple(got)) == want


def test_storage_url(one):
    got = one(naming.parse_storage(F.lit("abfss://box@acc.dfs.example.net/x/y")))
    assert tuple(got) == ("acc", "box", "x/y")
    assert one(naming.parse_storage(F.lit("https://example.net/x"))) is None
    assert one(naming.volume_to_storage_path(F.lit("/Volumes/c/s/v/a"), F.lit("base"))) == "base/a"


def test_path_helpers(one):
    assert one(naming.stem(F.lit("/a/b.c/t2m.x.nc"))) == "t2m.x"
    assert one(naming.swap_suffix(F.lit("/a/b.c/t2m.nc"), ".out")) == "/a/b.c/t2m.out"
    assert one(naming.swap_suffix(F.lit("/a/b.c/t2m"), ".out")) == "/a/b.c/t2m.out"
    assert one(naming.local_path(F.lit("file:///a/b"))) == "/a/b"
    assert one(naming.redact(F.lit("https://h/p?sig=1&x=?"))) == "https://h/p?[REDACTED]"
    assert one(naming.cycle_name(F.lit("2025-12-29 06:00:00").cast("timestamp"))) == "forecast_20251229_06"


@pytest.mark.parametrize("start, stop, chunk, want", [
    (0, 10, 5, 2), (4, 6, 5, 2), (5, 10, 5, 1), (0, 0, 5, 1), (3, 9, 0, 1), (9, 3, 2, 1)])
def test_chunks_touched(one, start, stop, chunk, want):
    assert one(chunking.touched(F.lit(start), F.lit(stop), F.lit(chunk))) == want


def test_choose_slice(spark):
    rows = spark.range(200).select(
        chunking.choose_slice(F.lit(145), F.lit(24), F.lit(10), F.col("id")).alias("a"),
        chunking.choose_slice(F.lit(145), F.lit(24), F.lit(10), F.col("id"), aligned=False).alias("b"),
        chunking.choose_slice(F.lit(10), F.lit(24), F.lit(3), F.col("id")).alias("c")).collect()
    assert {r.a.start for r in rows} == set(range(0, 122, 10))
    assert all(0 <= r.b.start <= 121 and r.b.stop - r.b.start == 24 for r in rows)
    assert all((r.c.start, r.c.stop) == (0, 10) for r in rows)


def test_axis_index(spark):
    df = spark.createDataFrame([(6,), (0,), (6,), (3,), (None,)], "h int")
    assert {r.h: r.step_index for r in axes.index_axis(df, "h").collect()} == {0: 0, 3: 1, 6: 2}
