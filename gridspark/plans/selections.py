"""Queries: selections, statistics and stores."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from gridspark.functions.axes import StepAxis, cell_position, cells, describe_grid, index_axis, linspace
from gridspark.functions.scalars import as_float32, floor_cycle, is_missing
from gridspark.operators import selection, stats, store
from gridspark.operators.ranking import concat_index
from gridspark.plans.fixtures import (CELLS, FIELDS, SPEC, WRITE_ORDER, WRITES, cycle, fields, write_fields,
                                      writes)
from gridspark.plans.registry import Tables, big, query, r6, shaped
from gridspark.runtime import materialise, new_dir

SLOT = ["cycle", "variable"]


def _cells(df: DataFrame) -> DataFrame:
    rows = cells(df).select(cycle(), "variable", "step_index", "number", "lat_idx", "lon_idx",
                            F.when(~is_missing("value"), F.col("value").cast("double")).alias("value"))
    return shaped(rows, ["step_index", "number", "lat_idx", "lon_idx"], ["value"], SLOT)


def _cell_sql(where: str) -> str:
    return f"""WITH {CELLS}
SELECT cycle, variable, step_index, number, lat_idx, lon_idx, round(value, 6) AS value
FROM cells WHERE {where}"""


# -- selections -----------------------------------------------------------------

@query(_cell_sql("variable = 't2m' AND step_index = 1"))
def select_single_step(t: Tables) -> DataFrame:
    return _cells(selection.step(fields(t, True), "t2m", 1))


@query(_cell_sql("variable = 'u10' AND step_index >= 1 AND step_index < 3"))
def select_step_range(t: Tables) -> DataFrame:
    return _cells(selection.steps(fields(t, True), "u10", slice(1, 3)))


@query(_cell_sql("variable = 't2m' AND step_index IN (0, 2)"))
def select_step_list(t: Tables) -> DataFrame:
    return _cells(selection.steps(fields(t, True), "t2m", [0, 2]))


@query(_cell_sql("variable = 'sp' AND step_index = 0 AND lat_idx >= 2 AND lat_idx < 6 "
                 "AND lon_idx >= 1 AND lon_idx < 4"))
def select_box(t: Tables) -> DataFrame:
    return _cells(selection.box(selection.step(fields(t, True), "sp", 0), slice(2, 6), slice(1, 4)))


@query(_cell_sql("variable = 't2m' AND step_index IN (0, 1) AND lat_idx >= 5 AND lon_idx >= 3 AND lon_idx < 5"))
def select_box_steps(t: Tables) -> DataFrame:
    picked = selection.steps(fields(t, True), "t2m", [0, 1])
    return _cells(selection.box(picked, slice(5, 100), slice(3, 5)))


@query(_cell_sql("variable = 'u10' AND step_index < 2 AND number >= 10 AND number < 40 "
                 "AND lat_idx < 3 AND lon_idx >= 6"))
def select_hyperslab(t: Tables) -> DataFrame:
    return _cells(selection.hyperslab(
        fields(t, True), "u10", slice(0, 2), slice(10, 40), slice(0, 3), slice(6, 8)))


POINT = f"""WITH {CELLS}
SELECT cycle, variable, step_index, number, round(value, 6) AS value FROM cells WHERE """


def _points(df: DataFrame) -> DataFrame:
    value = F.when(~is_missing("value"), F.col("value").cast("double")).alias("value")
    return shaped(df.select(cycle(), "variable", "step_index", "number", value),
                  ["step_index", "number"], ["value"], SLOT)


@query(POINT + "number = 0 AND lat_idx = 3 AND lon_idx = 5")
def select_point(t: Tables) -> DataFrame:
    return _points(selection.point(fields(t, True), 3, 5))


@query(POINT + "number = 0 AND lat_idx = 7 AND lon_idx = 7")
def select_point_clamped(t: Tables) -> DataFrame:
    return _points(selection.point(fields(t, True), 180, 360, clamp=True))


@query(POINT + "number = (SELECT max(number) FROM fields) AND lat_idx = 7 AND lon_idx = 7")
def select_last_point(t: Tables) -> DataFrame:
    return _points(selection.point(fields(t, True), -1, -1, number=-1))


@query(POINT + "number = 49 AND lat_idx = 7 AND lon_idx = 7 AND (cycle_no * 50 + number) % 3 > 0")
def select_last_member(t: Tables) -> DataFrame:
    """The last member of the axis, not of those that are there: slots whose member 49 has not arrived give no row."""
    arrived = fields(t, True).where(F.substring_index("source_path", "/", -1).cast("long") % 3 > 0)
    return _points(selection.point(arrived, -1, -1, number=-1, members=SPEC.members))


@query(f"""WITH {WRITES}
SELECT cycle_year, CAST(number AS BIGINT) AS number, count(*) AS n, round(sum(value), 6) AS total
FROM winners WHERE variable = 'R' AND step_index >= 2 AND step_index < 5 GROUP BY ALL""")
def select_steps_of_latest_writes(t: Tables) -> DataFrame:
    newest = store.latest(writes(t), ["cycle_time", "variable", "step_index", "number"], WRITE_ORDER)
    picked = selection.steps(newest, "R", slice(2, 5))
    return shaped(picked.groupBy(F.year("cycle_time").alias("cycle_year"), "number").agg(
        F.count("*").alias("n"), F.sum("value").alias("total")), ["cycle_year", "number", "n"], ["total"])


@query(f"""WITH {CELLS}
SELECT variable, count(*) AS n_cells, count(*) - count(value) AS n_missing, round(sum(value), 6) AS valid_sum
FROM cells GROUP BY variable""")
def valid_mask(t: Tables) -> DataFrame:
    rows = fields(t, True).select("variable", F.explode("values").alias("value"))
    missing = is_missing("value")
    return shaped(rows.groupBy("variable").agg(
        F.count("*").alias("n_cells"), F.count_if(missing).alias("n_missing"),
        F.sum(F.when(~missing, F.col("value").cast("double"))).alias("valid_sum")),
        ["n_cells", "n_missing"], ["valid_sum"], ["variable"])


@query(f"""WITH {FIELDS}
SELECT variable, variable = (SELECT min(variable) FROM fields) AS is_first
FROM fields GROUP BY variable""")
def data_variables(t: Tables) -> DataFrame:
    f = fields(t)
    return store.variables(f).select(
        "variable", (F.col("variable") == store.first_variable(f).scalar()).alias("is_first"))


# -- statistics ------------------------------------------------------------------

ENSEMBLE = f"""WITH {CELLS}
SELECT cycle, variable, step_index, lat_idx, lon_idx, round(avg(value), 6) AS mean, count(value) AS n_members
FROM cells GROUP BY cycle, variable, step_index, lat_idx, lon_idx"""


def _ensemble(df: DataFrame) -> DataFrame:
    return shaped(df.select(cycle(), *[c for c in df.columns if c != "cycle_time"]),
                  ["step_index", "lat_idx", "lon_idx", "n_members"], ["mean"], SLOT)


@query(ENSEMBLE)
def ensemble_mean(t: Tables) -> DataFrame:
    return _ensemble(stats.ensemble_mean(fields(t, True)))


@query(ENSEMBLE)
def ensemble_mean_blocks(t: Tables) -> DataFrame:
    return _ensemble(stats.ensemble_mean_blocks(fields(t, True)))


@query(f"""WITH {CELLS} SELECT round(avg(value), 6) AS mean FROM cells""")
def global_mean(t: Tables) -> DataFrame:
    return shaped(stats.global_mean(fields(t, True)), floats=["mean"])


@query(f"""WITH {CELLS}
SELECT variable, round(min(value), 6) AS min, round(max(value), 6) AS max, round(avg(value), 6) AS mean,
       round(stddev_pop(value), 6) AS std FROM cells GROUP BY variable""")
def describe_variables(t: Tables) -> DataFrame:
    return shaped(stats.describe(fields(t, True)), floats=["min", "max", "mean", "std"], keep=["variable"])


@query(f"""WITH {CELLS}
SELECT cycle, variable, round(100.0 * (count(*) - count(value)) / count(*), 6) AS nan_pct
FROM cells GROUP BY cycle, variable""")
def nan_percentage(t: Tables) -> DataFrame:
    return stats.nan_pct(fields(t, True).select(cycle(), "variable", "values"), SLOT).select(
        *SLOT, r6("nan_pct").alias("nan_pct"))


@query(f"""WITH {CELLS}
SELECT cycle, variable, step_index, lat_idx, lon_idx, round(min(value), 6) AS data_min,
       round(max(value), 6) AS data_max, round(avg(value), 6) AS data_mean,
       round(100.0 * (count(*) - count(value)) / count(*), 6) AS nan_pct
FROM cells GROUP BY cycle, variable, step_index, lat_idx, lon_idx""")
def valid_statistics(t: Tables) -> DataFrame:
    """Per cell, so cells without any valid member occur."""
    by = ["cycle", "variable", "step_index", "lat_idx", "lon_idx"]
    exploded = cells(fields(t, True)).select(cycle(), "variable", "step_index", "lat_idx", "lon_idx", "value")
    return shaped(stats.valid_cell_stats(exploded, by), ["step_index", "lat_idx", "lon_idx"],
                  ["nan_pct", "data_min", "data_max", "data_mean"], SLOT)


@query(f"""WITH {CELLS}
SELECT cycle, variable, step_index, string_agg(CAST(number AS VARCHAR), ',' ORDER BY number) AS numbers,
       CAST(count(*) AS BIGINT) AS n_members, round(sum(total), 6) AS total
FROM (SELECT cycle, variable, step_index, number, sum(value) AS total FROM cells GROUP BY ALL)
GROUP BY cycle, variable, step_index""")
def stack_members(t: Tables) -> DataFrame:
    stacked = stats.stack(fields(t, True), SPEC.members)
    cell_sum = F.aggregate("members", F.lit(0.0), lambda acc, m: acc + F.aggregate(
        m["values"], F.lit(0.0), lambda a, v: a + F.when(F.isnan(v), 0.0).otherwise(v.cast("double"))))
    return stacked.select(
        cycle(), "variable", big("step_index").alias("step_index"),
        F.array_join(F.transform("members", lambda m: m["number"].cast("string")), ",").alias("numbers"),
        big(F.size("members")).alias("n_members"), r6(cell_sum).alias("total"))


@query(f"""WITH {CELLS},
dims AS (
  SELECT variable, count(DISTINCT step_index) AS n_steps, count(DISTINCT number) AS n_members
  FROM fields GROUP BY variable),
sample AS (
  SELECT variable, round(100.0 * (count(*) - count(value)) / count(*), 6) AS sample_nan_pct
  FROM cells WHERE step_index = 0 AND number = 0 GROUP BY variable)
SELECT variable, n_steps, n_members, CAST(8 AS BIGINT) AS n_lat, CAST(8 AS BIGINT) AS n_lon,
       '1x' || n_members || 'x8x8' AS chunks, sample_nan_pct
FROM dims LEFT JOIN sample USING (variable)""")
def store_info(t: Tables) -> DataFrame:
    return shaped(stats.store_info(fields(t, True)), ["n_steps", "n_members", "n_lat", "n_lon"],
                  ["sample_nan_pct"], ["variable", "chunks"])


@query(f"""WITH {FIELDS}
SELECT variable, count(DISTINCT number) * 256 AS chunk_bytes,
       round(count(DISTINCT number) * 256 / 1048576.0, 6) AS chunk_mib, count(DISTINCT step_index) AS n_chunks,
       count(DISTINCT number) * 256 * count(DISTINCT step_index) AS total_bytes
FROM fields GROUP BY variable""")
def size_estimate(t: Tables) -> DataFrame:
    return shaped(stats.size_estimate(fields(t)), ["chunk_bytes", "n_chunks", "total_bytes"],
                  ["chunk_mib"], ["variable"])


@query(f"""WITH {FIELDS}
SELECT cycle, variable, step_index, count(DISTINCT number) AS n_members, min(number) AS first_member,
       max(number) AS last_member, CAST(8 AS BIGINT) AS n_lat, CAST(8 AS BIGINT) AS n_lon,
       90.0::DOUBLE AS lat_first, -90.0::DOUBLE AS lat_last, 0.0::DOUBLE AS lon_first, 359.5::DOUBLE AS lon_last
FROM fields GROUP BY cycle, variable, step_index""")
def verify_files(t: Tables) -> DataFrame:
    return shaped(stats.verify(fields(t).withColumn("cycle", cycle()), [*SLOT, "step_index"]),
                  ["step_index", "n_members", "first_member", "last_member", "n_lat", "n_lon"],
                  ["lat_first", "lat_last", "lon_first", "lon_last"], SLOT)


@query(f"""WITH {CELLS}
SELECT lat_idx, lon_idx, count(*) AS n, round(sum(raw), 6) AS total,
       round(CAST(90.0 - lat_idx * (180.0 / 7) AS FLOAT)::DOUBLE, 6) AS latitude,
       round(CAST(lon_idx * (359.5 / 7) AS FLOAT)::DOUBLE, 6) AS longitude
FROM cells GROUP BY lat_idx, lon_idx""")
def cell_coordinates(t: Tables) -> DataFrame:
    """Cell index to row and column, with the coordinates of an inclusive linspace."""
    grid = cells(fields(t)).groupBy("lat_idx", "lon_idx").agg(
        F.count("*").alias("n"), F.sum(F.col("value").cast("double")).alias("total"),
        F.max(cell_position("lat_idx", "lon_idx", "n_lon") - F.col("pos")).alias("off"))
    rows = grid.where("off = 0").select(
        "*", F.get(linspace(90.0, -90.0, 8), F.col("lat_idx")).alias("latitude"),
        F.get(linspace(0.0, 359.5, 8), F.col("lon_idx")).alias("longitude"))
    return shaped(rows, ["lat_idx", "lon_idx", "n"], ["total", "latitude", "longitude"])


@query("""SELECT vec_id, CAST(64 AS BIGINT) AS n_lat, round(embedding[1]::DOUBLE, 6) AS lat_first,
       round(embedding[64]::DOUBLE, 6) AS lat_last,
       round(abs(embedding[2]::DOUBLE - embedding[1]::DOUBLE), 6) AS lat_increment,
       embedding[1] > embedding[64] AS lat_descending
FROM embeddings""")
def grid_description(t: Tables) -> DataFrame:
    """Every vector read as a latitude axis."""
    axes = t("embeddings").withColumnsRenamed({"embedding": "latitude"}).withColumn("longitude", F.col("latitude"))
    described = describe_grid(axes, keep=["vec_id"])
    return shaped(described, ["vec_id", "n_lat"], ["lat_first", "lat_last", "lat_increment"], ["lat_descending"])


@query("""SELECT label, round(sum(x), 4) AS total FROM (
  SELECT label, CAST(CAST(unnest(embedding) AS DOUBLE) * 3 AS FLOAT)::DOUBLE AS x FROM embeddings)
GROUP BY label""")
def float32_cast(t: Tables) -> DataFrame:
    tripled = F.transform("embedding", lambda v: v.cast("double") * 3)
    rows = t("embeddings").select("label", F.explode(as_float32(tripled)).alias("x"))
    return rows.groupBy("label").agg(F.round(F.sum(F.col("x").cast("double")), 4).alias("total"))


# -- stores -----------------------------------------------------------------------

@query(f"""WITH {FIELDS}
SELECT cycle, variable, count(*) AS n, sum(number)::BIGINT AS number_sum
FROM fields WHERE cycle_no IN (SELECT DISTINCT cycle_no FROM fields ORDER BY cycle_no LIMIT 3)
GROUP BY cycle, variable""")
def open_first_cycles(t: Tables) -> DataFrame:
    """The first three stores of a collection."""
    return shaped(store.open_cycles(fields(t), 3).groupBy(cycle(), "variable").agg(
        F.count("*").alias("n"), F.sum("number").alias("number_sum")), ["n", "number_sum"], keep=SLOT)


@query("""WITH files AS (
  SELECT source, dense_rank() OVER (ORDER BY source) - 1 AS concat_index FROM documents)
SELECT source, concat_index, count(*) AS n FROM files GROUP BY source, concat_index""")
def concat_by_file_order(t: Tables) -> DataFrame:
    return shaped(concat_index(t("documents").select("source"), "source").groupBy("source", "concat_index")
                  .agg(F.count("*").alias("n")), ["concat_index", "n"], keep=["source"])


@query("""SELECT path, file_order, count(*) AS n FROM (
  SELECT url AS path, dense_rank() OVER (ORDER BY url) - 1 AS file_order FROM pages) GROUP BY path, file_order""")
def path_order(t: Tables) -> DataFrame:
    """Deterministic order of unevenly spread paths."""
    urls = t("pages").select(F.col("url").alias("path"))
    return shaped(concat_index(urls, "path", "file_order").groupBy("path", "file_order").agg(
        F.count("*").alias("n")), ["file_order", "n"], keep=["path"])


@query("""SELECT concat_index, count(*) AS n, round(sum(x), 6) AS total FROM (
  SELECT CAST(0 AS BIGINT) AS concat_index, CAST(c_acctbal AS DOUBLE) AS x FROM customer
  UNION ALL SELECT 1, s_acctbal FROM supplier UNION ALL SELECT 2, p_retailprice FROM part)
GROUP BY concat_index""")
def concat_datasets(t: Tables) -> DataFrame:
    stacked = store.concat([
        t("customer").select(F.col("c_acctbal").alias("x"), "c_name"),
        t("supplier").select(F.col("s_acctbal").alias("x")),
        t("part").select(F.col("p_retailprice").alias("x"))])
    return shaped(stacked.groupBy("concat_index").agg(F.count("*").alias("n"), F.sum("x").alias("total")),
                  ["concat_index", "n"], ["total"])


CYCLES = "SELECT DISTINCT make_timestamp(epoch_us(ts) // 21600000000 * 21600000000) AS c FROM events"


@query(f"""WITH steps AS (
  SELECT unnest(generate_series(0, 90)) AS h UNION ALL SELECT unnest(generate_series(93, 144, 3))
  UNION ALL SELECT unnest(generate_series(150, 360, 6))),
slots AS (
  SELECT strftime(c, '%Y%m%d_%H') AS cycle, variable, h, number
  FROM ({CYCLES}), (SELECT unnest(['t2m', 'u10', 'v10', 'sp']) AS variable), steps,
       (SELECT unnest(generate_series(0, 4)) AS number))
SELECT cycle, variable, count(*) AS n_slots, count(DISTINCT h) AS n_steps, CAST(max(h) AS BIGINT) AS last_hour,
       CAST(sum(number) AS BIGINT) AS number_sum
FROM slots GROUP BY cycle, variable""")
def preallocate_cycles(t: Tables) -> DataFrame:
    """All slots of every cycle that occurs in the event stream."""
    cycles = t("events").select(floor_cycle("ts").alias("cycle_time")).distinct()
    slots = store.init_cycle(cycles, store.StoreSpec(members=5))
    return shaped(slots.groupBy(cycle(), "variable").agg(
        F.count("*").alias("n_slots"), F.size(F.collect_set("step_index")).alias("n_steps"),
        F.max("forecast_hour").alias("last_hour"), F.sum("number").alias("number_sum")),
        ["n_slots", "n_steps", "last_hour", "number_sum"], keep=SLOT)


@query(f"""WITH {CELLS},
skeleton AS (
  SELECT cycle, variable, step_index, number
  FROM (SELECT DISTINCT cycle FROM fields), (SELECT unnest(['t2m', 'u10', 'v10', 'sp']) AS variable),
       (SELECT unnest(generate_series(0, 2)) AS step_index), (SELECT unnest(generate_series(0, 49)) AS number)),
present AS (SELECT cycle, variable, step_index, number, count(value) AS n FROM cells GROUP BY ALL)
SELECT cycle, variable, CAST(s.step_index AS BIGINT) AS step_index, count(*) AS n_slots, count(n) AS n_arrived,
       round(100.0 - 100.0 * sum(coalesce(n, 0)) / (64 * count(*)), 6) AS nan_pct
FROM skeleton s LEFT JOIN present p USING (cycle, variable, step_index, number)
GROUP BY cycle, variable, s.step_index""")
def dense_store(t: Tables) -> DataFrame:
    """Absent slots are grids of NaN."""
    f = fields(t, True)
    skeleton = store.init_cycle(f.select("cycle_time").distinct(), SPEC)
    by = [*SLOT, "step_index"]
    # Counting inside the arrays keeps one row per slot.
    missing = F.size(F.filter("values", lambda v: is_missing(v)))
    dense = store.dense_view(skeleton, f).select(
        cycle(), "variable", "step_index", "arrived", missing.alias("missing"), F.size("values").alias("size"))
    return shaped(dense.groupBy(*by).agg(
        F.count("*").alias("n_slots"), F.count_if(F.col("arrived")).alias("n_arrived"),
        (F.sum("missing") * 100 / F.sum("size")).alias("nan_pct")),
        ["step_index", "n_slots", "n_arrived"], ["nan_pct"], SLOT)


@query(f"""WITH {FIELDS}, wanted AS ({CYCLES})
SELECT strftime(c, '%Y%m%d_%H') AS cycle FROM wanted
WHERE strftime(c, '%Y%m%d_%H') NOT IN (SELECT cycle FROM fields)""")
def cycles_to_generate(t: Tables) -> DataFrame:
    """Cycles of the event stream that the store does not hold yet."""
    cycles = t("events").select(floor_cycle("ts").alias("cycle_time")).distinct()
    return store.new_cycles(cycles, fields(t)).select(cycle())


LATEST = f"""WITH {WRITES}
SELECT CAST(cycle_year AS BIGINT) AS cycle_year, variable, CAST(step_index AS BIGINT) AS step_index,
       CAST(number AS BIGINT) AS number, round(value, 6) AS value FROM winners"""


@query(LATEST)
def last_write_wins(t: Tables) -> DataFrame:
    newest = store.latest(writes(t), ["cycle_time", "variable", "step_index", "number"], WRITE_ORDER)
    return shaped(newest.withColumn("cycle_year", F.year("cycle_time")),
                  ["cycle_year", "step_index", "number"], ["value"], ["variable"])


@query(LATEST)
def region_write(t: Tables) -> DataFrame:
    """Two rounds of writes into a partitioned store, read back from it.

    The later half of the writes replaces slots of partitions that already exist.
    """
    path = new_dir(t.spark, "store")
    incoming = write_fields(t)
    late = F.col("release_ts") >= F.lit("1995-07-01").cast("timestamp")
    store.write_region(incoming.where(~late), path)
    store.write_region(incoming.where(late), path)
    rows = store.open_store(t.spark, path).select(
        F.year("cycle_time").alias("cycle_year"), "variable", "step_index", "number",
        F.get("values", F.lit(0)).alias("value"))
    return shaped(rows, ["cycle_year", "step_index", "number"], ["value"], ["variable"])


@query(f"""WITH {WRITES}
SELECT CAST(turn AS BIGINT) AS turn, CAST(cycle_year AS BIGINT) AS cycle_year, variable, CAST(step_index AS BIGINT) AS step_index,
       CAST(number AS BIGINT) AS number, round(value, 6) AS value FROM winners, (SELECT unnest([0, 1]) AS turn)""")
def late_releases(t: Tables) -> DataFrame:
    """Two batches that both hold early and late releases of the same slots, written in either order: one store."""
    incoming = write_fields(t)
    odd = F.crc32("source_path") % 2
    stores = []
    for turn in (0, 1):
        path = new_dir(t.spark, "store")
        for part in (turn, 1 - turn):
            store.write_region(incoming.where(odd == part), path)
        stores.append(store.open_store(t.spark, path).withColumn("turn", F.lit(turn)))
    rows = stores[0].unionByName(stores[1]).select(
        "turn", F.year("cycle_time").alias("cycle_year"), "variable", "step_index", "number", F.get("values", F.lit(0)).alias("value"))
    return shaped(rows, ["turn", "cycle_year", "step_index", "number"], ["value"], ["variable"])



@query("""WITH hours AS (SELECT DISTINCT event_id % 361 AS h FROM events),
axis AS (SELECT h, row_number() OVER (ORDER BY h) - 1 AS step_index FROM hours)
SELECT CAST(h AS BIGINT) AS forecast_hour, step_index FROM axis""")
def step_axis_index(t: Tables) -> DataFrame:
    """Dense index of the hours that occur in the data."""
    hours = t("events").select((F.col("event_id") % 361).cast("int").alias("forecast_hour"))
    return shaped(index_axis(hours, "forecast_hour"), ["forecast_hour", "step_index"])


@query("""WITH axis AS (
  SELECT unnest(generate_series(0, 48)) AS h UNION ALL SELECT unnest(generate_series(51, 72, 3))
  UNION ALL SELECT unnest(generate_series(78, 120, 6)))
SELECT event_type, count(*) AS n, count(h) AS on_axis, CAST(sum(h) AS BIGINT) AS hour_sum
FROM events LEFT JOIN axis ON h = event_id % 361 GROUP BY event_type""")
def custom_step_axis(t: Tables) -> DataFrame:
    """A configured axis, met by the hours of the events."""
    hour = (F.col("event_id") % 361).cast("int")
    on_axis = F.array_contains(StepAxis(48, 72, 120).column(), hour)
    return shaped(t("events").groupBy("event_type").agg(
        F.count("*").alias("n"), F.count_if(on_axis).alias("on_axis"),
        F.sum(F.when(on_axis, hour)).alias("hour_sum")), ["n", "on_axis", "hour_sum"], keep=["event_type"])


# Coordinates made from the nations: latitudes descend in growing steps, longitudes ascend in even ones.
AXES = """axis AS (
  SELECT n_nationkey AS i, 90.0 - n_nationkey * n_nationkey AS latitude, 10.0 + 45.0 * n_nationkey AS longitude FROM nation WHERE n_nationkey < 8)"""


def _axes(t: Tables) -> DataFrame:
    key = F.col("n_nationkey")
    # Eight rows, as many as the grid has rows and columns.
    return t("nation").where(key < 8).agg(
        F.transform(F.array_sort(F.collect_list(key)), lambda k: (90.0 - k * k).cast("float")).alias("latitude"),
        F.transform(F.array_sort(F.collect_list(key)), lambda k: (10.0 + 45.0 * k).cast("float")).alias("longitude"))


def _stored_axes(t: Tables) -> DataFrame:
    path = new_dir(t.spark, "store")
    store.save_axes(_axes(t), path)
    return store.open_axes(t.spark, path)


@query(f"""WITH {CELLS}, {AXES}, points AS (
  SELECT s_suppkey, 30.0 + s_suppkey % 70 + 0.25 AS lat, (s_suppkey * 37) % 720 - 360 + 0.125 AS lon FROM supplier),
la AS (SELECT s_suppkey, i AS lat_idx FROM (SELECT s_suppkey, i, row_number() OVER (PARTITION BY s_suppkey ORDER BY abs(latitude - lat), i) AS r FROM points, axis) WHERE r = 1),
lo AS (SELECT s_suppkey, i AS lon_idx FROM (
  SELECT s_suppkey, i, row_number() OVER (PARTITION BY s_suppkey ORDER BY least(d, 360 - d), i) AS r
  FROM (SELECT s_suppkey, i, abs(((longitude - lon) % 360 + 360) % 360) AS d FROM points, axis)) WHERE r = 1)
SELECT s_suppkey, CAST(lat_idx AS BIGINT) AS lat_idx, CAST(lon_idx AS BIGINT) AS lon_idx, count(*) AS n, round(sum(raw), 6) AS total
FROM la JOIN lo USING (s_suppkey) JOIN cells USING (lat_idx, lon_idx) WHERE variable = 't2m' GROUP BY ALL""")
def select_nearest_points(t: Tables) -> DataFrame:
    """Fields at points given in degrees, by coordinates stored beside the grids: uneven, descending and round axes."""
    key = F.col("s_suppkey")
    points = materialise(t("supplier").select("s_suppkey", (30.0 + key % 70 + 0.25).alias("latitude"), ((key * 37) % 720 - 360 + 0.125).alias("longitude")), "points")
    found = selection.at_points(fields(t).where("variable = 't2m'"), points, _stored_axes(t))
    return shaped(found.groupBy("s_suppkey", "lat_idx", "lon_idx").agg(F.count("*").alias("n"), F.sum(F.col("value").cast("double")).alias("total")),
                  ["s_suppkey", "lat_idx", "lon_idx", "n"], ["total"])


@query(f"""WITH {FIELDS}, {AXES}
SELECT cycle, variable, step_index, count(DISTINCT number) AS n_members, min(number) AS first_member, max(number) AS last_member,
       CAST(8 AS BIGINT) AS n_lat, CAST(8 AS BIGINT) AS n_lon, (SELECT max(latitude) FROM axis)::DOUBLE AS lat_first, (SELECT min(latitude) FROM axis)::DOUBLE AS lat_last,
       (SELECT min(longitude) FROM axis)::DOUBLE AS lon_first, (SELECT max(longitude) FROM axis)::DOUBLE AS lon_last
FROM fields GROUP BY cycle, variable, step_index""")
def verify_coordinates(t: Tables) -> DataFrame:
    """Files verified against the coordinates that are stored."""
    found = stats.verify(fields(t).withColumn("cycle", cycle()), [*SLOT, "step_index"], axes=_stored_axes(t))
    return shaped(found, ["step_index", "n_members", "first_member", "last_member", "n_lat", "n_lon"],
                  ["lat_first", "lat_last", "lon_first", "lon_last"], SLOT)
