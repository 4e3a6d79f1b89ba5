from datetime import datetime

import pytest
from pyspark.sql import functions as F

from gridspark.functions.axes import StepAxis
from gridspark.operators import stats, store
from gridspark.sources import synth

SPEC = store.StoreSpec(variables=("t2m", "u10"), members=3, n_lat=2, n_lon=2, axis=StepAxis(2, 2, 2))
CYCLE = datetime(2024, 1, 1)


def fields(spark, *rows):
    """Rows of (variable, step, member, value, release second, path)."""
    data = [(CYCLE, v, s, m, 0, 2, 2, [float(x)] * 4, p, datetime(2024, 1, 1, 0, 0, r)) for v, s, m, x, r, p in rows]
    return spark.createDataFrame(
        data, "cycle_time timestamp, variable string, step_index int, number int, lat_start int, n_lat int, "
              "n_lon int, values array<float>, source_path string, release_ts timestamp")


def stored(spark, path):
    return {(r.variable, r.step_index, r.number): r["values"][0]
            for r in store.open_store(spark, path).collect()}


def test_skeleton_has_every_slot(spark):
    cycles = synth.cycle_times(spark, "2025-12-29T00:00", 7, 6)
    assert cycles.count() == 28
    slots = store.init_cycle(cycles, SPEC)
    assert slots.count() == 28 * 2 * 3 * 3
    assert slots.select("cycle_time", "variable", "step_index", "number").distinct().count() == 28 * 18
    filled = store.init_cycle(cycles, SPEC, fill=7.0)
    assert filled.agg(F.sum(F.size("values"))).first()[0] == 28 * 18 * 4


def test_default_store_has_145_steps(spark):
    cycles = spark.createDataFrame([(CYCLE,)], "cycle_time timestamp")
    assert store.init_cycle(cycles, store.StoreSpec()).count() == 145 * 4 * 50


def test_new_store_is_all_nan(spark):
    cycles = spark.createDataFrame([(CYCLE,)], "cycle_time timestamp")
    skeleton = store.init_cycle(cycles, SPEC)
    dense = store.dense_view(skeleton, fields(spark).limit(0))
    assert [r.nan_pct for r in stats.nan_pct(dense).collect()] == [100.0, 100.0]
    one = store.dense_view(skeleton, fields(spark, ("t2m", 0, 0, 5, 0, "a")))
    assert {r.variable: r.nan_pct for r in stats.nan_pct(one).collect()} == {
        "t2m": pytest.approx(100 * 8 / 9), "u10": 100.0}


def test_write_twice_is_once(spark, tmp_path):
    path = str(tmp_path / "s")
    rows = fields(spark, ("t2m", 0, 0, 1, 0, "a"), ("t2m", 0, 1, 2, 0, "a"), ("u10", 1, 0, 3, 0, "b"))
    store.write_region(rows, path)
    once = stored(spark, path)
    store.write_region(rows, path)
    assert stored(spark, path) == once == {("t2m", 0, 0): 1, ("t2m", 0, 1): 2, ("u10", 1, 0): 3}


def test_partial_ensembles_are_merged_and_other_partitions_kept(spark, tmp_path):
    path = str(tmp_path / "s")
    store.write_region(fields(spark, ("t2m", 0, 0, 1, 0, "a"), ("t2m", 0, 2, 1, 0, "a"),
                              ("t2m", 1, 0, 1, 0, "b"), ("u10", 0, 0, 1, 0, "c")), path)
    untouched = {f: f.stat().st_mtime_ns for f in (tmp_path / "s").rglob("variable=u10/**/*.parquet")}
    store.write_region(fields(spark, ("t2m", 0, 0, 9, 1, "d"), ("t2m", 0, 1, 9, 1, "d")), path)
    assert stored(spark, path) == {("t2m", 0, 0): 9, ("t2m", 0, 1): 9, ("t2m", 0, 2): 1, ("t2m", 1, 0): 1,
                                   ("u10", 0, 0): 1}
    assert untouched and all(f.stat().st_mtime_ns == t for f, t in untouched.items())


def test_last_write_wins_in_any_order(spark, tmp_path):
    rows = [("t2m", 0, 0, x, r, p) for x, r, p in ((1, 5, "b"), (2, 9, "a"), (3, 9, "c"), (4, 2, "d"))]
    for i, order in enumerate((rows, rows[::-1], rows[2:] + rows[:2])):
        path = str(tmp_path / f"s{i}")
        store.write_region(fields(spark, *order), path)
        assert stored(spark, path) == {("t2m", 0, 0): 3}


def test_latest_of_a_hot_slot(spark):
    writes = spark.range(10_000).select(F.lit("s").alias("slot"), F.col("id"), (F.col("id") * 7 % 9973).alias("at"))
    newest = store.latest(writes, ["slot"], ["at", "id"])
    assert [tuple(r) for r in newest.select("slot", "id", "at").collect()] == [
        ("s", *max((i, i * 7 % 9973) for i in range(10_000) if i * 7 % 9973 == 9972))]
    plan = newest._jdf.queryExecution().executedPlan().toString()
    assert "partial_max" in plan


def test_merge_reads_only_touched_partitions(spark, tmp_path):
    path = str(tmp_path / "s")
    store.write_region(fields(spark, *[("t2m", s, m, 1, 0, "a") for s in range(3) for m in range(3)]), path)
    touched = spark.read.schema(store.FIELDS).parquet(path).where("step_index = 1")
    touched.write.parquet(str(tmp_path / "in"))
    incoming = spark.read.parquet(str(tmp_path / "in"))
    plan = store.merge(store.open_store(spark, path), incoming)._jdf.queryExecution().executedPlan().toString()
    assert "dynamicpruning" in plan


def test_validation(spark):
    columns = ("variable string, forecast_hour int, cycle_time timestamp, n_lat int, n_lon int, n_members int, "
               "number int")
    rows = [("t2m", 0, CYCLE, 2, 2, 3, 0), ("t2m", 91, CYCLE, 2, 2, 3, 0), ("zz", 0, CYCLE, 2, 2, 3, 0),
            ("t2m", 0, datetime(2024, 1, 2), 2, 2, 3, 0), ("t2m", 0, CYCLE, 2, 3, 3, 0),
            ("t2m", 0, CYCLE, 2, 2, 4, 0), ("t2m", 0, CYCLE, 2, 2, 2, 0), ("t2m", 0, CYCLE, 9, 9, 4, 3)]
    df = spark.createDataFrame(rows, columns).coalesce(1)
    spec = store.StoreSpec(("t2m", "u10"), 3, 2, 2, StepAxis(2, 2, 2), CYCLE)
    words = ["forecast hour 91", "variable 'zz'", "reference time 2024-01-02", "spatial shape 2 x 3", "ensemble size 4 for 3 slots"]
    full = [r.error for r in store.check(df, spec).collect()]
    assert full[0] is None and full[6] is None
    assert all(e.startswith(w) for e, w in zip(full[1:6], words))
    minimal = [r.error for r in store.check(df, spec, "minimal").collect()]
    assert [e is None for e in minimal] == [True, False, False, True, True, False, True, False]
    with pytest.raises(ValueError):
        store.check(df, spec, "some")
    # Without a cycle there is no slot.
    undated = df.limit(1).withColumn("cycle_time", F.lit(None).cast("timestamp"))
    assert [r.error for r in store.check(undated, spec, "minimal").collect()] == ["no cycle time"]


def test_open_store_with_and_without_schema(spark, tmp_path):
    path = str(tmp_path / "s")
    store.write_region(fields(spark, ("t2m", 0, 0, 1, 0, "a")), path)
    known, inferred = store.open_store(spark, path), store.open_store(spark, path, None)
    assert known.select("values", "number").collect() == inferred.select("values", "number").collect()


def test_open_many_in_path_order(spark, tmp_path):
    for name, x in (("b", 2), ("a", 1), ("c", 3)):
        spark.createDataFrame([(x,)], "x int").coalesce(1).write.parquet(str(tmp_path / name))
    rows = store.open_many(spark, [str(tmp_path / n) for n in "bac"]).collect()
    assert sorted((r.concat_index, r.x) for r in rows) == [(0, 1), (1, 2), (2, 3)]


def test_open_cycles_prunes(spark, tmp_path):
    path = str(tmp_path / "s")
    made = synth.generate_cycles(spark, "2024-01-01", SPEC, num_days=1)
    store.save(made, path)
    first = store.open_cycles(store.open_store(spark, path), 2)
    assert [r.cycle_time.hour for r in first.select("cycle_time").distinct().orderBy("cycle_time").collect()] == [0, 6]
    assert first.count() == 2 * 18
    assert [c.hour for c in store.stored_cycles(spark, path)] == [0, 6, 12, 18]
    assert store.stored_cycles(spark, path + "-none") == []
    listed = store.open_first_cycles(spark, path, 2)
    assert listed.exceptAll(first.select(*listed.columns)).count() == 0 and listed.count() == 2 * 18
    assert len({f.rsplit("/variable", 1)[0] for f in listed.inputFiles()}) == 2


def test_generate_cycles_skips_existing(spark):
    have = spark.createDataFrame([(datetime(2024, 1, 1, 6),)], "cycle_time timestamp")
    made = synth.generate_cycles(spark, "2024-01-01", SPEC, num_days=1, existing=have)
    assert {r.cycle_time.hour for r in made.select("cycle_time").distinct().collect()} == {0, 12, 18}
    again = synth.generate_cycles(spark, "2024-01-01", SPEC, num_days=1, existing=have, overwrite=True)
    assert again.select("cycle_time").distinct().count() == 4


def test_generated_values_are_in_range_and_repeatable(spark):
    cycles = spark.createDataFrame([(CYCLE,)], "cycle_time timestamp")
    spec = store.StoreSpec(members=2, n_lat=5, n_lon=6)
    one, two = (synth.generate_cycle(cycles, spec, seed=3, max_steps=2) for _ in range(2))
    assert one.count() == 4 * 2 * 2
    assert one.exceptAll(two).count() == 0
    ranges = {r.variable: (r.min, r.max) for r in stats.describe(one).collect()}
    assert 220 <= ranges["t2m"][0] < 240 < 300 < ranges["t2m"][1] <= 320
    assert 87000 <= ranges["sp"][0] and ranges["sp"][1] <= 108000
    other = synth.generate_cycle(cycles, spec, seed=4, max_steps=2)
    assert one.exceptAll(other).count() > 0


def test_grid_from_template(spark):
    row = synth.grid_from_template(fields(spark, ("t2m", 0, 0, 1, 0, "a"))).first()
    assert (row.n_lat, row.n_lon) == (2, 2)


def test_variables(spark):
    df = fields(spark, ("u10", 0, 0, 1, 0, "a"), ("number", 0, 0, 1, 0, "a"), ("t2m", 0, 0, 1, 0, "a"))
    assert {r.variable for r in store.variables(df).collect()} == {"t2m", "u10"}
    assert store.first_variable(df).first().variable == "t2m"


def test_slots_without_a_cycle_keep_each_other(spark, tmp_path):
    """A NULL in a partition column is a value: a second write replaces its own slot only."""
    path = str(tmp_path / "s")
    first = fields(spark, ("t2m", 0, 0, 1, 0, "a")).withColumn("cycle_time", F.lit(None).cast("timestamp"))
    store.write_region(first, path)
    store.write_region(first.withColumn("number", F.lit(1)), path)
    store.write_region(first.withColumn("number", F.lit(1)), path)
    assert sorted(r.number for r in store.open_store(spark, path).collect()) == [0, 1]


def test_the_last_release_stays_in_any_order(spark, tmp_path):
    """A late file of an earlier release changes nothing; the same release is decided by path; undated rows just write."""
    from itertools import permutations

    def row(value, release, source):
        return fields(spark, ("t2m", 0, 0, value, 0, source)).withColumn("release_ts", F.lit(release).cast("timestamp"))

    writes = [row(1, "2024-01-01 06:00:00", "b"), row(2, "2024-01-01 12:00:00", "a"), row(3, "2024-01-01 12:00:00", "c")]
    for n, order in enumerate(permutations(writes)):
        path = str(tmp_path / f"store{n}")
        for w in order:
            store.write_region(w, path)
        stored = store.open_store(spark, path).collect()
        assert [(r["values"][0], r.source_path) for r in stored] == [(3.0, "c")]
    store.write_region(row(9, None, "undated"), path)
    assert [r["values"][0] for r in store.open_store(spark, path).collect()] == [9.0]
    store.write_region(writes[0], path)
    assert [r["values"][0] for r in store.open_store(spark, path).collect()] == [1.0]


def test_tasks_write_and_replace_the_folders_that_spark_would_name(spark, tmp_path):
    """No file goes through a committer on the driver; names, rows and what is replaced are as Spark has them."""
    rows = fields(spark, ("t2m", 0, 0, 1, 0, "a"), ("t2m", 0, 1, 2, 0, "a"), ("a/b%c: {d", 1, 0, 3, 0, "b"), (None, 2, 0, 4, 0, "c"), ("", 1, 1, 5, 0, "d"))
    here, there = tmp_path / "store", tmp_path / "spark"
    rows.write.partitionBy(*store.PARTITION).parquet(str(there))

    def folders(root):
        return sorted({str(f.parent.relative_to(root)) for f in root.rglob("*.parquet") if f.name[0] not in "._"})

    store.save(rows, str(here))
    assert folders(here) == folders(there)
    again = fields(spark, ("t2m", 0, 0, 9, 1, "e"))
    store.save(again, str(here))
    want = [(r.variable or None, r.step_index, r.number, r["values"][0]) for r in rows.where("NOT variable <=> 't2m'").collect()]
    found = [(r.variable, r.step_index, r.number, r["values"][0]) for r in store.open_store(spark, str(here)).collect()]
    assert sorted(map(str, found)) == sorted(map(str, [*want, ("t2m", 0, 0, 9.0)]))
    assert folders(here) == folders(there) and [f for f in here.rglob("*") if f.is_file() and f.name[0] in "._"] == []


def test_last_writes_are_those_of_a_maximum_over_release_and_path(spark):
    rows = fields(spark, ("t2m", 0, 0, 1, 1, "b"), ("t2m", 0, 0, 2, 3, "a"), ("t2m", 0, 0, 3, 3, "c"), ("t2m", 0, 1, 4, 2, None),
                  ("t2m", 0, 1, 5, 2, "x"), ("u10", 0, 0, 6, 0, "p"), ("u10", 0, 0, 7, 0, "q"), ("sp", 1, 0, 8, 5, "only"))
    rows = rows.withColumn("release_ts", F.when(F.col("variable") != "u10", F.col("release_ts")))
    found = store.latest_fields(rows)
    assert {(r.variable, r.number, r["values"][0]) for r in found.collect()} == {("t2m", 0, 3.0), ("t2m", 1, 5.0), ("u10", 0, 7.0), ("sp", 0, 8.0)}
    # Texts are only compared among the rows of the last release.
    sorts = found._jdf.queryExecution().optimizedPlan().toString()
    assert "max(release_ts" in sorts and "max(struct(" not in sorts
