from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridspark.operators import telemetry, visibility

T0 = datetime(2024, 1, 1)


def access_log(spark, rows):
    """Rows of (pattern, total ms, MB, success)."""
    data = [(i, p, t, t * 0.2, t * 0.3, t * 0.5, 0.0, mb, ok) for i, (p, t, mb, ok) in enumerate(rows)]
    return spark.createDataFrame(
        data, "test_id long, access_pattern string, total_ms double, open_ms double, read_ms double, "
              "compute_ms double, nan_pct double, size_mb double, success boolean")


def test_pattern_summary(spark):
    log = access_log(spark, [("a", 100.0, 1.0, True), ("a", 300.0, 1.0, True), ("a", 9.0, 9.0, False),
                             ("b", 5.0, 1.0, False), (None, 50.0, 1.0, True)])
    rows = {r.access_pattern: r for r in telemetry.by_pattern(log).collect()}
    a, b = rows["a"], rows["b"]
    assert (a.num_tests, a.avg_total_ms, a.min_total_ms, a.max_total_ms, a.p50_total_ms) == (2, 200, 100, 300, 200)
    assert a.p95_total_ms == pytest.approx(np.percentile([100, 300], 95)) and a.mb_per_second == 5.0
    assert (b.num_tests, b.avg_total_ms, b.p95_total_ms, b.mb_per_second) == (0, 0, 0, 0)
    assert rows[None].p50_total_ms == 50.0


def test_rollup(spark):
    log = access_log(spark, [("a", 100.0, 1.0, True), ("b", 300.0, 3.0, True)])
    overall = telemetry.by_pattern(log, rollup=True).where("overall").first()
    assert (overall.num_tests, overall.avg_total_ms, overall.p50_total_ms, overall.mb_per_second) == (2, 200, 200, 10)
    assert telemetry.by_pattern(log, rollup=True).count() == 3


def test_open_summary_of_nothing_is_zero(spark):
    log = access_log(spark, [("a", 100.0, 1.0, False)])
    row = telemetry.open_summary(log).first()
    assert set(row) == {0.0}


def test_best_takes_the_lowest_level_on_ties(spark):
    rows = [(4, 10, 2.0), (2, 10, 2.0), (8, 0, 9.0), (1, 10, 1.0)]
    summary = spark.createDataFrame(rows, "concurrency int, successful_writes long, writes_per_second double")
    assert tuple(telemetry.best(summary).first()) == (2, 2.0)
    assert tuple(telemetry.best(summary.where("concurrency = 8")).first()) == (1, 0.0)


@pytest.mark.parametrize("points, slope, overhead", [
    ([(1, 1000), (5, 3000), (10, 5500)], 500, 500),
    ([(4, 2000)], 500, 0),
    ([(1, 3000), (5, 1000)], 0, 3500),
    ([(1, 100), (2, 1100)], 1000, 0)])
def test_linear_cost(spark, points, slope, overhead):
    log = spark.createDataFrame([(x, float(y), True) for x, y in points] + [(1, 9e9, False)],
                                "num_changed_chunks int, sync_ms double, success boolean")
    row = telemetry.linear_cost(log).first()
    assert row.time_per_chunk_ms == pytest.approx(slope) and row.base_overhead_ms == pytest.approx(overhead)


def test_concurrency(spark):
    log = spark.createDataFrame(
        [(2, T0, 1000.0, 10.0, True), (2, T0 + timedelta(seconds=1), 1000.0, 10.0, True),
         (2, T0, 100.0, 10.0, False), (4, T0, 1.0, 1.0, False)],
        "concurrency int, start_ts timestamp, write_ms double, size_mb double, success boolean")
    rows = {r.concurrency: r for r in telemetry.by_concurrency(log).collect()}
    two, four = rows[2], rows[4]
    assert (two.num_writes, two.successful_writes, two.failed_writes) == (3, 2, 1)
    assert (two.elapsed_ms, two.writes_per_second, two.mb_per_second, two.p99_write_ms) == (2000, 1, 10, 1000)
    assert (four.successful_writes, four.writes_per_second, four.p50_write_ms) == (0, 0, 0)
    assert telemetry.write_times(log).count() == 2


def test_batches(spark):
    log = spark.createDataFrame([(0, True, "a", None), (0, False, "b", "bad"), (1, True, "c", None)],
                                "batch_id long, success boolean, path string, error string")
    assert {tuple(r) for r in telemetry.batch_summary(log).collect()} == {(0, 2, 1, 1), (1, 1, 1, 0)}
    assert [tuple(r) for r in telemetry.batch_errors(log).collect()] == [(0, "b", "bad")]
    batches = spark.createDataFrame([(0, 4, 3, 10.0, 1.0), (0, 4, 3, 10.0, 1.0), (1, 2, 2, 20.0, 3.0)],
                                    "batch_id long, files_processed long, files_successful long, "
                                    "processing_ms double, publish_ms double")
    assert tuple(telemetry.pipeline_metrics(batches).first()) == (2, 6, 5, 1, 15.0, 2.0, 3.0)
    assert telemetry.pipeline_metrics(batches.where("false")).count() == 0


def test_failures_lists_failures(spark):
    log = access_log(spark, [("a", 1.0, 1.0, True), ("b", 1.0, 1.0, False)])
    assert [r.access_pattern for r in telemetry.failures(log).collect()] == ["b"]


def test_rank_winner_compare(spark):
    log = access_log(spark, [("a", 30.0, 1.0, True), ("b", 10.0, 1.0, True), ("b", 20.0, 1.0, True),
                             ("c", 1.0, 1.0, False)])
    assert [(r["rank"], r.test_id) for r in telemetry.rank(log).orderBy("rank").collect()] == [(1, 1), (2, 2), (3, 0)]
    assert telemetry.winner(log).first().test_id == 1
    assert {r.access_pattern: r.speedup for r in telemetry.compare(log, "access_pattern").collect()} == {
        "a": 1.0, "b": 3.0}


def test_targets(spark):
    measured = spark.createDataFrame([("init", 3.0), ("sync", 9.0)], "component string, measured double")
    targets = spark.createDataFrame([("init", 30.0), ("sync", 5.0)], "component string, target double")
    rows = {r.component: (r.status, r.overall) for r in telemetry.check_targets(measured, targets).collect()}
    assert rows == {"init": ("PASS", "FAIL"), "sync": ("FAIL", "FAIL")}


def test_e2e(spark):
    stages = spark.createDataFrame([(100.0, 200.0, 300.0, 400.0, 1000.0, 4, 50.0, 99.0),
                                    (0.0, 0.0, 0.0, 0.0, 0.0, 4, 50.0, 100.0)],
                                   "arrival_ms double, discovery_ms double, processing_ms double, sync_ms double, "
                                   "read_ms double, n_files int, file_mb double, nan_pct double")
    one, two = telemetry.e2e(stages).collect()
    assert (one.total_ms, one.files_per_second, one.mb_per_second, one.data_validated) == (2000, 2, 100, True)
    assert (two.total_ms, two.files_per_second, two.data_validated) == (0, 0, False)


def test_latency_percentiles_of_both_kinds(spark):
    values = [7076.0, 9520.0, 10573.0, 11661.0, 15016.0, 14063.0]
    events = spark.createDataFrame([(v,) for v in values], "latency_ms double")
    near = telemetry.latency_percentiles(events).first()
    # round(0.5 * 5) is 2 (half to even), round(4.5) is 4.
    assert (near["count"], near.p50_ms, near.p90_ms, near.p99_ms, near.max_ms) == (6, 10573, 14063, 15016, 15016)
    linear = telemetry.latency_percentiles(events, method="linear").first()
    assert linear.p90_ms == pytest.approx(np.percentile(values, 90))


def polls(spark):
    """File a: two empty polls, then seen, then empty again; b: never seen."""
    rows = [("a", 1, float("nan")), ("a", 2, None), ("a", 3, 5.0), ("a", 4, float("nan")), ("b", 1, float("nan")),
            ("b", 9, None)]
    return spark.createDataFrame([(f, T0 + timedelta(seconds=s), v) for f, s, v in rows],
                                 "file_id string, poll_ts timestamp, value double")


def test_poll_counters(spark):
    rows = {r.file_id: (r.na_poll_count, r.total_poll_count, r.consumer_visible_utc)
            for r in visibility.from_polls(polls(spark)).collect()}
    assert rows == {"a": (2, 3, T0 + timedelta(seconds=3)), "b": (2, 2, None)}


def test_bounded_wait(spark):
    rows = {r.file_id: (r.visible, r.total_poll_count)
            for r in visibility.wait_result(polls(spark), F.lit(T0), 2.0).collect()}
    assert rows == {"a": (False, 2), "b": (False, 1)}


def test_visibility_join(spark):
    emitted = spark.createDataFrame([("a", "t2m", 93, T0), ("b", "t2m", 91, T0), ("c", "u10", 93, T0)],
                                    "file_id string, variable string, forecast_hour int, producer_release_utc timestamp")
    slots = spark.createDataFrame([("t2m", 91, T0 + timedelta(seconds=9)), ("t2m", 91, T0 + timedelta(seconds=7.076))],
                                  "variable string, step_index int, consumer_visible_utc timestamp")
    seen = visibility.join(emitted, slots).collect()
    assert [(r.file_id, r.latency_ms) for r in seen] == [("a", 7076.0)]
    left = visibility.pending(emitted, visibility.join(emitted, slots))
    assert {r.file_id for r in left.collect()} == {"b", "c"}


def test_all_available(spark):
    expected = spark.createDataFrame([("t2m", 0), ("t2m", 1)], "variable string, step_index int")
    keys = ["variable", "step_index"]
    assert tuple(visibility.all_available(expected, expected, keys).first()) == (True, 0)
    assert tuple(visibility.all_available(expected, expected.where("step_index = 0"), keys).first()) == (False, 1)
    assert tuple(visibility.all_available(expected.limit(0), expected, keys).first()) == (True, 0)
