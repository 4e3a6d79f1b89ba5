"""Ranking, quantiles and attach under hot keys and ties."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridspark.operators import joins, ranking
from gridspark.operators.quantiles import exact_quantiles

RNG = np.random.default_rng(7)
# Two thirds of the rows are in one group, and a third of all values are equal.
VALUES = np.where(RNG.random(6000) < 0.34, 5.0, RNG.lognormal(1, 1, 6000)).round(3)
GROUPS = np.where(RNG.random(6000) < 0.66, "hot", RNG.choice(["a", "b"], 6000))
GROUPS[:1] = "one"


@pytest.fixture(scope="module")
def rows(spark):
    data = [(int(i), str(g) if g != "b" else None, float(v)) for i, (g, v) in enumerate(zip(GROUPS, VALUES))]
    return spark.createDataFrame([*data, (9999, "hot", None)], "id long, g string, x double").cache()


@pytest.mark.parametrize("sorted_rows", [50, 10 ** 6])
def test_linear_quantiles(rows, sorted_rows):
    probs = {"p0": 0.0, "p50": 0.5, "p95": 0.95, "p100": 1.0}
    have = {r.g: r for r in exact_quantiles(rows, ["g"], "x", probs, sorted_rows=sorted_rows).collect()}
    assert set(have) == {"hot", "a", None, "one"}
    for g, r in have.items():
        mine = VALUES[GROUPS == (g or "b")]
        for name, p in probs.items():
            assert r[name] == pytest.approx(np.percentile(mine, p * 100), abs=1e-9)


def test_quantiles_do_not_depend_on_the_sketch(rows, monkeypatch):
    from gridspark.operators import quantiles

    monkeypatch.setattr(quantiles, "ACCURACY", 2)
    have = exact_quantiles(rows, [], "x", {"p50": 0.5, "p99": 0.99}, sorted_rows=50).first()
    assert have.p50 == pytest.approx(np.percentile(VALUES, 50))
    assert have.p99 == pytest.approx(np.percentile(VALUES, 99))


def test_nearest_quantiles(rows):
    have = exact_quantiles(rows, [], "x", {"p50": 0.5, "p90": 0.9, "p99": 0.99}, "nearest").first()
    ordered = sorted(VALUES)
    for name, p in (("p50", 50), ("p90", 90), ("p99", 99)):
        assert have[name] == ordered[int(round(p / 100 * (len(ordered) - 1)))]


def test_no_values_no_rows(rows):
    assert exact_quantiles(rows.where("x > 1e9"), ["g"], "x", {"p50": 0.5}, sorted_rows=50).count() == 0


@pytest.mark.parametrize("buckets", [2, 16, 100])
def test_global_row_number(rows, buckets):
    have = ranking.global_row_number(rows.where("x IS NOT NULL"), ["x", "id"], "n", buckets).collect()
    want = {i: n for n, (_, i) in enumerate(sorted((v, i) for i, v in enumerate(VALUES)))}
    assert {r.id: r.n for r in have} == want


def test_hot_value_is_split_over_buckets(rows):
    """A third of the rows have x = 5, and no bucket has much more than a sixteenth."""
    sizes = [r["count"] for r in ranking._bucketed(rows, ["x", "id"], 16).groupBy("_bucket").count().collect()]
    assert sum(sizes) == 6001 and max(sizes) < 3 * 6001 / 16
    hot = ranking._bucketed(rows, ["x", "id"], 16).where("x = 5").select("_bucket").distinct().count()
    assert hot >= 4


def test_row_number_of_nothing(rows):
    assert ranking.global_row_number(rows.where("false"), ["id"], "n").count() == 0


def test_concat_index_and_batches(spark):
    df = spark.createDataFrame([("b", 1), ("a", 2), ("b", 3), ("c", 4)], "path string, v int")
    assert {(r.path, r.concat_index) for r in ranking.concat_index(df).collect()} == {("a", 0), ("b", 1), ("c", 2)}
    batches = ranking.assign_batches(spark.range(5), ["id"], 2).orderBy("id").collect()
    assert [r.batch_id for r in batches] == [0, 0, 1, 1, 2]


def test_schedule_and_burst(spark):
    start = F.lit("2024-01-01 00:00:00").cast("timestamp")
    rows = ranking.schedule(spark.range(3), ["id"], start, 1.5).orderBy("id").collect()
    assert [r.release_at.second + r.release_at.microsecond / 1e6 for r in rows] == [0, 1.5, 3]
    assert ranking.schedule(spark.range(3), ["id"], start, burst=True).select("release_at").distinct().count() == 1


def test_burst_plan_of_the_harness(spark):
    """36 files repeated to 200."""
    rows = ranking.repeat_plan(spark.range(36), ["id"], 200).orderBy("sequence").collect()
    assert [r.sequence for r in rows] == list(range(200))
    assert all(r.id == r.sequence % 36 for r in rows)
    assert ranking.repeat_plan(spark.range(36), ["id"], 10).count() == 10


@pytest.mark.parametrize("broadcast", [True, False])
def test_attach(rows, broadcast):
    small = rows.groupBy("g").agg(F.max("x").alias("m"))
    have = joins.attach(rows, small, ["g"], broadcast)
    assert have.count() == rows.count()
    assert have.where("x > m").count() == 0
    plan = have._jdf.queryExecution().optimizedPlan().toString()
    assert ("strategy=broadcast" in plan) == broadcast
