"""Summaries of read, write, sync and latency logs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from gridspark.functions.scalars import ratio, throughput
from gridspark.operators.joins import join_on
from gridspark.operators.quantiles import exact_quantiles
from gridspark.operators.ranking import global_row_number


def _ok(column: str) -> Column:
    """The column of successful rows, NULL of failed ones."""
    return F.when(F.col("success"), F.col(column))


def _avg(column: str, name: str | None = None) -> Column:
    return F.coalesce(F.avg(_ok(column)), F.lit(0.0)).alias(name or f"avg_{column}")


def _low(column: str, name: str | None = None) -> Column:
    return F.coalesce(F.min(_ok(column)), F.lit(0.0)).alias(name or f"min_{column}")


def _high(column: str, name: str | None = None) -> Column:
    return F.coalesce(F.max(_ok(column)), F.lit(0.0)).alias(name or f"max_{column}")


def _n_ok() -> Column:
    return F.count_if(F.col("success"))


def _mb_per_second() -> Column:
    return throughput(_ok("size_mb"), _ok("total_ms")).alias("mb_per_second")


def _with_quantiles(summary: DataFrame, log: DataFrame, keys: list[str], column: str,
                    probs: dict[str, float], method: str = "linear") -> DataFrame:
    """Add quantiles of the successful rows; 0 where a group has none."""
    quantiles = exact_quantiles(log.where("success"), keys, column, probs, method)
    return join_on(summary, quantiles, keys).fillna(0.0, subset=list(probs))


# -- access logs ---------------------------------------------------------------

def by_pattern(log: DataFrame, key: str = "access_pattern", rollup: bool = False) -> DataFrame:
    """Counts, times, sizes and throughput per access pattern.

    A pattern without a successful read has zeros. ``rollup`` adds the row over all
    patterns, marked by ``overall``.
    """
    probs = {"p50_total_ms": 0.5, "p95_total_ms": 0.95}
    aggregates = [
        _n_ok().alias("num_tests"), _avg("total_ms"), _low("total_ms"), _high("total_ms"),
        _avg("open_ms"), _avg("read_ms"), _avg("compute_ms"), _avg("nan_pct"), _avg("size_mb"),
        _mb_per_second()]
    if not rollup:
        return _with_quantiles(log.groupBy(key).agg(*aggregates), log, [key], "total_ms", probs)
    summary = log.rollup(key).agg(*aggregates, (F.grouping(key) == 1).alias("overall"))
    good = log.where("success")
    quantiles = exact_quantiles(good, [key], "total_ms", probs).withColumn("overall", F.lit(False))
    total = exact_quantiles(good, [], "total_ms", probs).withColumn("overall", F.lit(True))
    both = quantiles.unionByName(total, allowMissingColumns=True)
    return join_on(summary, both, [key, "overall"]).fillna(0.0, subset=list(probs))


def open_summary(log: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """avg, min, max, p50 and p95 of the time to open; zeros without a successful open."""
    keys = list(keys) or ["_all"]
    rows = log if keys != ["_all"] else log.withColumn("_all", F.lit(0))
    summary = rows.groupBy(*keys).agg(_avg("open_ms"), _low("open_ms"), _high("open_ms"))
    return _with_quantiles(summary, rows, keys, "open_ms",
                           {"p50_open_ms": 0.5, "p95_open_ms": 0.95}).drop("_all")


def _case_summary(log: DataFrame, keys: list[str], *extra: Column) -> DataFrame:
    summary = log.groupBy(*keys).agg(
        _avg("total_ms"), _avg("open_ms"), _avg("read_ms"), _avg("compute_ms"), _avg("size_mb"),
        _mb_per_second(), *extra)
    return _with_quantiles(summary, log, keys, "total_ms", {"p95_total_ms": 0.95})


def by_slice(log: DataFrame, keys: Sequence[str] = (
        "step_count", "ensemble_count", "lat_count", "lon_count"), order: str = "test_id") -> DataFrame:
    """Summary per slice shape; the chunk count is that of the first successful test."""
    first = F.coalesce(
        F.min_by(_ok("chunks_touched"), _ok(order)), F.lit(0)).alias("chunks_touched")
    return _case_summary(log, list(keys), first).withColumn(
        "is_single_chunk", F.col("chunks_touched") == 1)


def by_store_count(log: DataFrame) -> DataFrame:
    return _case_summary(log, ["num_stores"])


# -- write logs ------------------------------------------------------------------

def by_concurrency(log: DataFrame) -> DataFrame:
    """Write times, failures and throughput per concurrency level.

    The elapsed time of a level runs from its first start to its last end. The single
    times stay rows of the log (``write_times``).
    """
    return _with_quantiles(concurrency_rates(log), log, ["concurrency"], "write_ms", {
        "p50_write_ms": 0.5, "p95_write_ms": 0.95, "p99_write_ms": 0.99})


def concurrency_rates(log: DataFrame) -> DataFrame:
    """``by_concurrency`` without its quantiles, in one pass: all that ``best`` needs."""
    begin, length = F.unix_micros("start_ts"), (F.col("write_ms") * 1000).cast("long")
    elapsed = (F.max(begin + length) - F.min(begin)) / F.lit(1000.0)
    seconds = F.col("elapsed_ms") / 1000
    return log.groupBy("concurrency").agg(
        F.count("*").alias("num_writes"),
        _n_ok().alias("successful_writes"), F.count_if(~F.col("success")).alias("failed_writes"),
        elapsed.alias("elapsed_ms"), _avg("write_ms"), _low("write_ms"), _high("write_ms"),
        F.coalesce(F.sum(_ok("size_mb")), F.lit(0.0)).alias("_mb"),
    ).select("*", ratio(F.col("successful_writes"), seconds).alias("writes_per_second"),
             ratio(F.col("_mb"), seconds).alias("mb_per_second")).drop("_mb")


def write_times(log: DataFrame) -> DataFrame:
    """The single successful write times of each level, as rows."""
    return log.where("success").select("concurrency", "write_ms")


def best(summary: DataFrame) -> DataFrame:
    """Level with the most writes per second, the lowest on ties; (1, 0) if nothing succeeded."""
    usable = F.col("successful_writes") > 0
    rank = F.when(usable, F.struct("writes_per_second", -F.col("concurrency")))
    return summary.agg(
        F.coalesce(F.max_by("concurrency", rank), F.lit(1)).alias("optimal_concurrency"),
        F.coalesce(F.max(F.when(usable, F.col("writes_per_second"))), F.lit(0.0))
        .alias("optimal_writes_per_second"))


def linear_cost(log: DataFrame, keys: Sequence[str] = (), x: str = "num_changed_chunks",
                y: str = "sync_ms") -> DataFrame:
    """Least-squares cost of a sync: time per chunk and fixed overhead, neither below 0.

    A single point, or points that share one chunk count, give mean time / chunks and
    no overhead.
    """
    xs, ys = _ok(x).cast("double"), _ok(y).cast("double")
    slope, intercept = F.regr_slope(ys, xs), F.regr_intercept(ys, xs)
    line = (F.count(xs) > 1) & slope.isNotNull()
    return log.groupBy(*keys).agg(
        F.coalesce(F.avg(ys), F.lit(0.0)).alias("avg_sync_ms"),
        F.coalesce(F.when(line, F.greatest(F.lit(0.0), slope)).otherwise(F.avg(ys) / F.min(xs)),
                   F.lit(0.0)).alias("time_per_chunk_ms"),
        F.coalesce(F.when(line, F.greatest(F.lit(0.0), intercept)), F.lit(0.0))
        .alias("base_overhead_ms"))


def release_timing(log: DataFrame, keys: Sequence[str], column: str) -> DataFrame:
    return log.groupBy(*keys).agg(
        F.count("*").alias("n"), F.avg(column).alias("avg_ms"),
        F.min(column).alias("min_ms"), F.max(column).alias("max_ms"))


# -- latency ------------------------------------------------------------------------

def latency_percentiles(events: DataFrame, keys: Sequence[str] = (), method: str = "nearest",
                        **options) -> DataFrame:
    """count, p50, p90, p99 and max of ``latency_ms``; ``options`` go to ``exact_quantiles``."""
    keys = list(keys) or ["_all"]
    rows = events if keys != ["_all"] else events.withColumn("_all", F.lit(0))
    summary = rows.groupBy(*keys).agg(
        F.count("latency_ms").alias("count"), F.max("latency_ms").alias("max_ms"))
    quantiles = exact_quantiles(rows, keys, "latency_ms",
                                {"p50_ms": 0.5, "p90_ms": 0.9, "p99_ms": 0.99}, method, **options)
    return join_on(summary, quantiles, keys).drop("_all")


def backlog(events: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """First and last time a consumer saw something."""
    return events.groupBy(*keys).agg(
        F.min("consumer_visible_utc").alias("first_visible_utc"),
        F.max("consumer_visible_utc").alias("last_visible_utc"))


# -- batches, conversions, comparisons ---------------------------------------------

def batch_summary(write_log: DataFrame) -> DataFrame:
    """Counters per micro-batch."""
    return write_log.groupBy("batch_id").agg(
        F.count("*").alias("files_processed"), _n_ok().alias("files_successful"),
        F.count_if(~F.col("success")).alias("files_failed"))


def batch_errors(write_log: DataFrame) -> DataFrame:
    """The errors of each batch, one row per failed file."""
    return write_log.where(~F.col("success")).select("batch_id", "path", "error")


def pipeline_metrics(batch_log: DataFrame) -> DataFrame:
    """Totals and averages over batches; no row without batches.

    A replayed batch is logged twice under one id and counted once.
    """
    once = batch_log.groupBy("batch_id").agg(
        F.max(F.struct("files_processed", "files_successful", "processing_ms", "publish_ms")).alias("b"))
    return once.select("b.*").agg(
        F.count("*").alias("batches_processed"),
        F.sum("files_processed").alias("total_files_processed"),
        F.sum("files_successful").alias("total_files_successful"),
        (F.sum("files_processed") - F.sum("files_successful")).alias("total_files_failed"),
        F.avg("processing_ms").alias("avg_processing_ms"),
        F.avg("publish_ms").alias("avg_publish_ms"),
        F.avg("files_processed").alias("avg_files_per_batch"),
    ).where(F.col("batches_processed") > 0)


def conversion_summary(status: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Total, successful and failed files, and average time per successful file."""
    return status.groupBy(*keys).agg(
        F.count("*").alias("total"), _n_ok().alias("successful"),
        F.count_if(~F.col("success")).alias("failed"),
        F.coalesce(F.avg(_ok("duration_ms")), F.lit(0.0)).alias("avg_ms_per_file"))


def failures(log: DataFrame) -> DataFrame:
    return log.where(~F.col("success"))


def successes(log: DataFrame) -> DataFrame:
    return log.where("success")


def rank(log: DataFrame, total: str = "total_ms", tie: str = "test_id") -> DataFrame:
    """Successful results numbered from 1, fastest first."""
    numbered = global_row_number(log.where("success"), [total, tie], "_position")
    return numbered.withColumn("rank", F.col("_position") + 1).drop("_position")


def winner(log: DataFrame, total: str = "total_ms", tie: str = "test_id", n: int = 1) -> DataFrame:
    """The ``n`` fastest successful results."""
    return log.where("success").orderBy(total, tie).limit(n)


def compare(log: DataFrame, key: str = "engine", total: str = "total_ms", tie: str = "test_id") -> DataFrame:
    """Fastest result per variant and its factor over the slowest variant's best."""
    fastest = log.where("success").groupBy(key).agg(
        F.min(F.struct(total, tie)).alias("b")).select(key, f"b.{total}", f"b.{tie}")
    slowest = fastest.agg(F.max(total).alias("m"))
    return fastest.withColumn("_m", slowest.scalar()).withColumn(
        "speedup", ratio(F.col("_m"), F.col(total))).drop("_m")


def check_targets(measured: DataFrame, targets: DataFrame, key: str = "component") -> DataFrame:
    """PASS/FAIL per component against ``targets(component, target)``, and over all of them."""
    checked = measured.join(targets, key).withColumn("passed", F.col("measured") < F.col("target"))
    overall = checked.agg(F.coalesce(F.bool_and("passed"), F.lit(False)).alias("p"))
    verdict = F.when(F.col("passed"), "PASS").otherwise("FAIL")
    return (checked.withColumn("status", verdict)
            .withColumn("overall", F.when(overall.scalar(), "PASS").otherwise("FAIL")))


STAGES = ["arrival_ms", "discovery_ms", "processing_ms", "sync_ms", "read_ms"]


def e2e(stages: DataFrame) -> DataFrame:
    """End-to-end breakdown of runs: total time, throughput, whether data arrived."""
    total = sum((F.col(c) for c in STAGES[1:]), F.col(STAGES[0]))
    seconds = F.col("total_ms") / 1000
    return (stages.withColumn("total_ms", total)
            .withColumn("files_per_second", ratio(F.col("n_files"), seconds))
            .withColumn("mb_per_second", ratio(F.col("n_files") * F.col("file_mb"), seconds))
            .withColumn("data_validated", F.coalesce(F.col("nan_pct") < 100, F.lit(False))))
