"""Queries: telemetry, latency and visibility."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from gridspark.functions import chunking
from gridspark.functions.axes import with_step_index
from gridspark.functions.scalars import iso_ms, latency_ms, mib, throughput
from gridspark.operators import ranking, telemetry, visibility
from gridspark.plans.fixtures import ACCESS, ARRIVALS, POLLS, STEPS, access, arrivals, polls
from gridspark.plans.registry import Tables, big, query, r6, shaped
from gridspark.runtime import materialise, new_dir, stream_settings
from gridspark.sources.manifests import write_manifests
from gridspark.sources.synth import literal_table
from gridspark.streaming.arrivals import manifests as manifest_stream
from gridspark.streaming.follow import follow_visibility, latest_events

OK = "FILTER (WHERE success)"


def _zero(expression: str, name: str) -> str:
    return f"coalesce(round({expression} {OK}, 6), 0) AS {name}"


def _averages(*columns: str) -> str:
    return ",\n       ".join(_zero(f"avg({c})", f"avg_{c}") for c in columns)


MB_PER_S = f"coalesce(round(sum(size_mb) {OK} / nullif(sum(total_ms) {OK} / 1000, 0), 6), 0) AS mb_per_second"

PATTERN = f"""count(*) {OK} AS num_tests,
       {_averages("total_ms", "open_ms", "read_ms", "compute_ms", "nan_pct", "size_mb")},
       {_zero("min(total_ms)", "min_total_ms")}, {_zero("max(total_ms)", "max_total_ms")},
       {_zero("quantile_cont(total_ms, 0.5)", "p50_total_ms")},
       {_zero("quantile_cont(total_ms, 0.95)", "p95_total_ms")}, {MB_PER_S}"""
PATTERN_FLOATS = ["avg_total_ms", "avg_open_ms", "avg_read_ms", "avg_compute_ms", "avg_nan_pct", "avg_size_mb",
                  "min_total_ms", "max_total_ms", "p50_total_ms", "p95_total_ms", "mb_per_second"]


@query(f"WITH {ACCESS} SELECT access_pattern, {PATTERN} FROM access GROUP BY access_pattern")
def access_pattern_summary(t: Tables) -> DataFrame:
    return shaped(telemetry.by_pattern(access(t)), ["num_tests"], PATTERN_FLOATS, ["access_pattern"])


@query(f"""WITH {ACCESS}
SELECT access_pattern, grouping(access_pattern) = 1 AS overall, {PATTERN}
FROM access GROUP BY ROLLUP (access_pattern)""")
def access_pattern_rollup(t: Tables) -> DataFrame:
    return shaped(telemetry.by_pattern(access(t), rollup=True), ["num_tests"], PATTERN_FLOATS,
                  ["access_pattern", "overall"])


@query(f"""WITH {ACCESS}
SELECT engine, round(sum(size_mb) / (sum(total_ms) / 1000), 6) AS mb_per_second FROM access GROUP BY engine""")
def throughput_by_engine(t: Tables) -> DataFrame:
    return shaped(access(t).groupBy("engine").agg(throughput("size_mb", "total_ms").alias("mb_per_second")),
                  floats=["mb_per_second"], keep=["engine"])


@query(f"""WITH {ACCESS}
SELECT engine, {_zero("avg(open_ms)", "avg_open_ms")}, {_zero("min(open_ms)", "min_open_ms")},
       {_zero("max(open_ms)", "max_open_ms")}, {_zero("quantile_cont(open_ms, 0.5)", "p50_open_ms")},
       {_zero("quantile_cont(open_ms, 0.95)", "p95_open_ms")}
FROM access GROUP BY engine""")
def open_latency_summary(t: Tables) -> DataFrame:
    return shaped(telemetry.open_summary(access(t), ["engine"]), floats=[
        "avg_open_ms", "min_open_ms", "max_open_ms", "p50_open_ms", "p95_open_ms"], keep=["engine"])


CASE = f"""{_averages("total_ms", "open_ms", "read_ms", "compute_ms", "size_mb")},
       {_zero("quantile_cont(total_ms, 0.95)", "p95_total_ms")}, {MB_PER_S}"""
CASE_FLOATS = ["avg_total_ms", "avg_open_ms", "avg_read_ms", "avg_compute_ms", "avg_size_mb", "p95_total_ms",
               "mb_per_second"]
SLICE = ["step_count", "ensemble_count", "lat_count", "lon_count"]

# A window of step_count steps starting at test_id on chunks of 7 steps, the whole
# member axis, and latitude chunks of 100.
TOUCHED = """CASE WHEN step_count <= 0 THEN 1
            ELSE (test_id + step_count - 1) // 7 - test_id // 7 + 1 END * ((lat_count - 1) // 100 + 1)"""


def _touched():
    start = F.col("test_id")
    return chunking.touched_all([
        (start, start + F.col("step_count"), F.lit(7)),
        (F.lit(0), F.lit(50), F.lit(50)),
        (F.lit(0), F.col("lat_count"), F.lit(100))])


@query(f"""WITH {ACCESS}
SELECT {", ".join(f"CAST({c} AS BIGINT) AS {c}" for c in SLICE)}, {CASE},
       CAST(coalesce(arg_min({TOUCHED}, test_id) {OK}, 0) AS BIGINT) AS chunks_touched,
       coalesce(arg_min({TOUCHED}, test_id) {OK}, 0) = 1 AS is_single_chunk
FROM access GROUP BY step_count, ensemble_count, lat_count, lon_count""")
def slice_case_summary(t: Tables) -> DataFrame:
    log = access(t).withColumn("chunks_touched", _touched())
    return shaped(telemetry.by_slice(log), [*SLICE, "chunks_touched"], CASE_FLOATS, ["is_single_chunk"])


@query(f"""WITH {ACCESS}
SELECT CAST(num_stores AS BIGINT) AS num_stores, {CASE} FROM access GROUP BY num_stores""")
def store_count_summary(t: Tables) -> DataFrame:
    return shaped(telemetry.by_store_count(access(t)), ["num_stores"], CASE_FLOATS)


CONCURRENCY = f"""levels AS (
  SELECT concurrency, count(*) AS num_writes, count(*) {OK} AS successful_writes,
         count(*) FILTER (WHERE NOT success) AS failed_writes,
         (max(epoch_us(start_ts) + CAST(trunc(write_ms * 1000) AS BIGINT)) - min(epoch_us(start_ts)))
           / 1000.0::DOUBLE AS elapsed_ms,
         coalesce(sum(size_mb) {OK}, 0) AS mb,
         {_zero("avg(write_ms)", "avg_write_ms")}, {_zero("min(write_ms)", "min_write_ms")},
         {_zero("max(write_ms)", "max_write_ms")},
         {_zero("quantile_cont(write_ms, 0.5)", "p50_write_ms")},
         {_zero("quantile_cont(write_ms, 0.95)", "p95_write_ms")},
         {_zero("quantile_cont(write_ms, 0.99)", "p99_write_ms")}
  FROM access GROUP BY concurrency)"""


@query(f"""WITH {ACCESS}, {CONCURRENCY}
SELECT concurrency, num_writes, successful_writes, failed_writes, round(elapsed_ms, 6) AS elapsed_ms,
       avg_write_ms, min_write_ms, max_write_ms, p50_write_ms, p95_write_ms, p99_write_ms,
       round(successful_writes / (elapsed_ms / 1000), 6) AS writes_per_second,
       round(mb / (elapsed_ms / 1000), 6) AS mb_per_second
FROM levels""")
def concurrency_summary(t: Tables) -> DataFrame:
    return shaped(telemetry.by_concurrency(access(t)),
                  ["concurrency", "num_writes", "successful_writes", "failed_writes"],
                  ["elapsed_ms", "avg_write_ms", "min_write_ms", "max_write_ms", "p50_write_ms", "p95_write_ms",
                   "p99_write_ms", "writes_per_second", "mb_per_second"])


@query(f"WITH {ACCESS} SELECT concurrency, round(write_ms, 6) AS write_ms FROM access WHERE success")
def concurrency_write_times(t: Tables) -> DataFrame:
    return shaped(telemetry.write_times(access(t)), ["concurrency"], ["write_ms"])


@query(f"""WITH {ACCESS}, {CONCURRENCY}
SELECT concurrency AS optimal_concurrency,
       round(successful_writes / (elapsed_ms / 1000), 6) AS optimal_writes_per_second
FROM levels WHERE successful_writes > 0
ORDER BY successful_writes / (elapsed_ms / 1000) DESC, concurrency LIMIT 1""")
def optimal_concurrency(t: Tables) -> DataFrame:
    return shaped(telemetry.best(telemetry.concurrency_rates(access(t))),
                  ["optimal_concurrency"], ["optimal_writes_per_second"])


@query(f"""WITH {ACCESS}
SELECT engine, {_zero("avg(sync_ms)", "avg_sync_ms")},
       round(greatest(0, regr_slope(sync_ms, num_changed_chunks::DOUBLE) {OK}), 6) AS time_per_chunk_ms,
       round(greatest(0, regr_intercept(sync_ms, num_changed_chunks::DOUBLE) {OK}), 6) AS base_overhead_ms
FROM access GROUP BY engine""")
def sync_cost_line(t: Tables) -> DataFrame:
    return shaped(telemetry.linear_cost(access(t), ["engine"]), floats=[
        "avg_sync_ms", "time_per_chunk_ms", "base_overhead_ms"], keep=["engine"])


@query(f"""WITH {ACCESS}
SELECT access_pattern, count(*) AS n, round(avg(write_ms), 6) AS avg_ms, round(min(write_ms), 6) AS min_ms,
       round(max(write_ms), 6) AS max_ms FROM access GROUP BY access_pattern""")
def release_timing(t: Tables) -> DataFrame:
    return shaped(telemetry.release_timing(access(t), ["access_pattern"], "write_ms"), ["n"],
                  ["avg_ms", "min_ms", "max_ms"], ["access_pattern"])


def _ranked_sql(tail: str) -> str:
    return f"""WITH {ACCESS}
SELECT test_id, access_pattern, round(total_ms, 6) AS total_ms, rank FROM (
  SELECT *, row_number() OVER (ORDER BY total_ms, test_id) AS rank FROM access WHERE success) {tail}"""


@query(_ranked_sql(""))
def rank_results(t: Tables) -> DataFrame:
    log = access(t).select("test_id", "access_pattern", "total_ms", "success")
    return shaped(telemetry.rank(log), ["test_id", "rank"], ["total_ms"], ["access_pattern"])


@query(f"""WITH {ACCESS}
SELECT test_id, access_pattern, round(total_ms, 6) AS total_ms FROM access WHERE success
ORDER BY total_ms, test_id LIMIT 1""")
def winner(t: Tables) -> DataFrame:
    return shaped(telemetry.winner(access(t)), ["test_id"], ["total_ms"], ["access_pattern"])


@query(f"""WITH {ACCESS}
SELECT test_id, access_pattern, round(total_ms, 6) AS total_ms FROM access WHERE success
ORDER BY total_ms, test_id LIMIT 10""")
def first_ten(t: Tables) -> DataFrame:
    return shaped(telemetry.winner(access(t), n=10), ["test_id"], ["total_ms"], ["access_pattern"])


@query(f"WITH {ACCESS} SELECT test_id, access_pattern FROM access WHERE success")
def successful_tests(t: Tables) -> DataFrame:
    return telemetry.successes(access(t)).select("test_id", "access_pattern")


@query(f"WITH {ACCESS} SELECT test_id, access_pattern FROM access WHERE NOT success")
def failed_tests(t: Tables) -> DataFrame:
    return telemetry.failures(access(t)).select("test_id", "access_pattern")


@query(f"""WITH {ACCESS}, fastest AS (
  SELECT engine, min(total_ms) AS total_ms, arg_min(test_id, (total_ms, test_id)) AS test_id
  FROM access WHERE success GROUP BY engine)
SELECT engine, test_id, round(total_ms, 6) AS total_ms,
       CASE WHEN total_ms > 0 THEN round((SELECT max(total_ms) FROM fastest) / total_ms, 6) ELSE 0 END AS speedup
FROM fastest""")
def compare_engines(t: Tables) -> DataFrame:
    return shaped(telemetry.compare(access(t)), ["test_id"], ["total_ms", "speedup"], ["engine"])


TARGETS = {"click": 40.0, "view": 51.0, "purchase": 60.0, "signup": 45.0, "error": 100.0}


@query(f"""WITH {ACCESS}, targets AS (
  SELECT * FROM (VALUES {", ".join(f"('{k}', {v}::DOUBLE)" for k, v in TARGETS.items())}) v(component, target)),
measured AS (SELECT access_pattern AS component, avg(total_ms) AS measured FROM access GROUP BY 1),
checked AS (SELECT *, measured < target AS passed FROM measured JOIN targets USING (component))
SELECT component, round(measured, 6) AS measured, target, passed,
       CASE WHEN passed THEN 'PASS' ELSE 'FAIL' END AS status,
       CASE WHEN (SELECT bool_and(passed) FROM checked) THEN 'PASS' ELSE 'FAIL' END AS overall
FROM checked""")
def target_check(t: Tables) -> DataFrame:
    targets = literal_table(t.spark, list(TARGETS.items()), ["component", "target"])
    measured = access(t).groupBy(F.col("access_pattern").alias("component")).agg(
        F.avg("total_ms").alias("measured"))
    return shaped(telemetry.check_targets(measured, targets), floats=["measured", "target"],
                  keep=["component", "passed", "status", "overall"])


@query(f"""WITH {ACCESS}, runs AS (
  SELECT test_id, total_ms + open_ms + read_ms + compute_ms + sync_ms AS total,
         num_changed_chunks AS n_files, size_mb, nan_pct FROM access)
SELECT test_id, round(total, 6) AS total_ms,
       CASE WHEN total > 0 THEN round(n_files / (total / 1000), 6) ELSE 0 END AS files_per_second,
       CASE WHEN total > 0 THEN round(n_files * size_mb / (total / 1000), 6) ELSE 0 END AS mb_per_second,
       nan_pct * 12 < 100 AS data_validated
FROM runs""")
def end_to_end_breakdown(t: Tables) -> DataFrame:
    stages = access(t).select(
        "test_id", F.col("total_ms").alias("arrival_ms"), F.col("open_ms").alias("discovery_ms"),
        F.col("compute_ms").alias("processing_ms"), "sync_ms", "read_ms",
        F.col("num_changed_chunks").alias("n_files"), F.col("size_mb").alias("file_mb"),
        (F.col("nan_pct") * 12).alias("nan_pct"))
    return shaped(telemetry.e2e(stages), ["test_id"], ["total_ms", "files_per_second", "mb_per_second"],
                  ["data_validated"])


# -- batches -----------------------------------------------------------------------

BATCH = 250
BATCHES = f"""{ARRIVALS},
batched AS (
  SELECT *, (row_number() OVER (ORDER BY producer_release_utc, event_id) - 1) // {BATCH} AS batch_id FROM arrivals)"""


def _batched(t: Tables) -> DataFrame:
    return ranking.assign_batches(arrivals(t), ["producer_release_utc", "event_id"], BATCH)


@query(f"""WITH {BATCHES} SELECT event_id, batch_id FROM batched""")
def micro_batches(t: Tables) -> DataFrame:
    return _batched(t).select("event_id", "batch_id")


@query(f"""WITH {BATCHES}
SELECT batch_id, count(*) AS files_processed, count(*) {OK} AS files_successful,
       count(*) FILTER (WHERE NOT success) AS files_failed FROM batched GROUP BY batch_id""")
def batch_counters(t: Tables) -> DataFrame:
    return shaped(telemetry.batch_summary(_batched(t)),
                  ["batch_id", "files_processed", "files_successful", "files_failed"])


@query(f"""WITH {BATCHES}
SELECT batch_id, landing_path AS path, 'cannot write ' || landing_path AS error FROM batched WHERE NOT success""")
def batch_errors(t: Tables) -> DataFrame:
    log = _batched(t).select("batch_id", "success", F.col("landing_path").alias("path"), F.concat(
        F.lit("cannot write "), F.col("landing_path")).alias("error"))
    return telemetry.batch_errors(log)


@query(f"""WITH {BATCHES}, batches AS (
  SELECT batch_id, count(*) AS files, count(*) {OK} AS good, max(latency_ms) AS processing_ms,
         min(latency_ms) AS publish_ms FROM batched GROUP BY batch_id)
SELECT count(*) AS batches_processed, CAST(sum(files) AS BIGINT) AS total_files_processed,
       CAST(sum(good) AS BIGINT) AS total_files_successful, CAST(sum(files - good) AS BIGINT) AS total_files_failed,
       round(avg(processing_ms), 6) AS avg_processing_ms, round(avg(publish_ms), 6) AS avg_publish_ms,
       round(avg(files), 6) AS avg_files_per_batch
FROM batches""")
def pipeline_metrics(t: Tables) -> DataFrame:
    batches = _batched(t).groupBy("batch_id").agg(
        F.count("*").alias("files_processed"), F.count_if("success").alias("files_successful"),
        F.max("latency_ms").alias("processing_ms"), F.min("latency_ms").alias("publish_ms"))
    return shaped(telemetry.pipeline_metrics(batches),
                  ["batches_processed", "total_files_processed", "total_files_successful", "total_files_failed"],
                  ["avg_processing_ms", "avg_publish_ms", "avg_files_per_batch"])


@query(f"""WITH {ARRIVALS}
SELECT variable, count(*) AS total, count(*) {OK} AS successful, count(*) FILTER (WHERE NOT success) AS failed,
       coalesce(round(avg(latency_ms) {OK}, 6), 0) AS avg_ms_per_file
FROM arrivals GROUP BY variable""")
def conversion_summary(t: Tables) -> DataFrame:
    status = arrivals(t).withColumnRenamed("latency_ms", "duration_ms")
    return shaped(telemetry.conversion_summary(status, ["variable"]), ["total", "successful", "failed"],
                  ["avg_ms_per_file"], ["variable"])


@query(f"""WITH {ARRIVALS}, placed AS (
  SELECT event_id, row_number() OVER (ORDER BY producer_release_utc, event_id) - 1 AS i FROM arrivals)
SELECT event_id, strftime(TIMESTAMP '2024-06-01 00:00:00' + to_microseconds(i * 500000), '%Y-%m-%dT%H:%M:%S.%gZ')
       AS release_at FROM placed""")
def release_schedule(t: Tables) -> DataFrame:
    start = F.lit("2024-06-01 00:00:00").cast("timestamp")
    planned = ranking.schedule(arrivals(t).select("event_id", "producer_release_utc"),
                               ["producer_release_utc", "event_id"], start, 0.5)
    return planned.select("event_id", iso_ms("release_at").alias("release_at"))


@query("""WITH plan AS (
  SELECT c_custkey, row_number() OVER (ORDER BY c_custkey) - 1 AS p FROM customer),
uses AS (
  SELECT c_custkey, unnest(generate_series(p, (SELECT count(*) FROM orders) - 1,
                                           (SELECT count(*) FROM plan))) AS sequence FROM plan)
SELECT c_custkey, CAST(sequence AS BIGINT) AS sequence FROM uses""")
def burst_plan(t: Tables) -> DataFrame:
    """The customers over and over until there are as many as orders."""
    total = t("orders").count()
    plan = ranking.repeat_plan(t("customer").select("c_custkey"), ["c_custkey"], total)
    return shaped(plan, ["c_custkey", "sequence"])


# -- latency and visibility -----------------------------------------------------------

NEAREST = ", ".join(
    f"round(list_sort(list(latency_ms))[CAST(round_even({p} * (count(*) - 1), 0) AS BIGINT) + 1], 6) AS {n}"
    for n, p in (("p50_ms", 0.5), ("p90_ms", 0.9), ("p99_ms", 0.99)))


@query(f"""WITH {ARRIVALS}
SELECT variable, count(*) AS count, round(max(latency_ms), 6) AS max_ms, {NEAREST}
FROM arrivals GROUP BY variable""")
def latency_nearest(t: Tables) -> DataFrame:
    return shaped(telemetry.latency_percentiles(arrivals(t), ["variable"]), ["count"],
                  ["max_ms", "p50_ms", "p90_ms", "p99_ms"], ["variable"])


@query(f"""WITH {ARRIVALS}
SELECT count(*) AS count, round(max(latency_ms), 6) AS max_ms,
       {", ".join(f"round(quantile_cont(latency_ms, {p}), 6) AS {n}"
                  for n, p in (("p50_ms", 0.5), ("p90_ms", 0.9), ("p99_ms", 0.99)))}
FROM arrivals""")
def latency_linear(t: Tables) -> DataFrame:
    """The distributed selection even where one buffer would do."""
    return shaped(telemetry.latency_percentiles(arrivals(t), method="linear", sorted_rows=500), ["count"],
                  ["max_ms", "p50_ms", "p90_ms", "p99_ms"])


@query(f"""WITH {ARRIVALS}
SELECT variable, strftime(min(consumer_visible_utc), '%Y-%m-%dT%H:%M:%S.%gZ') AS first_visible_utc,
       strftime(max(consumer_visible_utc), '%Y-%m-%dT%H:%M:%S.%gZ') AS last_visible_utc
FROM arrivals GROUP BY variable""")
def visibility_backlog(t: Tables) -> DataFrame:
    return telemetry.backlog(arrivals(t), ["variable"]).select(
        "variable", iso_ms("first_visible_utc").alias("first_visible_utc"),
        iso_ms("last_visible_utc").alias("last_visible_utc"))


@query(f"""WITH {ARRIVALS}
SELECT event_id, CAST(epoch_us(consumer_visible_utc) // 1000 - epoch_us(producer_release_utc) // 1000 AS DOUBLE) AS latency_ms
FROM arrivals""")
def event_latency(t: Tables) -> DataFrame:
    return arrivals(t).select(
        "event_id", latency_ms("producer_release_utc", "consumer_visible_utc").alias("latency_ms"))


@query(f"""WITH {ARRIVALS}, {STEPS},
slots AS (
  SELECT variable, s.step_index, min(consumer_visible_utc) AS seen
  FROM arrivals JOIN steps s USING (forecast_hour) WHERE success GROUP BY variable, s.step_index)
SELECT a.event_id, a.variable, s.step_index,
       CAST(epoch_us(slots.seen) // 1000 - epoch_us(a.producer_release_utc) // 1000 AS DOUBLE) AS latency_ms
FROM arrivals a JOIN steps s USING (forecast_hour)
JOIN slots ON slots.variable = a.variable AND slots.step_index = s.step_index""")
def emitted_visibility(t: Tables) -> DataFrame:
    emitted = arrivals(t)
    slots = with_step_index(emitted.where("success"), hour="forecast_hour").select(
        "variable", "step_index", "consumer_visible_utc").where(F.col("step_index").isNotNull())
    seen = visibility.join(emitted.drop("consumer_visible_utc", "latency_ms"), slots)
    return shaped(seen, ["event_id", "step_index"], ["latency_ms"], ["variable"])


def _counted(table: str) -> str:
    return f"""first_seen AS (
  SELECT file_id, min(poll_ts) FILTER (WHERE value IS NOT NULL) AS seen FROM {table} GROUP BY file_id),
counted AS (
  SELECT file_id, seen, count(*) FILTER (WHERE seen IS NULL OR poll_ts < seen) AS na_poll_count
  FROM {table} JOIN first_seen USING (file_id) GROUP BY file_id, seen)"""


COUNTS = """SELECT file_id, strftime(seen, '%Y-%m-%dT%H:%M:%S.%gZ') AS consumer_visible_utc, na_poll_count,
       na_poll_count + CASE WHEN seen IS NULL THEN 0 ELSE 1 END AS total_poll_count"""


@query(f"WITH {POLLS}, {_counted('polls')} {COUNTS} FROM counted")
def poll_counters(t: Tables) -> DataFrame:
    return visibility.from_polls(polls(t)).select(
        "file_id", iso_ms("consumer_visible_utc").alias("consumer_visible_utc"),
        big("na_poll_count").alias("na_poll_count"), big("total_poll_count").alias("total_poll_count"))


@query(f"""WITH {POLLS}, {STEPS}, {_counted('polls')}, released AS (
  SELECT file_id, min(poll_ts) AS released_at FROM polls GROUP BY file_id)
{COUNTS}, step_index, CAST(epoch_us(seen) // 1000 - epoch_us(released_at) // 1000 AS DOUBLE) AS latency_ms
FROM counted JOIN released USING (file_id) JOIN steps ON forecast_hour = CAST(file_id AS BIGINT) % 361
WHERE seen IS NOT NULL""")
def follow_visibility_stream(t: Tables) -> DataFrame:
    """Manifests and polls as streams through the stateful follower; a file per user."""
    base = new_dir(t.spark, "follow")
    samples = polls(t)
    # Six files, each with polls of any time, read one per micro-batch.
    samples.repartition(6, F.xxhash64("file_id", "poll_ts")).write.parquet(f"{base}/polls")
    released = samples.groupBy("file_id").agg(F.min("poll_ts").alias("at")).select(
        "file_id", F.lit("t2m").alias("variable"),
        (F.col("file_id").cast("long") % 361).cast("int").alias("forecast_hour"),
        F.concat(F.lit("/landing/"), "file_id").alias("landing_path"),
        iso_ms("at").alias("producer_write_start_utc"), iso_ms("at").alias("producer_release_utc"))
    materialise(write_manifests(released, f"{base}/manifests"), "manifests")
    with stream_settings(t.spark, base):
        events = follow_visibility(
            manifest_stream(t.spark, f"{base}/manifests", max_files=10_000).where("NOT corrupt"),
            t.spark.readStream.schema(samples.schema).option("maxFilesPerTrigger", 1).parquet(f"{base}/polls"))
        (events.writeStream.format("parquet").option("path", f"{base}/events")
         .option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start().awaitTermination())
    return latest_events(t.spark.read.parquet(f"{base}/events")).select(
        "file_id", iso_ms("consumer_visible_utc").alias("consumer_visible_utc"), "na_poll_count", "total_poll_count",
        big("step_index").alias("step_index"), "latency_ms")


WAITED = "waited AS (SELECT * FROM polls WHERE poll_ts <= TIMESTAMP '2024-01-01 03:00:00')"


@query(f"WITH {POLLS}, {WAITED}, {_counted('waited')} {COUNTS}, seen IS NOT NULL AS visible FROM counted")
def bounded_wait(t: Tables) -> DataFrame:
    start = F.lit("2024-01-01 00:00:00").cast("timestamp")
    return visibility.wait_result(polls(t), start, 3 * 3600).select(
        "file_id", iso_ms("consumer_visible_utc").alias("consumer_visible_utc"),
        big("na_poll_count").alias("na_poll_count"), big("total_poll_count").alias("total_poll_count"), "visible")


@query(f"""WITH {ARRIVALS}, seen AS (
  SELECT DISTINCT CAST(user_id AS VARCHAR) AS file_id FROM events WHERE event_type = 'purchase')
SELECT event_id FROM arrivals WHERE file_id NOT IN (SELECT file_id FROM seen)""")
def pending_files(t: Tables) -> DataFrame:
    seen = t("events").where("event_type = 'purchase'").select(
        F.col("user_id").cast("string").alias("file_id")).distinct()
    return visibility.pending(arrivals(t), seen).select("event_id")


@query(f"""WITH {ARRIVALS}, {STEPS}, expected AS (
  SELECT DISTINCT variable, step_index FROM arrivals JOIN steps USING (forecast_hour)),
there AS (
  SELECT DISTINCT variable, step_index FROM arrivals JOIN steps USING (forecast_hour) WHERE success)
SELECT count(*) FILTER (WHERE there.step_index IS NULL) = 0 AS all_available,
       count(*) FILTER (WHERE there.step_index IS NULL) AS n_missing
FROM expected LEFT JOIN there USING (variable, step_index)""")
def all_steps_available(t: Tables) -> DataFrame:
    placed = with_step_index(arrivals(t)).where(F.col("step_index").isNotNull())
    expected = placed.select("variable", "step_index").distinct()
    return visibility.all_available(expected, placed.where("success"), ["variable", "step_index"])


@query(f"""WITH {ACCESS}
SELECT test_id, round(size_mb * 1000000 / 1048576, 6) AS mib, least(step_count, 10) AS steps_read FROM access""")
def sizes_in_mib(t: Tables) -> DataFrame:
    return access(t).select(
        "test_id", r6(mib(F.col("size_mb") * 1000000)).alias("mib"),
        big(F.least("step_count", F.lit(10))).alias("steps_read"))


@query(f"""WITH {ACCESS}
SELECT test_id, CAST({TOUCHED} AS BIGINT) AS chunks_touched, ({TOUCHED}) = 1 AS single_chunk FROM access""")
def chunks_touched(t: Tables) -> DataFrame:
    return access(t).select("test_id", big(_touched()).alias("chunks_touched"), (_touched() == 1).alias("single_chunk"))


@query(f"""WITH {ACCESS}
SELECT count(*) AS n, true AS on_chunk, true AS right_length, true AS in_axis FROM access""")
def chunk_aligned_windows(t: Tables) -> DataFrame:
    """Every test gets a window on an axis of 145 steps, aligned to chunks of 7."""
    picked = access(t).select("step_count", chunking.choose_slice(
        F.lit(145), F.col("step_count"), F.lit(7), F.col("test_id")).alias("w"))
    return picked.agg(
        F.count("*").alias("n"), F.bool_and(F.col("w.start") % 7 == 0).alias("on_chunk"),
        F.bool_and(F.col("w.stop") - F.col("w.start") == F.col("step_count")).alias("right_length"),
        F.bool_and((F.col("w.start") >= 0) & (F.col("w.stop") <= 145)).alias("in_axis"))
