"""Queries: conversions, banded stores, streams that go on, logs and reports read back."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from gridspark.functions import chunking
from gridspark.functions.scalars import grib_time, is_missing, iso_ms
from gridspark.operators import moments, publish, stats, store
from gridspark.plans.files import STORED, _landing, _stored
from gridspark.plans.fixtures import (ACCESS, ARRIVALS, CELLS, FIELDS, POLLS, SPEC, access, arrivals, cycle, fields, polls, put_texts)
from gridspark.plans.registry import Tables, big, query, r6, shaped
from gridspark.runtime import materialise, new_dir, stream_settings
from gridspark.sinks import convert, reports
from gridspark.sources import grids, ingest, logs, refs, synth
from gridspark.sources.files import list_files
from gridspark.sources.manifests import to_json, write_manifests
from gridspark.streaming import arrivals as streams

# Rows of a band; eight rows make bands of three, three and two.
BAND = 3


# -- bands ----------------------------------------------------------------------------

def banded(f: DataFrame, height: int = BAND) -> DataFrame:
    """Every grid cut into bands of ``height`` rows, the last one being what is left."""
    tops = F.sequence(F.lit(0), F.col("n_lat") - 1, F.lit(height))
    rest = [c for c in f.columns if c not in ("lat_start", "n_lat", "values")]
    cut = f.select(*rest, "n_lat", "values", F.explode(tops).alias("lat_start"))
    rows = F.least(F.lit(height), F.col("n_lat") - F.col("lat_start"))
    return cut.select(*rest, "lat_start", rows.alias("n_lat"), F.slice(
        "values", F.col("lat_start") * F.col("n_lon") + 1, rows * F.col("n_lon")).alias("values"))


@query(STORED)
def ingest_batch_banded(t: Tables) -> DataFrame:
    """Payload files through the batch ingest, as bands that do not divide the grid."""
    from gridspark.streaming.ingest import run_batch

    landing, _ = _landing(t)
    path = new_dir(t.spark, "store")
    run_batch(list_files(t.spark, landing), path, SPEC, bands=BAND)
    return _stored(store.open_store(t.spark, path))


@query(f"""WITH {CELLS}
SELECT cycle, variable, step_index, string_agg(CAST(number AS VARCHAR), ',' ORDER BY number) AS numbers,
       CAST(64 * count(*) AS BIGINT) AS n_cells, round(sum(weighted), 6) AS weighted
FROM (SELECT cycle, variable, step_index, number, sum(raw * (lat_idx * 8 + lon_idx + 1)) AS weighted FROM cells GROUP BY ALL)
GROUP BY cycle, variable, step_index""")
def stack_members_banded(t: Tables) -> DataFrame:
    """Members put together from bands; the weights tell whether every cell is in its place."""
    stacked = stats.stack(banded(fields(t)), SPEC.members)
    weighted = F.aggregate("members", F.lit(0.0), lambda acc, m: acc + F.aggregate(
        F.transform(m["values"], lambda v, i: v.cast("double") * (i + 1)), F.lit(0.0), lambda a, v: a + v))
    return stacked.select(
        cycle(), "variable", big("step_index").alias("step_index"),
        F.array_join(F.transform("members", lambda m: m["number"].cast("string")), ",").alias("numbers"),
        big(F.aggregate("members", F.lit(0), lambda a, m: a + F.size(m["values"]))).alias("n_cells"), r6(weighted).alias("weighted"))


@query(f"""WITH {CELLS}
SELECT cycle, variable, CAST(step_index AS BIGINT) AS step_index, 50 AS n_slots, count(DISTINCT number) AS n_arrived,
       64 * 50 - count(value) AS n_missing, round(coalesce(sum(value), 0), 6) AS total FROM cells GROUP BY cycle, variable, step_index""")
def dense_store_banded(t: Tables) -> DataFrame:
    """Every slot of the steps that arrived, once each, whatever its bands."""
    f = banded(fields(t, True))
    slots = f.select("cycle_time", "variable", "step_index").distinct()
    skeleton = store.init_cycle(f.select("cycle_time").distinct(), SPEC).join(slots, store.PARTITION, "left_semi")
    dense = store.dense_view(skeleton, f)
    missing = F.size(F.filter("values", lambda v: is_missing(v)))
    total = F.aggregate(F.filter("values", lambda v: ~is_missing(v)), F.lit(0.0), lambda a, v: a + v.cast("double"))
    return shaped(dense.groupBy(cycle(), "variable", "step_index").agg(
        F.count("*").alias("n_slots"), F.count_if("arrived").alias("n_arrived"), F.sum(missing).alias("n_missing"), F.sum(total).alias("total")),
        ["step_index", "n_slots", "n_arrived", "n_missing"], ["total"], ["cycle", "variable"])


@query(f"""WITH {CELLS}
SELECT cycle, variable, step_index, count(*) AS n_cells, count(value) AS n, round(100.0 * (count(*) - count(value)) / count(*), 6) AS nan_pct,
       round(min(value), 6) AS min, round(max(value), 6) AS max, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std
FROM cells GROUP BY cycle, variable, step_index""")
def statistics_from_moments(t: Tables) -> DataFrame:
    """Statistics of a store, written in two rounds, from the moments kept beside its grids."""
    path = new_dir(t.spark, "store")
    rows = fields(t, True)
    for odd in (0, 1):
        store.write_region(rows.where(F.col("number") % 2 == odd), path)
    found = moments.describe(store.open_moments(t.spark, path), ["cycle_time", "variable", "step_index"])
    return shaped(found.withColumn("cycle", cycle()), ["step_index", "n_cells", "n"], ["nan_pct", "min", "max", "mean", "std"], ["cycle", "variable"])


@query(f"""WITH {CELLS}
SELECT cycle, variable, step_index, lat_idx, lon_idx, round(avg(value), 6) AS mean, count(value) AS n_members
FROM cells GROUP BY cycle, variable, step_index, lat_idx, lon_idx""")
def ensemble_mean_arrays(t: Tables) -> DataFrame:
    """Means over members of banded grids, whole arrays merged in two levels."""
    means = stats.mean_cells(stats.ensemble_mean_arrays(banded(fields(t, True))))
    return shaped(means.withColumn("cycle", cycle()), ["step_index", "lat_idx", "lon_idx", "n_members"], ["mean"], ["cycle", "variable"])


# -- conversions and references ---------------------------------------------------------

def _converted(df: DataFrame) -> DataFrame:
    return _stored(df.withColumnRenamed("forecast_hour", "step_index"))


@query(STORED)
def convert_individual(t: Tables) -> DataFrame:
    """Each payload file as its own dataset, all of them read back."""
    landing, _ = _landing(t)
    out = new_dir(t.spark, "individual")
    convert.individual(list_files(t.spark, landing), out, bands=BAND)
    return _converted(t.spark.read.parquet(out))


@query(f"""WITH {CELLS}, files AS (
  SELECT cycle, variable, step_index, dense_rank() OVER (
           ORDER BY cycle || '/' || variable || '_step' || lpad(step_index::VARCHAR, 3, '0')) - 1 AS concat_index,
         count(*) AS n_cells, round(sum(raw), 6) AS total FROM cells GROUP BY cycle, variable, step_index)
SELECT concat_index, variable, n_cells, total FROM files""")
def convert_stacked(t: Tables) -> DataFrame:
    """All payload files as one dataset along a new axis, read back."""
    landing, _ = _landing(t)
    out = new_dir(t.spark, "stacked")
    convert.stacked(list_files(t.spark, landing), out, layout="ensemble")
    values = t.spark.read.parquet(out).select("concat_index", "variable", F.explode("values").alias("v"))
    return shaped(values.groupBy("concat_index", "variable").agg(F.count("*").alias("n_cells"), F.sum(F.col("v").cast("double")).alias("total")),
                  ["concat_index", "n_cells"], ["total"], ["variable"])


@query(f"""WITH {FIELDS}, files AS (
  SELECT cycle, variable, step_index, count(*) AS n FROM fields GROUP BY ALL)
SELECT dense_rank() OVER (ORDER BY cycle || '/' || variable || '_step' || lpad(step_index::VARCHAR, 3, '0')) - 1 AS concat_index,
       variable, n AS n_refs, n * 256 AS n_bytes FROM files""")
def reference_json_round_trip(t: Tables) -> DataFrame:
    """References as one JSON file per payload file, opened again as one dataset."""
    landing, _ = _landing(t)
    indexed = refs.index_files(list_files(t.spark, landing)).where(F.col("length").isNotNull())
    entry = F.struct("chunk_key", "entry")
    # The references of one payload file, at most one per member.
    files = refs.to_json(indexed).groupBy("ref_set").agg(F.map_from_entries(F.collect_list(entry)).alias("refs"))
    out = new_dir(t.spark, "refs")
    name = F.regexp_extract("ref_set", r"/(\d{8}_\d{2}/[^/]+)$", 1)
    # A folder per file, so that the listing is shared by tasks.
    put_texts(files.select(F.concat(F.lit(f"{out}/set="), F.regexp_replace(name, "/", "-"), F.lit("/refs.json")).alias("path"),
                           F.to_json(F.struct("refs")).alias("content")))
    opened = refs.parse_entries(refs.load_json(t.spark, out).select("ref_set", "chunk_key", F.coalesce(
        "inline", F.to_json(F.array("path", F.col("offset").cast("string"), F.col("length").cast("string")))).alias("entry")))
    from gridspark.operators.ranking import concat_index
    rows = concat_index(opened, "ref_set")
    return shaped(rows.groupBy("concat_index", "variable").agg(F.count("*").alias("n_refs"), F.sum("length").alias("n_bytes")),
                  ["concat_index", "n_refs", "n_bytes"], keep=["variable"])


@query(f"""WITH {CELLS}
SELECT cycle, variable, step_index, count(DISTINCT number) AS n_members, count(*) AS n_cells, round(sum(raw), 6) AS total
FROM cells GROUP BY cycle, variable, step_index""")
def open_many_files(t: Tables) -> DataFrame:
    """A dataset per cycle, opened together; the new axis is in the order of the paths."""
    out = new_dir(t.spark, "cycles")
    fields(t).withColumn("day", cycle()).write.partitionBy("day").parquet(out)
    folders = [r[0].rsplit("/", 1)[0] for r in t.spark.read.format("binaryFile").load(out).select("path").collect()]
    rows = store.open_many(t.spark, sorted(set(folders)))
    return _stored(rows)


@query(f"""WITH {FIELDS}
SELECT variable, 1 AS step_chunk, max(number) + 1 AS number_chunk, 8 AS lat_chunk, 8 AS lon_chunk FROM fields GROUP BY variable""")
def chunk_shapes(t: Tables) -> DataFrame:
    return shaped(chunking.shape(fields(t)), ["step_chunk", "number_chunk", "lat_chunk", "lon_chunk"], keep=["variable"])


# -- byte ranges --------------------------------------------------------------------------

@query(f"""WITH {CELLS}
SELECT cycle, variable, step_index, number, count(*) AS n_cells, round(sum(raw), 6) AS total, 192 AS read_length
FROM cells WHERE variable = 'u10' AND step_index <= 1 AND number < 30 AND lat_idx BETWEEN 2 AND 4 AND lon_idx BETWEEN 1 AND 5
GROUP BY cycle, variable, step_index, number""")
def select_box_of_files(t: Tables) -> DataFrame:
    """A box straight from payload files: of every message two bands of three rows are read, as one read of 6 * 8 * 4 bytes."""
    landing, _ = _landing(t)
    rows = grids.open_grids(t.spark, landing, bands=BAND, gap=0, member_from="metadata").where("variable = 'u10' AND forecast_hour <= 1 AND number < 30")
    part = grids.box(rows, slice(2, 5), slice(1, 6), BAND).withColumn("cycle_time", grib_time("data_date", "data_time"))
    values = part.withColumn("v", F.explode("values")).withColumnRenamed("forecast_hour", "step_index")
    return shaped(values.groupBy(cycle(), "variable", "step_index", "number").agg(
        F.count("*").alias("n_cells"), F.sum(F.col("v").cast("double")).alias("total"), F.max("read_length").alias("read_length")),
        ["step_index", "number", "n_cells", "read_length"], ["total"], ["cycle", "variable"])


@query(f"""WITH {CELLS}, files AS (
  SELECT cycle, variable, step_index, count(DISTINCT number) AS n_refs, round(sum(raw), 6) AS total FROM cells GROUP BY ALL)
SELECT cycle, variable, step_index, n_refs, 1 AS n_reads, total FROM files""")
def coalesced_references(t: Tables) -> DataFrame:
    """The references of every payload file are near each other: one read per file brings all of them."""
    landing, _ = _landing(t)
    indexed = refs.index_files(list_files(t.spark, landing)).where(F.col("length").isNotNull())
    opened = materialise(refs.open_refs(indexed.repartition("path"), report=True), "opened")
    total = opened.select("path", F.explode("values").alias("v")).groupBy("path").agg(F.sum(F.col("v").cast("double")).alias("total"))
    named = F.regexp_extract("path", r"/(\d{8}_\d{2})/", 1).alias("cycle")
    # A file may be shared by two tasks, each with a read of its own: their reads follow each other.
    found = refs.reads(opened).join(total, "path").join(opened.groupBy("path").agg(F.first("variable").alias("variable")), "path")
    step = F.regexp_extract("path", r"_step(\d+)", 1).cast("long").alias("step_index")
    return shaped(found.select("*", named, step).withColumn("n_reads", F.least("n_reads", F.lit(1))),
                  ["step_index", "n_refs", "n_reads"], ["total"], ["cycle", "variable"])


# -- streams ------------------------------------------------------------------------------

@query(STORED)
def ingest_resumed(t: Tables) -> DataFrame:
    """A stream that is started again from its checkpoint, after more files have come."""
    from gridspark.streaming.ingest import IngestConfig, start_ingest

    base, landing = new_dir(t.spark, "resumed"), new_dir(t.spark, "landing")
    rows = fields(t).withColumn("forecast_hour", F.col("step_index"))
    config = IngestConfig(landing=landing, store=f"{base}/store", checkpoint=f"{base}/checkpoint", logs=f"{base}/logs", spec=SPEC,
                          source="files", max_files=100_000, trigger={"availableNow": True})
    for odd in (0, 1):
        materialise(synth.release_files(rows.where(F.col("step_index") % 2 == odd), landing), "released")
        start_ingest(t.spark, config).awaitTermination()
    return _stored(store.open_store(t.spark, config.store))


@query(f"""WITH {CELLS}
SELECT cycle, variable, step_index, count(DISTINCT number) AS n_members, count(*) AS n_cells, round(sum(raw), 6) AS total
FROM cells WHERE step_index % 2 = 1 GROUP BY cycle, variable, step_index""")
def ingest_since(t: Tables) -> DataFrame:
    """A clean start: of files in two rounds only those released after the given time are ingested."""
    import time

    from gridspark.streaming.ingest import IngestConfig, start_ingest

    base, landing = new_dir(t.spark, "since"), new_dir(t.spark, "landing")
    rows = fields(t).withColumn("forecast_hour", F.col("step_index"))
    materialise(synth.release_files(rows.where(F.col("step_index") % 2 == 0), landing), "released")
    since = list_files(t.spark, landing).agg(F.date_format(F.max("modified"), "yyyy-MM-dd HH:mm:ss.SSS")).first()[0]
    time.sleep(1.1)  # some file systems keep whole seconds
    materialise(synth.release_files(rows.where(F.col("step_index") % 2 == 1), landing), "released")
    config = IngestConfig(landing=landing, store=f"{base}/store", checkpoint=f"{base}/checkpoint", logs=f"{base}/logs", spec=SPEC,
                          source="files", max_files=100_000, trigger={"availableNow": True}, since=since)
    start_ingest(t.spark, config).awaitTermination()
    return _stored(store.open_store(t.spark, config.store))


@query(f"""WITH {CELLS}, files AS (SELECT cycle, variable, step_index, round(2 * sum(raw), 6) AS total FROM cells GROUP BY ALL),
damaged AS (SELECT cycle, CAST(count(*) AS BIGINT) AS n FROM files GROUP BY cycle)
SELECT 'stored' AS kind, cycle || '/' || variable || '/' || step_index AS name, 1 AS n, total FROM files
UNION ALL SELECT 'failed', cycle, 1, NULL FROM damaged
UNION ALL SELECT 'batches', 'with files', 1, NULL
UNION ALL SELECT 'processed', 'files', (SELECT count(*) FROM files) + (SELECT count(*) FROM damaged), NULL""")
def managed_ingest(t: Tables) -> DataFrame:
    """A managed stream with a processor of its own (values doubled), a callback that fails, a damaged file in every cycle,
    and a start without new files: the good files are stored, the damaged ones are log rows, and the empty batch is none."""
    from gridspark.streaming.ingest import IngestConfig, IngestManager

    base, (landing, released) = new_dir(t.spark, "managed"), _landing(t)
    cycles = released.select(F.regexp_extract("path", r"/(\d{8}_\d{2})/", 1).alias("c")).distinct()
    put_texts(cycles.select(F.concat(F.lit(f"{landing}/"), "c", F.lit("/damaged.grib2")).alias("path"), F.lit("GSF1 and no more").alias("content")))
    config = IngestConfig(landing=landing, store=f"{base}/store", checkpoint=f"{base}/checkpoint", logs=f"{base}/logs", spec=SPEC,
                          source="files", max_files=100_000, trigger={"availableNow": True})

    def doubled(rows: DataFrame) -> DataFrame:
        return rows.withColumn("values", F.transform("values", lambda v: (v * 2).cast("float")))

    def broken(result: dict) -> None:
        raise RuntimeError("the caller's mistake")

    manager = IngestManager(t.spark, config)
    for _ in range(2):
        manager.start(on_batch=broken, process=doubled)
        manager.await_termination()
    rows = store.open_store(t.spark, config.store).select("*", cycle())
    stored = rows.select(F.concat_ws("/", "cycle", "variable", "step_index").alias("name"), F.explode("values").alias("v")).groupBy("name").agg(
        F.sum(F.col("v").cast("double")).alias("total")).select(F.lit("stored").alias("kind"), "name", F.lit(1).alias("n"), "total")
    none = F.lit(None).cast("double").alias("total")
    failed = t.spark.read.parquet(f"{config.logs}/write_log").where("NOT success").groupBy(F.regexp_extract("path", r"/(\d{8}_\d{2})/", 1).alias("name")).agg(
        F.count("*").alias("n")).select(F.lit("failed").alias("kind"), "name", "n", none)
    batches = manager.batch_log().agg(F.count("*").alias("n")).select(F.lit("batches").alias("kind"), F.lit("with files").alias("name"), "n", none)
    processed = manager.batch_log().agg(F.sum("files_processed").alias("n")).select(F.lit("processed").alias("kind"), F.lit("files").alias("name"), "n", none)
    return shaped(stored.union(failed).union(batches).union(processed), ["n"], ["total"], ["kind", "name"])


@query(f"""WITH {POLLS}
SELECT file_id, strftime(min(poll_ts), '%Y-%m-%dT%H:%M:%S.%gZ') AS producer_release_utc, 1 AS copies FROM polls GROUP BY file_id""")
def late_manifests(t: Tables) -> DataFrame:
    """Manifests in two copies each, read in several batches with duplicates dropped: none is too old to come out."""
    base = new_dir(t.spark, "late")
    released = polls(t).groupBy("file_id").agg(F.min("poll_ts").alias("at")).select(
        "file_id", F.lit("t2m").alias("variable"), F.lit(0).alias("forecast_hour"), F.concat(F.lit("/landing/"), "file_id").alias("landing_path"),
        iso_ms("at").alias("producer_write_start_utc"), iso_ms("at").alias("producer_release_utc"))
    for copy in ("a", "b"):
        materialise(write_manifests(released, f"{base}/manifests/{copy}"), "manifests")
    with stream_settings(t.spark, base):
        found = streams.manifests(t.spark, f"{base}/manifests", max_files=200, dedupe="1 hour")
        (found.writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/checkpoint")
         .trigger(availableNow=True).start().awaitTermination())
    rows = t.spark.read.parquet(f"{base}/out").where("NOT corrupt")
    return rows.groupBy("file_id", "producer_release_utc").agg(F.count("*").alias("copies"))


@query(f"""WITH {POLLS}
SELECT file_id, strftime(min(poll_ts), '%Y-%m-%dT%H:%M:%S.%gZ') AS producer_release_utc,
       CASE WHEN CAST(file_id AS BIGINT) % 3 = 0 THEN 1 ELSE 0 END AS turn FROM polls GROUP BY file_id""")
def completed_manifests(t: Tables) -> DataFrame:
    """Every third manifest is cut short when it is seen, and completed while nothing else arrives: all are read, once each."""
    from gridspark.streaming.ingest import SEEN, still_waiting
    from gridspark.streaming.waiting import waiting_manifests

    base = new_dir(t.spark, "completed")
    at = iso_ms("at")
    released = polls(t).groupBy("file_id").agg(F.min("poll_ts").alias("at")).select(
        "file_id", F.lit("t2m").alias("variable"), F.lit(0).alias("forecast_hour"), F.concat(F.lit("/landing/"), "file_id").alias("landing_path"),
        at.alias("producer_write_start_utc"), at.alias("producer_release_utc"))
    texts = to_json(released, "content").select("file_id", "content", F.concat(F.lit(f"{base}/landing/"), "file_id", F.lit(".grib2.json")).alias("path"))
    cut = F.col("file_id").cast("long") % 3 == 0
    put_texts(texts.withColumn("content", F.when(cut, F.substring("content", 1, 40)).otherwise(F.col("content"))))

    def read(stream: DataFrame, turn: int) -> DataFrame:
        (stream.writeStream.format("parquet").option("path", f"{base}/out{turn}").option("checkpointLocation", f"{base}/checkpoint{turn}")
         .trigger(availableNow=True).start().awaitTermination())
        return t.spark.read.parquet(f"{base}/out{turn}").withColumn("turn", F.lit(turn))

    new = streams.manifests(t.spark, f"{base}/landing", max_files=100_000).withColumn("modified_ms", F.unix_millis("modified"))
    first = read(new.select(*SEEN), 0)
    still_waiting(t.spark, first, f"{base}/waiting").write.parquet(f"{base}/waiting")
    put_texts(texts.where(cut))
    again = read(waiting_manifests(t.spark, f"{base}/waiting", 1_000_000).select(*SEEN), 1)
    return shaped(first.unionByName(again).where("NOT corrupt"), ["turn"], keep=["file_id", "producer_release_utc"])


@query(f"""WITH {ARRIVALS}
SELECT count(*) AS files_outstanding, CAST(coalesce(sum(100 + event_id % 7), 0) AS BIGINT) AS bytes_outstanding FROM arrivals WHERE NOT success""")
def stream_backlog(t: Tables) -> DataFrame:
    rows = arrivals(t).select(F.col("landing_path").alias("path"), (F.col("event_id") % 7 + 100).alias("size"), "success")
    return shaped(streams.backlog(rows.select("path", "size"), rows), ["files_outstanding", "bytes_outstanding"])


@query(f"""WITH {FIELDS}, stored AS (SELECT cycle, variable, step_index, count(*) AS n FROM fields GROUP BY ALL)
SELECT cycle, variable, step_index, n AS n_slots, 1 AS copies FROM stored""")
def publish_rewritten(t: Tables) -> DataFrame:
    """A store published, written again and published again: one copy of every slot."""
    base = new_dir(t.spark, "rewritten")
    for _ in range(2):
        store.write_region(fields(t), f"{base}/store")
        here = publish.store_listing(store.open_store(t.spark, f"{base}/store"), f"{base}/store")
        there = (publish.store_listing(store.open_store(t.spark, f"{base}/published"), f"{base}/published")
                 if store.exists(t.spark, f"{base}/published") else here.where(F.lit(False)))
        publish.incremental(materialise(here, "here"), materialise(there, "there"), f"{base}/store", f"{base}/published", delete=True)
    slots = store.open_store(t.spark, f"{base}/published").groupBy(*store.SLOT).agg(F.count("*").alias("copies"))
    return shaped(slots.groupBy(cycle(), "variable", "step_index").agg(F.count("*").alias("n_slots"), F.max("copies").alias("copies")),
                  ["step_index", "n_slots", "copies"], keep=["cycle", "variable"])


@query(f"""WITH {FIELDS}, stored AS (SELECT cycle, variable, step_index, count(*) AS n FROM fields GROUP BY ALL)
SELECT cycle, variable, step_index, n AS n_slots, 1 AS copies, CASE WHEN step_index = 1 THEN 1 ELSE 0 END AS version FROM stored""")
def publish_versions(t: Tables) -> DataFrame:
    """A store published, one step of it written again, and only those partitions looked at and copied; readers follow the pointer."""
    base = new_dir(t.spark, "versions")
    root, out = f"{base}/store", f"{base}/published"

    def listing() -> DataFrame:
        return publish.store_listing(store.open_store(t.spark, root), root)

    store.write_region(fields(t), root)
    publish.publish_version(listing(), root, out)
    again = fields(t).where("step_index = 1")
    store.write_region(again, root)
    touched = publish.store_listing(store.open_store(t.spark, root), root, again.select(*store.PARTITION).distinct())
    publish.publish_version(touched, root, out, publish.digests(touched).select("folder"))
    rows = publish.open_published(t.spark, out, store.FIELDS)
    slots = rows.groupBy(*store.SLOT, "version").agg(F.count("*").alias("copies"))
    return shaped(slots.groupBy(cycle(), "variable", "step_index", "version").agg(F.count("*").alias("n_slots"), F.max("copies").alias("copies")),
                  ["step_index", "n_slots", "copies", "version"], keep=["cycle", "variable"])


# -- logs and reports -----------------------------------------------------------------------

@query(f"""WITH {ACCESS}
SELECT 'csv' AS kind, access_pattern, count(*) AS n, round(sum(size_mb), 6) AS size_mb FROM access GROUP BY access_pattern
UNION ALL SELECT 'jsonl', access_pattern, count(*), round(sum(size_mb), 6) FROM access GROUP BY access_pattern""")
def log_round_trip(t: Tables) -> DataFrame:
    """Logs written as CSV (schema inferred when read) and as JSON lines, and read back."""
    base = new_dir(t.spark, "logs")
    rows = access(t).select("test_id", "access_pattern", "size_mb")
    reports.write_csv(rows, f"{base}/csv")
    reports.write_jsonl(rows, f"{base}/jsonl")
    back = [logs.read_csv(t.spark, f"{base}/csv/*.csv").withColumn("kind", F.lit("csv")),
            logs.read_jsonl(t.spark, f"{base}/jsonl/*.json", rows.schema).withColumn("kind", F.lit("jsonl"))]
    both = back[0].select("kind", "access_pattern", "size_mb").unionByName(back[1].select("kind", "access_pattern", "size_mb"))
    return shaped(both.groupBy("kind", "access_pattern").agg(F.count("*").alias("n"), F.sum("size_mb").alias("size_mb")),
                  ["n"], ["size_mb"], ["kind", "access_pattern"])


@query(f"""WITH {ACCESS}
SELECT engine, access_pattern, count(*) AS n FROM access WHERE engine = 'odd' GROUP BY engine, access_pattern""")
def report_round_trip(t: Tables) -> DataFrame:
    """A report over all engines, then one of the odd engine at the same place: nothing of the first is left."""
    path = new_dir(t.spark, "report")
    for rows in (access(t), access(t).where("engine = 'odd'")):
        reports.write_report(rows.groupBy("engine").count(), rows.select("engine", "access_pattern", "test_id"), path, ["engine"])
    back = t.spark.read.json(f"{path}/tests").join(t.spark.read.json(f"{path}/summary").select("engine"), "engine")
    return shaped(back.groupBy("engine", "access_pattern").agg(F.count("*").alias("n")), ["n"], keep=["engine", "access_pattern"])
