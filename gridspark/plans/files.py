"""Queries: names, times, manifests, joins of listings, references, ingest."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from gridspark.functions import naming
from gridspark.functions.scalars import (epoch_hours, floor_cycle, from_epoch_hours, grib_time, iso_ms,
                                         member_index, parse_iso, to_utc, valid_time)
from gridspark.operators import joins, publish, store
from gridspark.plans.fixtures import (ARRIVALS, CELLS, FIELDS, LISTINGS, SPEC, STEPS, arrivals, cycle, fields,
                                      listings)
from gridspark.plans.registry import Tables, big, query, r6, shaped
from gridspark.runtime import materialise, new_dir
from gridspark.sources import ingest, manifests, refs, synth
from gridspark.sources.files import list_files, match, relative_to

ISO = "'%Y-%m-%dT%H:%M:%S.%gZ'"


# -- times --------------------------------------------------------------------------

@query(f"""SELECT event_id,
  strftime(make_timestamp(epoch_us(ts) // 21600000000 * 21600000000), {ISO}) AS cycle_start,
  strftime(make_timestamp(epoch_us(ts) // 21600000000 * 21600000000) + to_hours(event_id % 361), {ISO}) AS valid_utc,
  strftime(ts, {ISO}) AS ts_iso,
  epoch_ms(strptime(strftime(ts, '%Y-%m-%dT%H:%M:%S.%g'), '%Y-%m-%dT%H:%M:%S.%g')) AS ts_ms,
  round(epoch_us(ts) // 1000000 / 3600.0::DOUBLE, 6) AS hours,
  strftime(make_timestamp((epoch_us(ts) // 1000000) * 1000000), {ISO}) AS decoded
FROM events""")
def time_functions(t: Tables) -> DataFrame:
    ts = to_utc("ts")
    start = floor_cycle("ts")
    hours = epoch_hours("ts")
    return t("events").select(
        "event_id", iso_ms(start).alias("cycle_start"),
        iso_ms(valid_time(start, F.col("event_id") % 361)).alias("valid_utc"),
        iso_ms(ts).alias("ts_iso"), F.unix_millis(parse_iso(iso_ms(ts))).alias("ts_ms"),
        r6(hours).alias("hours"), iso_ms(from_epoch_hours(hours)).alias("decoded"))


@query(f"""SELECT o_orderkey,
  strftime(date_trunc('day', o_orderdate) + to_hours(o_orderkey % 24) + to_minutes(o_orderkey % 60), {ISO})
    AS reference_time,
  CASE WHEN o_custkey % 51 > 0 THEN o_custkey % 51 - 1 END AS member
FROM orders""")
def message_times_and_members(t: Tables) -> DataFrame:
    """Date and time integers to a time stamp; 1-based perturbation numbers to members."""
    date = F.date_format("o_orderdate", "yyyyMMdd").cast("int")
    time = (F.col("o_orderkey") % 24 * 100 + F.col("o_orderkey") % 60).cast("int")
    return t("orders").select(
        "o_orderkey", iso_ms(grib_time(date, time)).alias("reference_time"),
        member_index(F.col("o_custkey") % 51).alias("member"))


# -- names ----------------------------------------------------------------------------

EMIT = """variable || '_step' || lpad(CAST(forecast_hour AS VARCHAR), 3, '0') || '_emit-'
  || strftime(producer_release_utc, '%Y%m%dT%H%M%S.%gZ') || '_id-' || file_id || '.grib2'"""


@query(f"""WITH {ARRIVALS}
SELECT event_id, {EMIT} AS name, variable, CAST(forecast_hour AS BIGINT) AS forecast_hour, file_id,
       strftime(producer_release_utc, {ISO}) AS producer_release_utc
FROM arrivals""")
def emit_names(t: Tables) -> DataFrame:
    """Correlation names, built and parsed again (with and without the dot)."""
    named = arrivals(t).select("event_id", naming.emit_name(
        "variable", "forecast_hour", iso_ms("producer_release_utc"), "file_id").alias("name"))
    undotted = F.regexp_replace("name", r"\.(\d{3}Z)", "$1")
    both = named.select("*", naming.parse_emit_name("name").alias("a"), naming.parse_emit_name(
        F.when(F.col("event_id") % 2 == 0, undotted).otherwise(F.concat("name", F.lit(".json")))).alias("b"))
    return both.where(F.col("a") == F.col("b")).select(
        "event_id", "name", "a.variable", big("a.forecast_hour").alias("forecast_hour"), "a.file_id",
        "a.producer_release_utc")


@query("""SELECT event_id,
  'forecast_' || strftime(make_timestamp(epoch_us(ts) // 21600000000 * 21600000000), '%Y%m%d_%H') AS store_name,
  event_type || '_step' || lpad(CAST(event_id % 361 AS VARCHAR), 3, '0') AS data_name
FROM events""")
def store_names(t: Tables) -> DataFrame:
    return t("events").select(
        "event_id", naming.cycle_name(floor_cycle("ts")).alias("store_name"),
        naming.data_name("event_type", F.col("event_id") % 361).alias("data_name"))


@query(r"""SELECT page_id, regexp_replace(url, '^.*/', '') AS base,
  regexp_replace(regexp_replace(url, '^.*/', ''), '(.)\.[^.]*$', '\1') AS stem,
  regexp_replace(url, '([^/])\.[^./]*$', '\1') || '.json' AS swapped,
  regexp_replace(url, '^[a-z]+:/+', '/') AS local,
  regexp_replace(url, '[?].*$', '?[REDACTED]') AS redacted
FROM pages""")
def path_names(t: Tables) -> DataFrame:
    return t("pages").select(
        "page_id", naming.basename("url").alias("base"), naming.stem("url").alias("stem"),
        naming.swap_suffix("url", ".json").alias("swapped"), naming.local_path("url").alias("local"),
        naming.redact("url").alias("redacted"))


@query("""SELECT doc_id,
  CASE WHEN lang IN ('en', 'de') THEN 'main.' || lang || '.' || source END AS volume_name,
  CASE WHEN lang = 'en' THEN 'a/' || doc_id END AS subpath,
  source AS account, lang AS container, 'x/' || doc_id || '.nc' AS path,
  CASE WHEN lang = 'en' THEN 'base/a/' || doc_id WHEN lang = 'de' THEN 'base' END AS storage_path
FROM documents""")
def storage_paths(t: Tables) -> DataFrame:
    lang, doc = F.col("lang"), F.col("doc_id").cast("string")
    volume = F.concat(F.lit("/Volumes/main/"), lang, F.lit("/"), F.col("source"))
    path = (F.when(lang == "en", F.concat(volume, F.lit("/a/"), doc)).when(lang == "de", volume)
            .otherwise(F.concat(F.lit("/tmp/x/y/"), doc)))
    url = F.concat(F.lit("abfss://"), lang, F.lit("@"), F.col("source"), F.lit(".dfs.example.net/x/"), doc,
                   F.lit(".nc"))
    parsed, place = naming.parse_volume(path), naming.parse_storage(url)
    return t("documents").select(
        "doc_id", parsed["volume_name"].alias("volume_name"), parsed["subpath"].alias("subpath"),
        place["account"].alias("account"), place["container"].alias("container"), place["path"].alias("path"),
        naming.volume_to_storage_path(path, F.lit("base")).alias("storage_path"))


@query("""SELECT page_id, lower(url) LIKE '%example.com%' AS on_com,
  ends_with(lower(url), '#top') AS at_top, NOT ends_with(url, '=x') AS kept FROM pages""")
def path_predicates(t: Tables) -> DataFrame:
    url = F.col("url")
    return t("pages").select(
        "page_id", match(url, like="%EXAMPLE.com%").alias("on_com"),
        match(url, suffix="#TOP").alias("at_top"), match(url, exclude="=x").alias("kept"))


@query("""SELECT event_id,
  CASE WHEN event_type = 'error' THEN CASE user_id % 4 WHEN 0 THEN 't2m' WHEN 1 THEN 'u10' WHEN 2 THEN 'msl' ELSE 'zz' END
       ELSE event_type END AS variable
FROM events""")
def cf_variable_names(t: Tables) -> DataFrame:
    """The CF name where the message knows it; errors only have short names."""
    user = F.col("user_id") % 4
    short = F.when(user == 0, "2t").when(user == 1, "10u").when(user == 2, "msl").otherwise("zz")
    cf = F.when(F.col("event_type") == "error", "unknown").otherwise(F.col("event_type"))
    return t("events").select("event_id", naming.cf_name(cf, short).alias("variable"))


# -- lookups and joins of listings --------------------------------------------------------

@query(f"""WITH {ARRIVALS}, {STEPS}
SELECT event_id, step_index, CASE WHEN step_index IS NULL THEN 'forecast hour ' || a.forecast_hour || ' not in step mapping'
  WHEN variable = 'msl' THEN 'variable ''msl'' not found in store' END AS error
FROM arrivals a LEFT JOIN steps USING (forecast_hour)""")
def step_lookup(t: Tables) -> DataFrame:
    """Hours to steps; a miss, or a variable the store has not, is an error row."""
    incoming = arrivals(t).select("event_id", "variable", "forecast_hour", F.lit(0).alias("number"))
    checked = store.check(incoming, store.StoreSpec(), "minimal")
    return checked.select("event_id", big("step_index").alias("step_index"), "error")


@query(f"""WITH {ARRIVALS}, {STEPS}, checked AS (
  SELECT a.*, step_index, CASE
    WHEN make_timestamp(epoch_us(producer_release_utc) // 21600000000 * 21600000000) <> TIMESTAMP '2024-01-01 06:00:00'
      THEN 'reference time'
    WHEN step_index IS NULL THEN 'forecast hour'
    WHEN variable = 'msl' THEN 'variable ''msl'''
    WHEN event_id % 9 <> 8 THEN 'spatial shape'
    WHEN event_id % 60 > 50 THEN 'ensemble size' END AS kind
  FROM arrivals a LEFT JOIN steps USING (forecast_hour))
SELECT kind, count(*) AS n FROM checked GROUP BY kind""")
def write_validation(t: Tables) -> DataFrame:
    """Full validation of every arrival, in the order of the checks."""
    from datetime import datetime

    event = F.col("event_id")
    incoming = arrivals(t).select(
        "variable", "forecast_hour", F.lit(0).alias("number"),
        floor_cycle("producer_release_utc").alias("cycle_time"), (event % 9).cast("int").alias("n_lat"),
        F.lit(8).alias("n_lon"), (event % 60).cast("int").alias("n_members"))
    spec = store.StoreSpec(n_lat=8, n_lon=8, reference_time=datetime(2024, 1, 1, 6))
    words = F.array_join(F.slice(F.split("error", " "), 1, 2), " ")
    return store.check(incoming, spec).groupBy(words.alias("kind")).agg(F.count("*").alias("n"))


ON_DISK = """listing AS (
  SELECT DISTINCT '/landing/' || event_type || '/' || event_id || '.grib2' AS path FROM events WHERE value > 10)"""


def _on_disk(t: Tables) -> DataFrame:
    return arrivals(t).where("latency_ms > 10000").select(F.col("landing_path").alias("path"))


@query(f"WITH {ARRIVALS}, {ON_DISK} SELECT event_id FROM arrivals WHERE landing_path IN (SELECT path FROM listing)")
def manifests_with_payload(t: Tables) -> DataFrame:
    return joins.resolve(arrivals(t), _on_disk(t)).select("event_id")


@query(f"WITH {ARRIVALS}, {ON_DISK} SELECT event_id FROM arrivals WHERE landing_path NOT IN (SELECT path FROM listing)")
def missing_payloads(t: Tables) -> DataFrame:
    return joins.missing(arrivals(t), _on_disk(t)).select("event_id")


@query(f"""WITH {ARRIVALS}, {ON_DISK}
SELECT event_id, CASE WHEN landing_path IN (SELECT path FROM listing) THEN '/ssd' || landing_path
                      ELSE landing_path END AS read_path FROM arrivals""")
def staged_paths(t: Tables) -> DataFrame:
    staged = _on_disk(t).select("path", F.concat(F.lit("/ssd"), "path").alias("staged_path"))
    paths = arrivals(t).select("event_id", F.col("landing_path").alias("path"))
    return joins.staged_or_original(paths, staged).select("event_id", "read_path")


@query("""SELECT r_name, h AS forecast_hour, variable, units, count(*) AS n
FROM region, (SELECT unnest(generate_series(0, 9)) AS h),
     (VALUES ('t2m', 'K'), ('u10', 'm s-1'), ('v10', 'm s-1'), ('sp', 'Pa')) v(variable, units), nation
WHERE n_regionkey = r_regionkey GROUP BY ALL""")
def emission_plan(t: Tables) -> DataFrame:
    """Variables times hours for every nation, with the units of the variable."""
    plan = (t("nation").join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"))
            .withColumn("variable", F.explode(F.array(*[F.lit(v[0]) for v in synth.VARIABLES])))
            .withColumn("forecast_hour", F.explode(F.sequence(F.lit(0), F.lit(9)))))
    return shaped(synth.with_variable(plan).groupBy("r_name", "variable", "units", "forecast_hour").agg(
        F.count("*").alias("n")), ["forecast_hour", "n"], keep=["r_name", "variable", "units"])


@query(f"""WITH {CELLS}, cfg AS (
  SELECT * FROM (VALUES ('t2m', 'K', 220.0, 320.0), ('u10', 'm s-1', -50.0, 50.0), ('v10', 'm s-1', -50.0, 50.0),
                        ('sp', 'Pa', 87000.0, 108000.0)) v(variable, units, lo, hi))
SELECT variable, units, count(*) AS n, count(*) FILTER (WHERE raw BETWEEN lo AND hi) AS in_range
FROM cells JOIN cfg USING (variable) GROUP BY variable, units""")
def variable_ranges(t: Tables) -> DataFrame:
    rows = fields(t).select("variable", F.explode("values").alias("value"))
    counted = synth.with_variable(rows).groupBy("variable", "units").agg(
        F.count("*").alias("n"),
        F.count_if(F.col("value").between(F.col("min_value"), F.col("max_value"))).alias("in_range"))
    return shaped(counted, ["n", "in_range"], keep=["variable", "units"])


PLAN = f"""WITH {LISTINGS}, plan AS (
  SELECT coalesce(s.path, d.path) AS path, coalesce(s.size, d.size) AS size,
         CASE WHEN d.size IS NULL THEN 'new' WHEN s.size IS NULL THEN 'delete'
              WHEN s.size <> d.size THEN 'changed' ELSE 'same' END AS action
  FROM src s FULL OUTER JOIN dst d ON s.path = d.path)"""


@query(f"{PLAN} SELECT path, action, size FROM plan")
def publish_plan(t: Tables) -> DataFrame:
    source, destination = listings(t)
    return publish.plan(source, destination, delete=True)


@query(f"""{PLAN} SELECT regexp_extract(path, '^[a-z]+', 0) AS chunk, count(*) AS n_files,
       CAST(sum(size) AS BIGINT) AS n_bytes FROM plan WHERE action IN ('new', 'changed') GROUP BY ALL""")
def publish_changed_chunks(t: Tables) -> DataFrame:
    source, destination = listings(t)
    return shaped(publish.plan_chunks(publish.plan(source, destination), "^[a-z]+"), ["n_files", "n_bytes"],
                  keep=["chunk"])


# -- manifests --------------------------------------------------------------------------

def _manifests(t: Tables) -> DataFrame:
    return arrivals(t).select(
        (F.col("event_id") % 997).cast("string").alias("file_id"), "variable", "forecast_hour", "landing_path",
        iso_ms("producer_release_utc").alias("producer_write_start_utc"),
        iso_ms("producer_release_utc").alias("producer_release_utc"), F.concat(
            "landing_path", F.lit(".json")).alias("manifest_path"))


@query(f"""WITH {ARRIVALS}
SELECT file_id, variable, CAST(forecast_hour AS BIGINT) AS forecast_hour, landing_path,
       strftime(producer_release_utc, {ISO}) AS producer_release_utc,
       '{{"file_id":"' || (event_id % 997) || '","variable":"' || variable || '","forecast_hour":' || forecast_hour
       || ',"landing_path":"' || landing_path || '","producer_write_start_utc":"'
       || strftime(producer_release_utc, {ISO}) || '","producer_release_utc":"'
       || strftime(producer_release_utc, {ISO}) || '"}}' AS manifest
FROM (SELECT * REPLACE (CAST(event_id % 997 AS VARCHAR) AS file_id) FROM arrivals)""")
def manifest_round_trip(t: Tables) -> DataFrame:
    """Manifest columns to JSON and back."""
    return shaped(manifests.from_json(manifests.to_json(_manifests(t))), ["forecast_hour"], keep=[
        "file_id", "variable", "landing_path", "producer_release_utc", "manifest"])


@query(f"""WITH {ARRIVALS}, ranked AS (
  SELECT event_id % 997 AS k, event_id, variable, landing_path, row_number() OVER (
    PARTITION BY event_id % 997
    ORDER BY strftime(producer_release_utc, {ISO}) DESC, landing_path DESC) AS rn FROM arrivals)
SELECT CAST(k AS VARCHAR) AS file_id, variable, landing_path FROM ranked WHERE rn = 1""")
def latest_manifest(t: Tables) -> DataFrame:
    return manifests.latest_manifest(_manifests(t)).select("file_id", "variable", "landing_path")


@query(f"WITH {ARRIVALS} SELECT DISTINCT landing_path || '.json' AS manifest_path, variable FROM arrivals")
def distinct_manifests(t: Tables) -> DataFrame:
    twice = _manifests(t).unionByName(_manifests(t))
    return manifests.dedupe(twice).select("manifest_path", "variable")


# -- files written from the tables, and read back -------------------------------------------

def _landing(t: Tables) -> tuple[str, DataFrame]:
    """The grids as payload files, one per cycle, variable and step."""
    landing = new_dir(t.spark, "landing")
    written = synth.release_files(fields(t).withColumn("forecast_hour", F.col("step_index")), landing)
    return landing, materialise(written, "released")


STORED = f"""WITH {CELLS}
SELECT cycle, variable, step_index, count(DISTINCT number) AS n_members, count(*) AS n_cells,
       round(sum(raw), 6) AS total FROM cells GROUP BY cycle, variable, step_index"""


def _stored(df: DataFrame) -> DataFrame:
    rows = df.select(cycle(), "variable", "step_index", "number", F.explode("values").alias("v"))
    return shaped(rows.groupBy("cycle", "variable", "step_index").agg(
        F.size(F.collect_set("number")).alias("n_members"), F.count("*").alias("n_cells"),
        F.sum(F.col("v").cast("double")).alias("total")),
        ["step_index", "n_members", "n_cells"], ["total"], ["cycle", "variable"])


@query(STORED)
def decode_payload_files(t: Tables) -> DataFrame:
    landing, _ = _landing(t)
    decoded = ingest.decode_files(list_files(t.spark, landing))
    return _stored(decoded.withColumnRenamed("forecast_hour", "step_index"))


@query(f"""WITH {FIELDS}
SELECT cycle, variable, step_index AS forecast_hour, CAST(8 AS BIGINT) AS n_lat, CAST(8 AS BIGINT) AS n_lon,
       count(*) AS n_ensemble, CAST(0 AS BIGINT) AS ensemble_member
FROM fields GROUP BY cycle, variable, step_index""")
def decode_payload_metadata(t: Tables) -> DataFrame:
    """The first message of each file; its member is the lowest one, renumbered from 0."""
    landing, _ = _landing(t)
    meta = ingest.decode_metadata(list_files(t.spark, landing))
    first = F.when(F.col("ensemble_member") >= 0, 0)
    return shaped(meta.select("*", naming.cycle_name("reference_time", "").alias("cycle"))
                  .withColumn("ensemble_member", first),
                  ["forecast_hour", "n_lat", "n_lon", "n_ensemble", "ensemble_member"], keep=["cycle", "variable"])


@query(STORED)
def ingest_batch(t: Tables) -> DataFrame:
    """Payload files through the batch ingest into a store."""
    from gridspark.streaming.ingest import run_batch

    landing, _ = _landing(t)
    path = new_dir(t.spark, "store")
    run_batch(list_files(t.spark, landing), path, SPEC)
    return _stored(store.open_store(t.spark, path))


@query(STORED)
def ingest_stream(t: Tables) -> DataFrame:
    """The same through the streaming ingest, in several micro-batches, and published."""
    from gridspark.streaming.ingest import IngestConfig, start_ingest

    landing, written = _landing(t)
    base = new_dir(t.spark, "stream")
    n_files = written.count()
    config = IngestConfig(
        landing=landing, store=f"{base}/store", checkpoint=f"{base}/checkpoint", logs=f"{base}/logs", spec=SPEC,
        source="files", max_files=max(1, -(-n_files // 2)), trigger={"availableNow": True},
        publish_to=f"{base}/published")
    running = start_ingest(t.spark, config)
    running.awaitTermination()
    return _stored(store.open_store(t.spark, f"{base}/published"))


@query(f"""WITH {FIELDS}, slots AS (
  SELECT cycle, variable, step_index, count(*) AS n FROM fields GROUP BY ALL)
SELECT cycle, variable, step_index, n AS n_refs, n * 256 AS n_bytes FROM slots""")
def index_payload_files(t: Tables) -> DataFrame:
    """Virtual references to every message of every file."""
    landing, _ = _landing(t)
    indexed = refs.index_files(list_files(t.spark, landing)).where(F.col("length").isNotNull())
    hour = F.regexp_extract("path", r"_step(\d+)", 1).cast("int")
    day = F.regexp_extract("path", r"/(\d{8}_\d{2})/", 1)
    return shaped(indexed.groupBy(day.alias("cycle"), "variable", hour.alias("step_index")).agg(
        F.count("*").alias("n_refs"), F.sum("length").alias("n_bytes")),
        ["step_index", "n_refs", "n_bytes"], keep=["cycle", "variable"])


@query(f"""WITH {CELLS}, files AS (
  SELECT cycle, variable, step_index,
         dense_rank() OVER (ORDER BY cycle || '/' || variable || '_step' || lpad(step_index::VARCHAR, 3, '0')) - 1
           AS concat_index, count(*) AS n_cells, round(sum(raw), 6) AS total
  FROM cells GROUP BY cycle, variable, step_index)
SELECT concat_index, variable, n_cells, total FROM files""")
def read_combined_references(t: Tables) -> DataFrame:
    """All reference sets combined along a new axis, and their values read by byte range."""
    landing, _ = _landing(t)
    indexed = materialise(refs.index_files(list_files(t.spark, landing), inline_threshold=300), "refs")
    table = new_dir(t.spark, "combined")
    refs.save(refs.combine(indexed), table)
    combined = t.spark.read.parquet(table)
    chunks = combined.where(F.col("concat_index").isNotNull()
                            & ~F.col("variable").isin("step", "reference"))
    values = refs.open_refs(chunks).select("concat_index", "variable", F.explode("values").alias("v"))
    return shaped(values.groupBy("concat_index", "variable").agg(
        F.count("*").alias("n_cells"), F.sum(F.col("v").cast("double")).alias("total")),
        ["concat_index", "n_cells"], ["total"], ["variable"])


@query("""SELECT 'shape' AS variable, count(*) AS n_sets, true AS identical FROM (
  SELECT DISTINCT vec_id // 50, label FROM embeddings)""")
def identical_dimensions(t: Tables) -> DataFrame:
    landing, _ = _landing(t)
    indexed = refs.index_files(list_files(t.spark, landing))
    return shaped(refs.check_identical(indexed, ["shape"]), ["n_sets"], keep=["variable", "identical"])


@query("""SELECT 'set-' || (doc_id % 7) AS ref_set, lang AS variable,
  CASE WHEN n_chars >= 200 THEN source END AS path, CASE WHEN n_chars >= 200 THEN doc_id * 10 END AS "offset",
  CASE WHEN n_chars >= 200 THEN n_chars END AS length,
  CASE WHEN n_chars < 200 THEN 'short ' || doc_id END AS inline, lang || '/' || doc_id AS chunk_key
FROM documents""")
def parse_reference_entries(t: Tables) -> DataFrame:
    """Reference entries, inline text or [path, offset, length], from the document table."""
    doc, chars = F.col("doc_id"), F.col("n_chars")
    entry = F.when(chars < 200, F.concat(F.lit("short "), doc.cast("string"))).otherwise(
        F.format_string('["%s",%d,%d]', "source", doc * 10, chars))
    entries = t("documents").select(
        F.concat(F.lit("set-"), (doc % 7).cast("string")).alias("ref_set"),
        F.concat("lang", F.lit("/"), doc.cast("string")).alias("chunk_key"), entry.alias("entry"))
    return refs.parse_entries(entries)


@query(f"""WITH {FIELDS}, stored AS (SELECT DISTINCT cycle, variable, step_index FROM fields)
SELECT cycle, variable, step_index, 1 AS copies FROM stored""")
def publish_files(t: Tables) -> DataFrame:
    """Every payload file copied to a second folder; a second run has nothing to do."""
    landing, _ = _landing(t)
    target = new_dir(t.spark, "published")
    source = relative_to(list_files(t.spark, landing), landing)
    publish.incremental(source, source.where(F.lit(False)), landing, target)
    copied = relative_to(list_files(t.spark, target), target)
    again = publish.plan(source, copied)
    parts = F.regexp_extract
    pattern = r"^(\d{8}_\d{2})/(.+)_step(\d+)\.grib2$"
    return shaped(again.where("action = 'same'").groupBy(
        parts("path", pattern, 1).alias("cycle"), parts("path", pattern, 2).alias("variable"),
        parts("path", pattern, 3).alias("step_index")).agg(F.count("*").alias("copies")),
        ["step_index", "copies"], keep=["cycle", "variable"])


@query("""SELECT strftime(c, '%Y%m%d_%H') AS cycle, variable, 3 * 2 AS n_fields, 3 * 2 * 12 AS n_cells, true AS in_range
FROM (SELECT DISTINCT make_timestamp(epoch_us(ts) // 21600000000 * 21600000000) AS c FROM events),
     (SELECT unnest(['t2m', 'u10', 'v10', 'sp']) AS variable)""")
def synthetic_cycles(t: Tables) -> DataFrame:
    """Random fields for every cycle of the event stream: 3 steps, 2 members, 3 x 4 cells."""
    cycles = t("events").select(floor_cycle("ts").alias("cycle_time")).distinct()
    made = synth.generate_cycle(cycles, store.StoreSpec(members=2, n_lat=3, n_lon=4), max_steps=3)
    low, high = F.array_min("values"), F.array_max("values")
    inside = (low >= F.col("min_value")) & (high <= F.col("max_value"))
    return shaped(synth.with_variable(made).groupBy(cycle(), "variable").agg(
        F.count("*").alias("n_fields"), F.sum(F.size("values")).alias("n_cells"),
        F.bool_and(inside).alias("in_range")), ["n_fields", "n_cells"], keep=["cycle", "variable", "in_range"])
