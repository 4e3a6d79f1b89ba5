"""Domain views over the given tables, and the same views as SQL common table expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from gridspark.functions.axes import StepAxis
from gridspark.functions.naming import cycle_name
from gridspark.operators.store import StoreSpec
from gridspark.plans.registry import Tables

# The grids come from vectors of 64 numbers: 8 x 8 cells, steps 0 to 2, 50 members.
SPEC = StoreSpec(members=50, n_lat=8, n_lon=8, axis=StepAxis(2, 2, 2))


def fields(t: Tables, missing: bool = False) -> DataFrame:
    """One grid per vector: 50 consecutive vectors share a cycle, the label gives variable
    and step. With ``missing``, every 17th cell (shifted by the vector) is NaN."""
    label = F.col("label")
    values = F.col("embedding")
    if missing:
        values = F.transform(values, lambda v, i: F.when(
            (F.col("vec_id") + i) % 17 == 0, F.lit(float("nan")).cast("float")).otherwise(v))
    seconds = F.unix_seconds(F.lit("2024-01-01 00:00:00").cast("timestamp"))
    return t("embeddings").select(
        F.timestamp_seconds(seconds + F.floor(F.col("vec_id") / 50) * 21600).alias("cycle_time"),
        F.when(label % 4 == 0, "t2m").when(label % 4 == 1, "u10").when(label % 4 == 2, "v10")
        .otherwise("sp").alias("variable"),
        F.floor(label / 4).cast("int").alias("step_index"),
        (F.col("vec_id") % 50).cast("int").alias("number"),
        F.lit(0).alias("lat_start"), F.lit(8).alias("n_lat"), F.lit(8).alias("n_lon"),
        values.alias("values"),
        F.format_string("vec/%d", "vec_id").alias("source_path"),
        F.lit("2024-01-01 00:00:00").cast("timestamp").alias("release_ts"))


FIELDS = """
fields AS (
  SELECT vec_id, vec_id // 50 AS cycle_no,
         strftime(TIMESTAMP '2024-01-01 00:00:00' + to_hours((vec_id // 50) * 6), '%Y%m%d_%H') AS cycle,
         CASE label % 4 WHEN 0 THEN 't2m' WHEN 1 THEN 'u10' WHEN 2 THEN 'v10' ELSE 'sp' END AS variable,
         CAST(label // 4 AS BIGINT) AS step_index, CAST(vec_id % 50 AS BIGINT) AS number, embedding
  FROM embeddings)"""

# value is NULL where the Spark view has NaN; raw is the unmodified cell.
CELLS = FIELDS + """,
cells AS (
  SELECT cycle_no, cycle, variable, step_index, number, CAST(pos // 8 AS BIGINT) AS lat_idx,
         CAST(pos % 8 AS BIGINT) AS lon_idx, v AS raw,
         CASE WHEN (vec_id + pos) % 17 = 0 THEN NULL ELSE v END AS value
  FROM (SELECT *, CAST(unnest(embedding) AS DOUBLE) AS v,
               generate_subscripts(embedding, 1) - 1 AS pos FROM fields))"""


def arrivals(t: Tables) -> DataFrame:
    """One emitted file per event."""
    kind = F.col("event_type")
    release = F.col("ts").cast("timestamp")
    latency_us = F.round(F.col("value") * 1_000_000).cast("long")
    return t("events").select(
        F.col("event_id").cast("string").alias("file_id"), "event_id",
        F.when(kind == "click", "t2m").when(kind == "view", "u10").when(kind == "purchase", "v10")
        .when(kind == "signup", "sp").otherwise("msl").alias("variable"),
        (F.col("event_id") % 361).cast("int").alias("forecast_hour"),
        release.alias("producer_release_utc"),
        F.timestamp_micros(F.unix_micros(release) + latency_us).alias("consumer_visible_utc"),
        (F.col("value") * 1000).alias("latency_ms"),
        (kind != "error").alias("success"),
        F.format_string("/landing/%s/%d.grib2", "event_type", "event_id").alias("landing_path"))


ARRIVALS = """
arrivals AS (
  SELECT CAST(event_id AS VARCHAR) AS file_id, event_id,
         CASE event_type WHEN 'click' THEN 't2m' WHEN 'view' THEN 'u10' WHEN 'purchase' THEN 'v10'
                         WHEN 'signup' THEN 'sp' ELSE 'msl' END AS variable,
         event_id % 361 AS forecast_hour, ts AS producer_release_utc,
         ts + to_microseconds(CAST(round(value * 1000000) AS BIGINT)) AS consumer_visible_utc,
         value * 1000 AS latency_ms, event_type <> 'error' AS success,
         '/landing/' || event_type || '/' || event_id || '.grib2' AS landing_path
  FROM events)"""

# The default step axis.
STEPS = """
steps AS (
  SELECT row_number() OVER (ORDER BY forecast_hour) - 1 AS step_index, forecast_hour
  FROM (SELECT unnest(generate_series(0, 90)) AS forecast_hour
        UNION ALL SELECT unnest(generate_series(93, 144, 3))
        UNION ALL SELECT unnest(generate_series(150, 360, 6))))"""


def _pick(values: list, index: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (index + 1).cast("int"))


def access(t: Tables) -> DataFrame:
    """One telemetry row per event; reads of the pattern ``error`` fail."""
    user = F.col("user_id")
    return t("events").select(
        F.col("event_id").alias("test_id"), F.col("event_type").alias("access_pattern"),
        F.col("ts").cast("timestamp").alias("start_ts"),
        F.col("value").alias("total_ms"), (F.col("value") * 0.2).alias("open_ms"),
        (F.col("value") * 0.3).alias("read_ms"), (F.col("value") * 0.5).alias("compute_ms"),
        F.col("value").alias("write_ms"), F.col("value").alias("sync_ms"),
        (user % 50 + 1).cast("double").alias("size_mb"),
        (user % 10).cast("double").alias("nan_pct"),
        F.pow(F.lit(2), user % 6).cast("int").alias("concurrency"),
        _pick([1, 5, 10, 25, 50], user % 5).alias("num_changed_chunks"),
        F.when(user % 2 == 0, "even").otherwise("odd").alias("engine"),
        (user % 4 + 1).cast("int").alias("num_stores"),
        _pick([1, 4, 12, 24], user % 4).alias("step_count"),
        _pick([1, 10, 50], user % 3).alias("ensemble_count"),
        _pick([50, 180, 361], F.floor(user / 3) % 3).alias("lat_count"),
        _pick([100, 360, 720], F.floor(user / 3) % 3).alias("lon_count"),
        (F.col("event_type") != "error").alias("success"))


ACCESS = """
access AS (
  SELECT event_id AS test_id, event_type AS access_pattern, ts AS start_ts, value AS total_ms,
         value * 0.2 AS open_ms, value * 0.3 AS read_ms, value * 0.5 AS compute_ms,
         value AS write_ms, value AS sync_ms,
         CAST(user_id % 50 + 1 AS DOUBLE) AS size_mb, CAST(user_id % 10 AS DOUBLE) AS nan_pct,
         CAST(pow(2, user_id % 6) AS BIGINT) AS concurrency,
         list_extract([1, 5, 10, 25, 50], user_id % 5 + 1) AS num_changed_chunks,
         CASE WHEN user_id % 2 = 0 THEN 'even' ELSE 'odd' END AS engine,
         user_id % 4 + 1 AS num_stores,
         list_extract([1, 4, 12, 24], user_id % 4 + 1) AS step_count,
         list_extract([1, 10, 50], user_id % 3 + 1) AS ensemble_count,
         list_extract([50, 180, 361], (user_id // 3) % 3 + 1) AS lat_count,
         list_extract([100, 360, 720], (user_id // 3) % 3 + 1) AS lon_count,
         event_type <> 'error' AS success
  FROM events)"""


def writes(t: Tables) -> DataFrame:
    """Many writes per slot: one-cell grids, a cycle per year of shipping."""
    return t("lineitem").select(
        F.date_trunc("year", "l_shipdate").cast("timestamp").alias("cycle_time"),
        F.col("l_returnflag").alias("variable"), (F.col("l_linenumber") - 1).cast("int").alias("step_index"),
        (F.col("l_suppkey") % 50).cast("int").alias("number"),
        F.col("l_quantity").alias("value"),
        F.col("l_shipdate").cast("timestamp").alias("release_ts"),
        "l_orderkey", "l_partkey", "l_extendedprice", "l_suppkey")


WRITE_ORDER = ["release_ts", "l_orderkey", "l_partkey", "l_extendedprice", "l_suppkey"]

WRITES = """
writes AS (
  SELECT year(l_shipdate) AS cycle_year, l_returnflag AS variable, l_linenumber - 1 AS step_index,
         l_suppkey % 50 AS number, l_quantity AS value, l_shipdate AS release_ts,
         l_orderkey, l_partkey, l_extendedprice, l_suppkey
  FROM lineitem),
winners AS (
  SELECT * FROM (
    SELECT *, row_number() OVER (
      PARTITION BY cycle_year, variable, step_index, number
      ORDER BY release_ts DESC, l_orderkey DESC, l_partkey DESC, l_extendedprice DESC, l_suppkey DESC) AS rn
    FROM writes) WHERE rn = 1)"""


def write_fields(t: Tables) -> DataFrame:
    """``writes`` as store rows; the write order is folded into the source path."""
    cents = F.round(F.col("l_extendedprice") * 100).cast("long")
    order = F.concat_ws("-", *[F.lpad(c.cast("string"), 15, "0") for c in (
        F.col("l_orderkey"), F.col("l_partkey"), cents, F.col("l_suppkey"))])
    return writes(t).select(
        "cycle_time", "variable", "step_index", "number", F.lit(0).alias("lat_start"),
        F.lit(1).alias("n_lat"), F.lit(1).alias("n_lon"),
        F.array(F.col("value").cast("float")).alias("values"), order.alias("source_path"), "release_ts")


def polls(t: Tables) -> DataFrame:
    """One poll per event and user; only purchases see a value."""
    return t("events").select(
        F.col("user_id").cast("string").alias("file_id"), F.col("ts").cast("timestamp").alias("poll_ts"),
        F.when(F.col("event_type") == "purchase", F.col("value"))
        .otherwise(F.lit(float("nan"))).alias("value"))


POLLS = """
polls AS (
  SELECT CAST(user_id AS VARCHAR) AS file_id, ts AS poll_ts,
         CASE WHEN event_type = 'purchase' THEN value END AS value
  FROM events)"""


def listings(t: Tables) -> tuple[DataFrame, DataFrame]:
    """Source and destination of a sync: all documents against the labelled ones, whose
    size differs for the poor ones, and pages that only the destination has."""
    documents = t("documents")
    name = F.format_string("doc/%d", "doc_id")
    source = documents.select(name.alias("path"), F.col("n_chars").alias("size"))
    size = F.when(F.col("quality") == 0, F.col("n_chars") + 1).otherwise(F.col("n_chars"))
    labels = t("labels").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    copied = documents.join(labels, "doc_id").select(name.alias("path"), size.alias("size"))
    extra = t("pages").select(
        F.format_string("page/%d", "page_id").alias("path"), F.length("url").cast("long").alias("size"))
    return source, copied.unionByName(extra)


LISTINGS = """
src AS (SELECT 'doc/' || doc_id AS path, n_chars AS size FROM documents),
dst AS (
  SELECT 'doc/' || d.doc_id AS path, CASE WHEN l.quality = 0 THEN n_chars + 1 ELSE n_chars END AS size
  FROM documents d JOIN (SELECT doc_id, max(quality) AS quality FROM labels GROUP BY doc_id) l
    ON d.doc_id = l.doc_id
  UNION ALL SELECT 'page/' || page_id, length(url) FROM pages)"""


def put_texts(files: DataFrame) -> int:
    """Write ``files(path, content)``; the number of files."""
    def put(batches):
        from gridspark.sources.files import put_file

        for batch in batches:
            for path, content in zip(batch["path"], batch["content"], strict=True):
                put_file(path, content.encode())
            yield batch[["path"]]

    return files.select("path", "content").mapInPandas(put, "path string").count()


def cycle() -> Column:
    return cycle_name("cycle_time", "").alias("cycle")
