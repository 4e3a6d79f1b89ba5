"""Ingest of arriving files into a store, as a batch and as a stream."""

from __future__ import annotations

import json
import logging
import threading
import time
from collections.abc import Callable, Iterator
from contextlib import nullcontext
from dataclasses import dataclass, field, replace

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from gridspark.functions.scalars import parse_iso
from gridspark.operators import publish, store, telemetry
from gridspark.operators.joins import BROADCAST_BYTES, BROADCAST_ROWS
from gridspark.operators.store import StoreSpec
from gridspark.runtime import materialise, new_dir, observed, staging
from gridspark.sources.files import list_files
from gridspark.sources.ingest import decode_files
from gridspark.sources.manifests import MANIFEST, readable
from gridspark.streaming import arrivals
from gridspark.streaming.waiting import STATE, waiting_manifests

log = logging.getLogger(__name__)

WRITE_LOG = T.StructType([
    T.StructField("success", T.BooleanType()),
    T.StructField("path", T.StringType()),
    T.StructField("cycle_time", T.TimestampType()),
    T.StructField("variable", T.StringType()),
    T.StructField("step_index", T.IntegerType()),
    T.StructField("n_members", T.IntegerType()),
    T.StructField("error", T.StringType()),
])
BATCH_LOG = T.StructType([
    T.StructField("batch_id", T.LongType()),
    T.StructField("files_processed", T.LongType()),
    T.StructField("files_successful", T.LongType()),
    T.StructField("files_failed", T.LongType()),
    T.StructField("unresolved", T.LongType()),
    T.StructField("corrupt", T.LongType()),
    T.StructField("processing_ms", T.DoubleType()),
    T.StructField("publish_ms", T.DoubleType()),
    T.StructField("total_ms", T.DoubleType()),
    T.StructField("publish_error", T.StringType()),
])


@dataclass(frozen=True)
class IngestConfig:
    """Where files come from, where they go, and how."""

    landing: str
    store: str
    checkpoint: str
    logs: str
    spec: StoreSpec = field(default_factory=StoreSpec)
    source: str = "manifests"  # or "files"
    decoder: str | Callable = "framed"
    validate: str = "full"
    max_files: int = 100
    trigger: dict = field(default_factory=lambda: {"processingTime": "0 seconds"})
    since: str | None = None
    dedupe: str | None = None
    publish_to: str | None = None
    bands: int | None = None


def _stat(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    from gridspark.sources.files import locate

    for batch in batches:
        sizes = []
        for path in batch["path"]:
            fs, p = locate(path)
            info = fs.get_file_info(p)
            sizes.append(info.size if info.is_file else None)
        yield pd.DataFrame({"path": batch["path"], "size": pd.array(sizes, dtype="Int64"),
                            "release_ts": batch["release_ts"]})


def resolve_paths(files: DataFrame) -> DataFrame:
    """Add ``size`` to ``files(path, release_ts)``, NULL for files that do not exist.

    Only the named files are looked up; the landing folder, which grows, is not listed.
    """
    return files.select("path", "release_ts").mapInPandas(
        _stat, "path string, size long, release_ts timestamp")


def run_batch(files: DataFrame, store_path: str, spec: StoreSpec = StoreSpec(), validate: str = "full",
              decoder: str | Callable = "framed", process: Callable[[DataFrame], DataFrame] | None = None,
              bands: int | None = None, log_path: str | None = None) -> DataFrame:
    """Decode ``files(path[, size, release_ts])``, write the good ones, return a log row per file.

    Decoded rows are staged in the shared folder; the store and the log are both made
    from there. ``process`` may change the decoded fields before they are checked. The
    log is written to ``log_path``, or to a folder of its own.
    """
    return _run_batch(files, store_path, spec, validate, decoder, process, bands, log_path)[0]


def _run_batch(files: DataFrame, store_path: str, spec: StoreSpec, validate: str, decoder: str | Callable,
               process: Callable[[DataFrame], DataFrame] | None, bands: int | None, log_path: str | None) -> tuple[DataFrame, dict]:
    """The log of ``run_batch`` and its counters, which are taken while the rows are written."""
    spark = files.sparkSession
    if "release_ts" not in files.columns:
        files = files.withColumn("release_ts", F.lit(None).cast("timestamp"))
    decoded = decode_files(files, decoder, bands=bands, carry=["release_ts"])
    if process is not None:
        decoded = process(decoded)
    log_path = log_path or new_dir(spark, "write-log")
    with staging(spark, "batch") as folder:
        rows, n = observed(store.check(decoded, spec, validate), rows=F.count("*"), refused=F.count("error"))
        good = checked = materialise(rows, "checked", folder)
        n = n()
        if n["refused"]:
            # A file with any bad row is not written at all.
            rows, size = observed(checked.where(F.col("error").isNotNull()).select("source_path").distinct(),
                                  rows=F.count("*"), bytes=F.sum(F.octet_length("source_path")))
            bad = materialise(rows, "bad", folder)
            size = size()
            small = size["rows"] <= BROADCAST_ROWS and size["bytes"] <= BROADCAST_BYTES
            good = checked.where(F.col("error").isNull()).join(F.broadcast(bad) if small else bad, "source_path", "left_anti")
        if n["rows"] > n["refused"] and not (n["refused"] and good.isEmpty()):
            store.write_region(good, store_path)
        rows, files_n = observed(store.write_log(checked), files_processed=F.count("*"),
                                 files_successful=F.count_if("success"), files_failed=F.count_if(~F.col("success")))
        rows.write.mode("overwrite").parquet(log_path)
    return spark.read.schema(WRITE_LOG).parquet(log_path), files_n()


def _append(rows: DataFrame, path: str, stream: str) -> None:
    """Log rows of a batch. A replayed batch replaces its own rows; a stream that starts again with
    another checkpoint counts its batches from 0 and has rows of its own."""
    (rows.withColumn("stream_id", F.lit(stream)).write.mode("overwrite")
     .option("partitionOverwriteMode", "dynamic").partitionBy("stream_id", "batch_id").parquet(path))


def _stream_id(spark: SparkSession, checkpoint: str) -> str:
    """The identity that a query keeps in its checkpoint."""
    text = spark.read.text(f"{checkpoint}/metadata").first()
    return json.loads(text[0])["id"]


def _batch_files(batch: DataFrame, source: str) -> DataFrame:
    """Every file that the batch names, whatever else carries its id."""
    if source == "files":
        return batch.select("path", F.col("modified").alias("release_ts"))
    return readable(batch).groupBy(F.col("landing_path").alias("path")).agg(
        F.max(parse_iso("producer_release_utc")).alias("release_ts"))


SEEN = [*MANIFEST.names, "manifest_path", "modified_ms", "size", "corrupt"]


def still_waiting(spark: SparkSession, batch: DataFrame, table: str) -> DataFrame:
    """The manifests that cannot be read after ``batch``, with the state in which they were read: those of
    the batch, and those of ``table`` that the batch does not hold."""
    now = batch.where("corrupt").groupBy("manifest_path").agg(F.max(F.struct("modified_ms", "size")).alias("s")).select("manifest_path", "s.*")
    if not store.exists(spark, table):
        return now
    before = spark.read.schema(STATE).parquet(table).join(batch.select("manifest_path"), "manifest_path", "left_anti")
    return before.unionByName(now)


def batch_processor(config: IngestConfig, on_batch: Callable[[dict], None] | None = None,
                    process: Callable[[DataFrame], DataFrame] | None = None, turn: threading.Lock | None = None):
    """The body of each micro-batch; of several queries with one ``turn`` only one is at work at a time."""

    stream = None

    def run(batch: DataFrame, batch_id: int) -> None:
        if batch.isEmpty():
            return
        with turn or nullcontext():
            work(batch, batch_id)

    def work(batch: DataFrame, batch_id: int) -> None:
        nonlocal stream
        started = time.perf_counter()
        spark = batch.sparkSession
        stream = stream or _stream_id(spark, config.checkpoint)
        with staging(spark, "ingest") as folder:
            n_corrupt, corrupt = 0, None
            waiting = f"{config.logs}/waiting_manifests"
            if config.source != "files":
                rows, n = observed(batch.select(*SEEN), corrupt=F.count_if("corrupt"))
                batch = materialise(rows, "manifests", folder)
                # Nothing waits and nothing waited: the usual case.
                if n()["corrupt"] or store.exists(spark, waiting):
                    rows, n = observed(still_waiting(spark, batch, waiting), rows=F.count("*"))
                    corrupt = materialise(rows, "waiting", folder)
                    n_corrupt = n()["rows"]
            rows, n = observed(resolve_paths(_batch_files(batch, config.source)), unresolved=F.count_if(F.col("size").isNull()))
            found = materialise(rows, "arrivals", folder)
            unresolved = n()["unresolved"]
            result, counted = _run_batch(found.where(F.col("size").isNotNull()), config.store, config.spec, config.validate,
                                         config.decoder, process, config.bands, f"{folder}/log")
            _append(result.withColumn("batch_id", F.lit(batch_id).cast("long")), f"{config.logs}/write_log", stream)
            if corrupt is not None:
                corrupt.write.mode("overwrite").option("partitionOverwriteMode", "static").parquet(waiting)
            processing_ms = (time.perf_counter() - started) * 1000
            publish_ms, publish_error = 0.0, None
            if config.publish_to is not None and counted["files_successful"]:
                publish_error = _publish(spark, config, result, folder)
                publish_ms = (time.perf_counter() - started) * 1000 - processing_ms
            row = counted | {"batch_id": batch_id, "unresolved": unresolved, "corrupt": n_corrupt, "processing_ms": processing_ms,
                             "publish_ms": publish_ms, "total_ms": (time.perf_counter() - started) * 1000, "publish_error": publish_error}
            row = {c: row[c] for c in BATCH_LOG.names}
            _append(spark.createDataFrame([tuple(row.values())], BATCH_LOG), f"{config.logs}/batch_log", stream)
        if on_batch is not None:
            try:
                on_batch(row)
            except Exception:  # the caller's mistake must not stop the stream
                log.exception("batch callback failed")
    return run


def _publish(spark: SparkSession, config: IngestConfig, result: DataFrame, folder: str) -> str | None:
    """Copy what the batch changed; a failure is reported and the batch goes on.

    Only the partitions that the batch wrote to are listed and compared, and those whose
    last publish failed: a failure heals itself with the next batch.
    """
    waiting = f"{config.logs}/waiting_partitions"
    touched = result.where("success").select(*store.PARTITION).where(F.col("step_index") >= 0).distinct()
    if not store.exists(spark, config.publish_to):
        # What was stored before there was a published copy.
        touched = store.open_store(spark, config.store).select(*store.PARTITION).distinct()
    if store.exists(spark, waiting):
        touched = touched.unionByName(spark.read.parquet(waiting).select(*store.PARTITION)).distinct()
    touched = materialise(touched, "touched", folder)
    error = _sync(spark, config, touched, folder)
    left = touched if error else touched.where(F.lit(False))
    left.write.mode("overwrite").option("partitionOverwriteMode", "static").parquet(waiting)
    return error


def _sync(spark: SparkSession, config: IngestConfig, touched: DataFrame, folder: str) -> str | None:
    try:
        cycles = store.touched_cycles(touched)

        def listing(root: str) -> DataFrame:
            return publish.store_listing(store.open_store(spark, root, cycles=cycles), root, touched)

        source = listing(config.store)
        published = store.exists(spark, config.publish_to)
        destination = listing(config.publish_to) if published else source.where(F.lit(False))
        done = publish.incremental(source, destination, config.store, config.publish_to, delete=True, within=folder)
        failed = done.where(~F.col("success")).agg(F.count("*").alias("n"), F.min("error").alias("e")).first()
        return f"{failed['n']} files not published: {failed['e']}" if failed["n"] else None
    except Exception as e:
        log.exception("publish failed")
        return f"{type(e).__name__}: {e}"


class _Stops(StreamingQueryListener):
    """Stops a query when another one ends."""

    def __init__(self, leader: StreamingQuery, follower: StreamingQuery):
        self.leader, self.follower = str(leader.runId), follower

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        pass

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        if str(event.runId) == self.leader:
            self.follower.stop()


def _again(spark: SparkSession, config: IngestConfig, *how) -> StreamingQuery:
    """The query over manifests that wait. It has a checkpoint of its own: Spark cuts a backlog into batches only if every
    source of a query can, and a query cannot go on from a checkpoint with other sources than it has."""
    own = replace(config, checkpoint=f"{config.checkpoint.rstrip('/')}-waiting")
    rows = waiting_manifests(spark, f"{config.logs}/waiting_manifests", config.max_files).select(*SEEN)
    return (rows.writeStream.foreachBatch(batch_processor(own, *how)).option("checkpointLocation", own.checkpoint)
            .trigger(**config.trigger).start())


def start_ingest(spark: SparkSession, config: IngestConfig,
                 on_batch: Callable[[dict], None] | None = None,
                 process: Callable[[DataFrame], DataFrame] | None = None) -> StreamingQuery:
    """Start the stream arrivals -> decode -> region write -> publish -> logs.

    Progress is checkpointed. A batch that is replayed writes the same slots and the
    same log partitions again, so the store is as if it had run once.

    Manifests that wait are read by a second query. With a trigger that ends by itself it runs before the first one; else both run until
    the returned one is stopped, and their batches take turns.
    """
    if config.source == "files":
        stream = arrivals.arrivals(spark, config.landing, max_files=config.max_files, since=config.since)
    else:
        new = arrivals.manifests(spark, config.landing, config.max_files, config.since, config.dedupe)
        stream = new.withColumn("modified_ms", F.unix_millis("modified")).select(*SEEN)
    how = (on_batch, process, threading.Lock())
    ends = bool({"availableNow", "once"} & config.trigger.keys())
    if config.source != "files" and ends and store.exists(spark, f"{config.logs}/waiting_manifests"):
        _again(spark, config, *how).awaitTermination()
    query = (stream.writeStream.foreachBatch(batch_processor(config, *how))
             .option("checkpointLocation", config.checkpoint)
             .trigger(**config.trigger).start())
    if config.source != "files" and not ends:
        spark.streams.addListener(_Stops(query, _again(spark, config, *how)))
    return query


class IngestManager:
    """Lifecycle of one ingest stream."""

    def __init__(self, spark: SparkSession, config: IngestConfig):
        self.spark, self.config, self.query = spark, config, None

    def start(self, on_batch=None, process=None) -> StreamingQuery:
        if self.is_active:
            raise RuntimeError("ingest is running")
        self.query = start_ingest(self.spark, self.config, on_batch, process)
        return self.query

    def stop(self) -> None:
        if self.query is not None:
            self.query.stop()

    def await_termination(self, timeout: float | None = None) -> bool:
        if self.query is None:
            raise RuntimeError("ingest was not started")
        if timeout is None:
            self.query.awaitTermination()
            return True
        return self.query.awaitTermination(timeout)

    @property
    def is_active(self) -> bool:
        return self.query is not None and self.query.isActive

    def batch_log(self) -> DataFrame | None:
        path = f"{self.config.logs}/batch_log"
        return self.spark.read.schema(BATCH_LOG).parquet(path) if store.exists(self.spark, path) else None

    def status(self) -> dict:
        if self.query is None:
            return {"state": "not started"}
        return {"state": "running" if self.is_active else "stopped", "id": str(self.query.id),
                "run_id": str(self.query.runId), "recent_progress": self.query.recentProgress}

    def metrics(self) -> dict:
        """Totals over all batches, empty before the first."""
        batches = self.batch_log()
        row = None if batches is None else telemetry.pipeline_metrics(batches).first()
        return {} if row is None else row.asDict()

    def backlog(self) -> DataFrame:
        listing = list_files(self.spark, self.config.landing)
        path = f"{self.config.logs}/write_log"
        if not store.exists(self.spark, path):
            return listing.agg(F.count("*").alias("files_outstanding"),
                               F.coalesce(F.sum("size"), F.lit(0)).alias("bytes_outstanding"))
        return arrivals.backlog(listing, self.spark.read.schema(WRITE_LOG).parquet(path))
