"""Session settings and the shared folder that jobs may write to."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
import warnings
import zipfile
from collections.abc import Callable, Iterator
from contextlib import contextmanager, suppress
from pathlib import Path

from pyspark.sql import Column, DataFrame, Observation, SparkSession

# Runtime settings every plan here relies on. They are SQL settings, so they can
# be applied to a session somebody else created.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # One hot key may hold a large share of the rows: let AQE split its partition,
    # even where that costs the aggregate above the join another shuffle.
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    # Without it a computed array that is exploded is computed again to see if it is empty.
    "spark.sql.optimizer.excludedRules":
        "org.apache.spark.sql.catalyst.optimizer.InferFiltersFromGenerate",
    # A full grid row is about 1 MB: bound Arrow batches by bytes, not only by rows.
    "spark.sql.execution.arrow.maxBytesPerBatch": "64m",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
    # The shuffle files of a finished query go at once, not when the driver collects its garbage:
    # what is needed again is a written table.
    "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true",
    # Keyed state of the visibility follower is kept outside the JVM heap.
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    # A batch writes what it changed in the state, not the state: many small batches would each upload all of it.
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}

# Settings of streams, see ``stream_settings``. The log of the files read is put together every so many batches: all of them are written
# again. The parts of logs that were put together go soon: every batch lists what is there.
STREAM_SETTINGS = {
    "spark.sql.streaming.fileSource.log.compactInterval": "100",
    "spark.sql.streaming.fileSource.log.cleanupDelay": "1m",
    "spark.sql.streaming.fileSink.log.cleanupDelay": "1m",
}
# Those of streams on a local disk. There Hadoop starts a process to see if a file is a link, which the usual manager of checkpoint
# files asks several times for each. The files of this one have Hadoop's checksums beside them and need no second ones.
# The driver looks at the files of a batch itself: a job that lists some hundred local files takes longer.
LOCAL_STREAM_SETTINGS = {
    "spark.sql.streaming.checkpointFileManagerClass":
        "org.apache.spark.sql.execution.streaming.checkpointing.FileSystemBasedCheckpointFileManager",
    "spark.sql.streaming.checkpoint.fileChecksum.enabled": "false",
    "spark.sql.sources.parallelPartitionDiscovery.threshold": "1000",
}

LISTING_CONF = "spark.sql.sources.parallelPartitionDiscovery.parallelism"
PARTITIONS_CONF = "spark.sql.shuffle.partitions"
CHECKPOINT_CONF = "spark.checkpoint.dir"
# Remembers the fallback of a local session; the setting above is fixed at start.
OWN_DIR_CONF = "gridspark.shared.dir"
# The folder of this session's intermediate tables, below the shared one.
RUN_DIR_CONF = "gridspark.run.dir"
SHIPPED_CONF = "gridspark.shipped"


def prepare(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings to ``spark``, send the package to its workers, and return it."""
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    _ship(spark)
    return spark


def _ship(spark: SparkSession) -> None:
    """Workers import the package from a zip file, unless PYTHONPATH leads them to it."""
    root = Path(__file__).resolve().parents[1]
    led = any(Path(p).resolve() == root for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p)
    if led or spark.conf.get(SHIPPED_CONF, None):
        return
    target = Path(tempfile.mkdtemp(prefix="gridspark-package-")) / "gridspark.zip"
    with zipfile.ZipFile(target, "w") as z:
        for file in sorted((root / "gridspark").rglob("*.py")):
            z.write(file, file.relative_to(root))
    spark.sparkContext.addPyFile(str(target))
    spark.conf.set(SHIPPED_CONF, "true")


def session(app: str = "gridspark", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings applied; ``conf`` keys use ``_`` for ``.``."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **{k.replace("_", "."): v for k, v in conf.items()}}.items():
        builder = builder.config(key, value)
    return prepare(builder.getOrCreate())


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors can see, as the cluster names it.

    Only a local master may fall back to a temporary folder: there the driver
    and the executors are one process, so the folder is shared by definition.
    """
    named = spark.conf.get(CHECKPOINT_CONF, None) or spark.conf.get(OWN_DIR_CONF, None)
    if named:
        master = spark.sparkContext.master
        if not master.startswith("local") and hadoop_path(spark, named)[0].getScheme() == "file":
            warnings.warn(f"{CHECKPOINT_CONF} is {named}: this must be mounted at the same place on all machines", stacklevel=2)
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError(f"{CHECKPOINT_CONF} must name a folder all executors can reach")
    own = tempfile.mkdtemp(prefix="gridspark-")
    spark.conf.set(OWN_DIR_CONF, own)
    return own


def new_dir(spark: SparkSession, label: str) -> str:
    """A path in the session's own part of the shared folder, that nothing else uses."""
    run = spark.conf.get(RUN_DIR_CONF, None)
    if run is None:
        run = f"{shared_dir(spark)}/gridspark-run-{uuid.uuid4().hex}"
        spark.conf.set(RUN_DIR_CONF, run)
        atexit.register(_clean_at_exit, spark)
    return f"{run}/{label}-{uuid.uuid4().hex}"


def clean(spark: SparkSession) -> None:
    """Remove all intermediate tables of this session; results that were not computed yet are lost.

    It is done by itself when the driver ends.
    """
    run = spark.conf.get(RUN_DIR_CONF, None)
    if run is not None:
        fs, where = hadoop_path(spark, run)
        fs.delete(where, True)
        spark.conf.unset(RUN_DIR_CONF)


def _clean_at_exit(spark: SparkSession) -> None:
    # The session may have been stopped before.
    with suppress(Exception):
        clean(spark)


def materialise(df: DataFrame, label: str, within: str | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    The written table survives the loss of executors, cuts the lineage, and has a
    file size the optimizer can compare with its broadcast threshold. ``within`` is a
    folder from ``staging``; without one the table stays.
    """
    spark = df.sparkSession
    path = new_dir(spark, label) if within is None else f"{within}/{label}-{uuid.uuid4().hex}"
    df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def observed(df: DataFrame, **counters: Column) -> tuple[DataFrame, Callable[[], dict[str, int]]]:
    """``df`` with counters that the next job over it takes on its way, and a function that tells them after it.

    To be written as it is: behind a shuffle, a stage that runs again would count again.
    """
    seen = Observation()
    # Spark leaves out what it knows to be empty, and its counters too.
    return df.observe(seen, *[c.alias(k) for k, c in counters.items()]), lambda: {k: seen.get.get(k) or 0 for k in counters}


@contextmanager
def stream_settings(spark: SparkSession, folder: str) -> Iterator[None]:
    """Settings for streams that read, and keep their checkpoint, below ``folder``, while they run; values of the caller's own stay.

    Keyed state is dealt to a part per core at most: every part is opened and written at every batch, however few rows it gets.
    """
    local = hadoop_path(spark, folder)[0].getScheme() == "file"
    # The files of a batch are listed by a few tasks per core, not by one for each file.
    wanted = {**STREAM_SETTINGS, **(LOCAL_STREAM_SETTINGS if local else {}), LISTING_CONF: str(4 * spark.sparkContext.defaultParallelism)}
    added = {k: v for k, v in wanted.items() if spark.conf.get(k, None) is None}
    parts = spark.conf.get(PARTITIONS_CONF)
    for key, value in added.items():
        spark.conf.set(key, value)
    spark.conf.set(PARTITIONS_CONF, min(int(parts), spark.sparkContext.defaultParallelism))
    try:
        yield
    finally:
        for key in added:
            spark.conf.unset(key)
        spark.conf.set(PARTITIONS_CONF, parts)


def hadoop_path(spark: SparkSession, path: str):
    """File system and Hadoop path object of ``path``."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()), where


@contextmanager
def staging(spark: SparkSession, label: str) -> Iterator[str]:
    """A folder for the intermediate tables of one job.

    It goes away with the job that made it, and stays if the job fails: a stream that
    runs for months must not fill the shared folder.
    """
    path = new_dir(spark, label)
    yield path
    fs, where = hadoop_path(spark, path)
    fs.delete(where, True)
