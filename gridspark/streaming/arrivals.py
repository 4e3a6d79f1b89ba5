"""Streams of arriving files."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from gridspark.sources.files import LISTING, MANIFEST_GLOB, MESSAGE_GLOB
from gridspark.sources.manifests import WITH_CORRUPT, file_path, mark_corrupt


def _after(column: Column, since: datetime | str | None) -> Column:
    return F.lit(True) if since is None else column > F.lit(since).cast("timestamp")


def arrivals(spark: SparkSession, landing: str, glob: str = MESSAGE_GLOB, max_files: int = 100,
             since: datetime | str | None = None) -> DataFrame:
    """``(path, size, modified)`` of payload files as they arrive; contents are not read.

    ``since`` leaves out files that were there before.
    """
    rows = (spark.readStream.format("binaryFile").schema(LISTING)
            .option("pathGlobFilter", glob).option("recursiveFileLookup", True)
            .option("ignoreMissingFiles", True)
            .option("maxFilesPerTrigger", max_files).load(landing).drop("content"))
    return rows.where(_after(F.col("modificationTime"), since)).select(
        "path", F.col("length").alias("size"), F.col("modificationTime").alias("modified"))


def manifests(spark: SparkSession, landing: str, max_files: int = 100,
              since: datetime | str | None = None, dedupe: str | None = None) -> DataFrame:
    """Manifests as they arrive, with ``corrupt`` marked.

    ``dedupe`` (such as ``"1 day"``) drops a ``file_id`` that was read before within that time. The
    time is that of reading and not of release, so a manifest of any age comes through, and a
    ``file_id`` that has been forgotten can only come out twice.
    """
    rows = (spark.readStream.schema(WITH_CORRUPT).option("multiLine", True)
            .option("columnNameOfCorruptRecord", "_corrupt_record")
            .option("pathGlobFilter", MANIFEST_GLOB).option("recursiveFileLookup", True)
            .option("ignoreMissingFiles", True)
            .option("maxFilesPerTrigger", max_files).json(landing))
    rows = rows.select("*", file_path().alias("manifest_path"), F.col("_metadata.file_size").alias("size"),
                       F.col("_metadata.file_modification_time").alias("modified"))
    rows = mark_corrupt(rows.where(_after(F.col("modified"), since)))
    if dedupe is None:
        return rows
    # One that cannot be read yet has no id; it is known by its path.
    key = F.when(F.col("corrupt"), F.col("manifest_path")).otherwise(F.col("file_id"))
    return (rows.withColumn("read_at", F.current_timestamp()).withColumn("known_by", key)
            .withWatermark("read_at", dedupe).dropDuplicatesWithinWatermark(["known_by"]).drop("read_at", "known_by"))


def backlog(listing: DataFrame, write_log: DataFrame) -> DataFrame:
    """Files and bytes that have arrived and are not written yet."""
    rest = listing.join(write_log.where("success").select("path"), "path", "left_anti")
    return rest.agg(F.count("*").alias("files_outstanding"),
                    F.coalesce(F.sum("size"), F.lit(0)).alias("bytes_outstanding"))
