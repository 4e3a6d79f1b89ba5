"""JSON manifests beside the payload files."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from gridspark.functions.naming import emit_name
from gridspark.sources.files import MANIFEST_GLOB

MANIFEST = T.StructType([
    T.StructField("file_id", T.StringType()),
    T.StructField("variable", T.StringType()),
    T.StructField("forecast_hour", T.IntegerType()),
    T.StructField("landing_path", T.StringType()),
    T.StructField("producer_write_start_utc", T.StringType()),
    T.StructField("producer_release_utc", T.StringType()),
])
WITH_CORRUPT = T.StructType([*MANIFEST.fields, T.StructField("_corrupt_record", T.StringType())])


def file_path() -> Column:
    """The path of the file that a row was read from, as file systems know it: Spark gives it as an escaped URI."""
    return F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))


def read_manifests(spark: SparkSession, landing: str | list[str]) -> DataFrame:
    """All manifests of a landing folder, or the given ones; a half-written one is a row with ``corrupt``.

    Manifests are pretty-printed, so each file is one record over several lines.
    """
    rows = (spark.read.schema(WITH_CORRUPT).option("multiLine", True).option("mode", "PERMISSIVE")
            .option("columnNameOfCorruptRecord", "_corrupt_record")
            .option("pathGlobFilter", MANIFEST_GLOB).option("ignoreMissingFiles", True).json(landing))
    return mark_corrupt(rows.select("*", file_path().alias("manifest_path")))


def mark_corrupt(rows: DataFrame) -> DataFrame:
    bad = F.col("_corrupt_record").isNotNull() | F.col("file_id").isNull() | F.col("landing_path").isNull()
    return rows.withColumn("corrupt", bad).drop("_corrupt_record")


def readable(manifests: DataFrame) -> DataFrame:
    return manifests.where(~F.col("corrupt"))


def quarantine(manifests: DataFrame) -> DataFrame:
    """Manifests to try again at the next poll."""
    return manifests.where("corrupt").select("manifest_path")


def dedupe(manifests: DataFrame, key: str = "manifest_path") -> DataFrame:
    """One row per manifest, however often it was listed."""
    rest = [c for c in manifests.columns if c != key]
    return (manifests.groupBy(key).agg(F.min(F.struct(*rest)).alias("_m"))
            .select(key, *[f"_m.{c}" for c in rest]))


def latest_manifest(manifests: DataFrame, key: str = "file_id",
                    order: tuple[str, ...] = ("producer_release_utc", "manifest_path")) -> DataFrame:
    """The last manifest of every file, combined before the shuffle."""
    rest = [c for c in manifests.columns if c not in (key, *order)]
    newest = F.max(F.struct(*order, *rest)).alias("_m")
    return manifests.groupBy(key).agg(newest).select(key, *[f"_m.{c}" for c in (*order, *rest)])


def to_json(df: DataFrame, name: str = "manifest") -> DataFrame:
    """Manifest columns as one JSON text."""
    return df.withColumn(name, F.to_json(F.struct(*MANIFEST.names)))


def from_json(df: DataFrame, column: str = "manifest") -> DataFrame:
    return df.select("*", F.from_json(column, MANIFEST).alias("_m")).select(
        *[c for c in df.columns if c not in MANIFEST.names], "_m.*")


def _write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    from gridspark.sources.files import put_file

    for batch in batches:
        for row in batch.to_dict("records"):
            path = row.pop("manifest_path")
            put_file(path, (json.dumps(row, indent=2) + "\n").encode())
        yield batch[["file_id", "manifest_path"]]


def write_manifests(manifests: DataFrame, landing: str) -> DataFrame:
    """One pretty-printed JSON file per row, each appearing when complete.

    Returns ``(file_id, manifest_path)``; the files are written when it is evaluated,
    and writing them again gives the same files.
    """
    name = emit_name("variable", "forecast_hour", "producer_release_utc", "file_id")
    rows = manifests.select(
        *MANIFEST.names, F.concat(F.lit(landing.rstrip("/") + "/"), name, F.lit(".json")).alias("manifest_path"))
    return rows.mapInPandas(_write, "file_id string, manifest_path string")
