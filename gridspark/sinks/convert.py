"""Conversion of payload files into datasets."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, functions as F

from gridspark.functions.naming import stem
from gridspark.functions.scalars import epoch_hours
from gridspark.operators.ranking import concat_index
from gridspark.runtime import materialise
from gridspark.sources.ingest import decode_files

LAYOUTS = {
    # Rows that are read together lie together.
    "time": ["valid_hours", "variable", "number"],
    "ensemble": ["variable", "number", "lat_start", "valid_hours"],
}


def _decoded(files: DataFrame, decoder: str | Callable, bands: int | None) -> DataFrame:
    rows = decode_files(files, decoder, bands=bands)
    # Both the data and the status are taken from it, so it is written once.
    return materialise(rows.withColumn("source_name", stem("source_path"))
                       .withColumn("valid_hours", epoch_hours("valid_time")), "decoded")


def _status(decoded: DataFrame) -> DataFrame:
    return decoded.groupBy("source_path").agg(
        F.max("error").isNull().alias("success"), F.max("error").alias("error"),
        F.max("n_members").alias("n_members"))


def individual(files: DataFrame, out: str, decoder: str | Callable = "framed",
               bands: int | None = None) -> DataFrame:
    """Each input as its own dataset below ``out``; returns the status per file."""
    decoded = _decoded(files, decoder, bands)
    (decoded.where(F.col("error").isNull()).drop("error")
     .hint("rebalance", "source_name")
     .write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy("source_name").parquet(out))
    return _status(decoded)


def stacked(files: DataFrame, out: str, decoder: str | Callable = "framed", layout: str = "time",
            bands: int | None = None) -> DataFrame:
    """All inputs as one dataset along ``valid_time``, replacing ``out``; returns the status.

    Times are stored as hours since 1970-01-01. ``layout`` orders the rows for reading
    whole times or whole members.
    """
    decoded = _decoded(files, decoder, bands)
    good = decoded.where(F.col("error").isNull()).drop("error", "source_name")
    indexed = concat_index(good, "source_path")
    order = LAYOUTS[layout]
    (indexed.repartitionByRange(*order, "source_path").sortWithinPartitions(*order)
     .write.mode("overwrite").option("partitionOverwriteMode", "static").parquet(out))
    return _status(decoded)
