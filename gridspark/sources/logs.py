"""Telemetry logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, types as T

VISIBILITY = T.StructType([
    T.StructField("file_id", T.StringType()),
    T.StructField("variable", T.StringType()),
    T.StructField("forecast_hour", T.IntegerType()),
    T.StructField("step_index", T.IntegerType()),
    T.StructField("producer_release_utc", T.StringType()),
    T.StructField("consumer_visible_utc", T.StringType()),
    T.StructField("latency_ms", T.DoubleType()),
    T.StructField("na_poll_count", T.LongType()),
    T.StructField("total_poll_count", T.LongType()),
])


def read_csv(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """CSV logs by glob; the schema of foreign logs is inferred."""
    reader = spark.read.option("header", True)
    reader = reader.option("inferSchema", True) if schema is None else reader.schema(schema)
    return reader.csv(path)


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType = VISIBILITY) -> DataFrame:
    return spark.read.schema(schema).json(path)
