"""When did a consumer first see each emitted file?"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from gridspark.functions.axes import StepAxis, with_step_index
from gridspark.functions.scalars import is_missing, latency_ms
from gridspark.operators.joins import attach, fits, pending
from gridspark.runtime import materialise

__all__ = ["all_available", "from_polls", "join", "pending", "wait_result"]


def join(emitted: DataFrame, slots: DataFrame, axis: StepAxis = StepAxis()) -> DataFrame:
    """Emitted files with the time their slot became visible.

    ``slots(variable, step_index, consumer_visible_utc)`` may hold several rows per
    slot; the first one counts. Hours off the axis are never visible.
    """
    first = slots.groupBy("variable", "step_index").agg(
        F.min("consumer_visible_utc").alias("consumer_visible_utc"))
    return (with_step_index(emitted, axis).join(first, ["variable", "step_index"])
            .withColumn("latency_ms", latency_ms("producer_release_utc", "consumer_visible_utc")))


def from_polls(polls: DataFrame, key: str = "file_id", until: Column | None = None) -> DataFrame:
    """Per file: first poll with a value, and polls up to and including it.

    ``polls(file_id, poll_ts, value)``. A file never seen has no visible time and all
    its polls counted. Polls after ``until`` are ignored.
    """
    seen = polls if until is None else polls.where(F.col("poll_ts") <= until)
    first = seen.groupBy(key).agg(
        F.min(F.when(~is_missing("value"), F.col("poll_ts"))).alias("consumer_visible_utc"))
    open_poll = F.col("consumer_visible_utc").isNull() | (
        F.col("poll_ts") < F.col("consumer_visible_utc"))
    first = materialise(first, "first-seen")
    rows = attach(seen.select(key, "poll_ts", "value"), first, [key], fits(first))
    counts = rows.groupBy(key, "consumer_visible_utc").agg(
        F.count_if(open_poll).alias("na_poll_count"))
    return counts.withColumn(
        "total_poll_count",
        F.col("na_poll_count") + F.col("consumer_visible_utc").isNotNull().cast("long"))


def wait_result(polls: DataFrame, start: Column, timeout_seconds: float, key: str = "file_id") -> DataFrame:
    """``from_polls`` of a wait that gives up after ``timeout_seconds``."""
    limit = F.timestamp_micros(F.unix_micros(start) + int(timeout_seconds * 1_000_000))
    result = from_polls(polls, key, until=limit)
    return result.withColumn("visible", F.col("consumer_visible_utc").isNotNull())


def all_available(expected: DataFrame, slots: DataFrame, keys: list[str]) -> DataFrame:
    """One row: are all expected slots there?"""
    there = slots.select(*keys).distinct().withColumn("_there", F.lit(True))
    found = F.coalesce(F.col("_there"), F.lit(False))
    return expected.join(there, keys, "left").agg(
        F.coalesce(F.bool_and(found), F.lit(True)).alias("all_available"),
        F.count_if(~found).alias("n_missing"))
