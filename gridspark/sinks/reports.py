"""Result sinks. Long lists stay rows: nothing is gathered to make a nested file."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame


def write_jsonl(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).json(path)


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).option("header", True).csv(path)


def write_report(summary: DataFrame, tests: DataFrame, path: str, keys: Sequence[str] = ()) -> None:
    """A report folder: ``summary`` as JSON, and under ``tests`` the rows behind it.

    With ``keys`` the test rows are partitioned like the summary, so the rows of one
    summary line are one folder however many they are.
    """
    # The whole report is replaced, also in a session that replaces partitions one by one.
    summary.write.mode("overwrite").json(f"{path}/summary")
    writer = tests.write.mode("overwrite").option("partitionOverwriteMode", "static")
    if keys:
        writer = writer.partitionBy(*keys)
    writer.json(f"{path}/tests")
