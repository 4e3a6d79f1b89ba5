"""Registry of named queries: a Spark plan and, where SQL can say it, its SQL twin."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from gridspark.runtime import prepare


@dataclass(frozen=True)
class Tables:
    """The given tables below one folder."""

    spark: SparkSession
    folder: str

    def __call__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")


@dataclass(frozen=True)
class Query:
    plan: Callable[[Tables], DataFrame]
    sql: str | None


QUERIES: dict[str, Query] = {}


def query(sql: str | None = None):
    """Register a plan under its function name."""

    def register(plan: Callable[[Tables], DataFrame]):
        if plan.__name__ in QUERIES:
            raise ValueError(f"{plan.__name__} is registered twice")
        QUERIES[plan.__name__] = Query(plan, sql)
        return plan

    return register


def run(name: str, spark: SparkSession, folder: str) -> DataFrame:
    return QUERIES[name].plan(Tables(prepare(spark), folder.rstrip("/")))


# -- output columns, the same in both engines ---------------------------------------

def r6(c: Column | str) -> Column:
    """DOUBLE rounded to six places."""
    return F.round((F.col(c) if isinstance(c, str) else c).cast("double"), 6)


def big(c: Column | str) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("bigint")


def shaped(df: DataFrame, ints: list[str] = (), floats: list[str] = (), keep: list[str] = ()) -> DataFrame:
    """Select columns with their output types."""
    return df.select(*keep, *[big(c).alias(c) for c in ints], *[r6(c).alias(c) for c in floats])
