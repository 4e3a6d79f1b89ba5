"""Statistics from the moments that a store keeps beside every grid: no grid is read.

Moments of a row are its number of cells, and of its valid cells the number, least, largest and mean value and the sum of squared
deviations from that mean. Those of several rows follow by the parallel formula for the variance: every row's squared
deviations, and what its mean deviates from the mean of all.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

MOMENTS = T.StructType([
    T.StructField("n_cells", T.LongType()), T.StructField("n", T.LongType()), T.StructField("min", T.DoubleType()),
    T.StructField("max", T.DoubleType()), T.StructField("mean", T.DoubleType()), T.StructField("m2", T.DoubleType())])


def of(values: Column | str) -> Column:
    """The moments of a grid; NaN and NULL cells are missing, and without a valid cell all but the counts is NULL."""

    @F.arrow_udf(MOMENTS)
    def moments(grids: pa.Array) -> pa.Array:
        rows = []
        for grid in grids:
            if not grid.is_valid:
                rows.append({"n_cells": 0, "n": 0})
                continue
            cells = grid.values.to_numpy(zero_copy_only=False).astype(np.float64)
            found = cells[~np.isnan(cells)]
            row = {"n_cells": len(cells), "n": len(found)}
            if len(found):
                mean = found.mean()
                row |= {"min": found.min(), "max": found.max(), "mean": mean, "m2": ((found - mean) ** 2).sum()}
            rows.append(row)
        kinds = {"n_cells": pa.int64(), "n": pa.int64()}
        return pa.array(rows, pa.struct([(f.name, kinds.get(f.name, pa.float64())) for f in MOMENTS.fields]))

    return moments(values)


def _given(rows: DataFrame, by: list[str]) -> DataFrame:
    known = F.when(F.col("moments").isNotNull(), F.col("moments")).otherwise(
        F.raise_error(F.lit("a grid without moments: run store.add_moments")))
    return rows.select(*by, known.alias("m")).select(*by, "m.*")


def describe(rows: DataFrame, by: list[str] = ("variable",)) -> DataFrame:
    """Per group ``n_cells``, ``n`` (valid cells), ``nan_pct``, ``min``, ``max``, ``mean`` and population ``std`` (NULL without a valid cell).

    ``rows`` has a column ``moments``, as ``store.open_moments`` gives it. The means of the groups are found first, then the deviations from them.
    """
    by = list(by)
    given = _given(rows, by)
    level = given.groupBy(*by).agg(F.try_divide(F.sum(F.col("n") * F.col("mean")), F.sum("n")).alias("_mean"))
    joined = given.join(level.select(*[F.col(c).alias(f"_{c}") for c in by], "_mean"),
                        [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in by]) if by else given.crossJoin(F.broadcast(level))  # one row
    apart = F.col("mean") - F.col("_mean")
    return joined.groupBy(*by).agg(
        F.sum("n_cells").alias("n_cells"), F.sum("n").alias("n"),
        F.try_divide(F.lit(100.0) * (F.sum("n_cells") - F.sum("n")), F.sum("n_cells")).alias("nan_pct"), F.min("min").alias("min"), F.max("max").alias("max"),
        F.max("_mean").alias("mean"), F.sqrt(F.try_divide(F.sum(F.col("m2") + F.col("n") * apart * apart), F.sum("n"))).alias("std"))


def global_mean(rows: DataFrame, by: list[str] = ()) -> DataFrame:
    """``stats.global_mean`` from moments."""
    return _given(rows, list(by)).groupBy(*by).agg(F.try_divide(F.sum(F.col("n") * F.col("mean")), F.sum("n")).alias("mean"))


def nan_pct(rows: DataFrame, by: list[str] = ("variable",)) -> DataFrame:
    """``stats.nan_pct`` from moments."""
    return _given(rows, list(by)).groupBy(*by).agg(F.try_divide(F.lit(100.0) * (F.sum("n_cells") - F.sum("n")), F.sum("n_cells")).alias("nan_pct"))
