"""Synthetic forecast cycles and landing files for tests and demonstrations."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from gridspark.functions.naming import data_name
from gridspark.functions.scalars import scale_unit
from gridspark.operators.store import StoreSpec, init_cycle, new_cycles

# Name, short name, discipline, category, number, level type, level,
# units, lowest and highest value.
VARIABLES = [
    ("t2m", "2t", 0, 0, 0, 103, 2, "K", 220.0, 320.0),
    ("u10", "10u", 0, 2, 2, 103, 10, "m s-1", -50.0, 50.0),
    ("v10", "10v", 0, 2, 3, 103, 10, "m s-1", -50.0, 50.0),
    ("sp", "sp", 0, 3, 0, 1, 0, "Pa", 87000.0, 108000.0),
]
VARIABLE_COLUMNS = ["variable", "short_name", "discipline", "category", "number_code", "level_type", "level",
                    "units", "min_value", "max_value"]


def literal_table(spark: SparkSession, rows: Sequence[Sequence], columns: Sequence[str]) -> DataFrame:
    """A few constant rows, made where they are used."""
    structs = [F.struct(*[F.lit(v).alias(c) for c, v in zip(columns, row)]) for row in rows]
    return spark.range(1).select(F.inline(F.array(*structs)))


def variable_table(spark: SparkSession) -> DataFrame:
    """The four configured variables."""
    return literal_table(spark, VARIABLES, VARIABLE_COLUMNS)


def with_variable(df: DataFrame) -> DataFrame:
    """Add units, range and level of the row's variable; NULL if it is not configured."""
    # Four rows.
    return df.join(F.broadcast(variable_table(df.sparkSession)), "variable", "left")


def cycle_times(spark: SparkSession, start: str, num_days: int = 7, cycle_hours: int = 6) -> DataFrame:
    """Reference times from ``start``, every ``cycle_hours``, for ``num_days``."""
    first = F.lit(start).cast("timestamp")
    seconds = F.sequence(F.lit(0), F.lit(num_days * 86400 - 1), F.lit(cycle_hours * 3600))
    return spark.range(1).select(F.explode(seconds).alias("s")).select(
        F.timestamp_seconds(F.unix_seconds(first) + F.col("s")).alias("cycle_time"))


def _uniform(seed: int) -> Column:
    """U(0,1) per cell from the slot and the position: the same in every retry."""
    return F.transform(
        F.sequence(F.lit(0), F.col("n_lat") * F.col("n_lon") - 1),
        lambda i: F.pmod(F.xxhash64(F.lit(seed), "cycle_time", "variable", "step_index", "number", i),
                         F.lit(1 << 52)) / F.lit(float(1 << 52)))


def generate_cycle(cycles: DataFrame, spec: StoreSpec, seed: int = 0, max_steps: int | None = None) -> DataFrame:
    """Fields of uniform noise within the range of each variable."""
    slots = init_cycle(cycles, spec)
    if max_steps is not None:
        slots = slots.where(F.col("step_index") < max_steps)
    ranged = with_variable(slots).withColumn("_u", _uniform(seed))
    noise = F.transform("_u", lambda u: scale_unit(u, "min_value", "max_value").cast("float"))
    return ranged.withColumn("values", noise).select(
        "cycle_time", "variable", "step_index", "forecast_hour", "number", "lat_start", "n_lat", "n_lon",
        "values", data_name("variable", "forecast_hour").alias("source_path"),
        F.col("cycle_time").alias("release_ts"))


def generate_cycles(spark: SparkSession, start: str, spec: StoreSpec, num_days: int = 7,
                    cycle_hours: int = 6, fill: float = 0.0, existing: DataFrame | None = None,
                    overwrite: bool = False) -> DataFrame:
    """A constant field in every slot of many cycles; stored cycles are skipped."""
    cycles = cycle_times(spark, start, num_days, cycle_hours)
    if existing is not None:
        cycles = new_cycles(cycles, existing, overwrite)
    return init_cycle(cycles, spec, fill).withColumn("source_path", F.lit(None).cast("string")) \
        .withColumn("release_ts", F.col("cycle_time"))


def grid_from_template(fields: DataFrame) -> DataFrame:
    """Grid sizes of an existing store, to generate on the same grid."""
    return fields.agg(F.max(F.col("lat_start") + F.col("n_lat")).alias("n_lat"),
                      F.max("n_lon").alias("n_lon"))


def _release(landing: str):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from gridspark.sources.files import put_file
        from gridspark.sources.messages import encode

        for batch in batches:
            for row in batch.itertuples(index=False):
                parts = []
                for m in sorted(row.members, key=lambda m: m["number"]):
                    header = {
                        "shortName": row.short_name, "cfVarName": row.variable,
                        "dataDate": row.data_date, "dataTime": row.data_time, "step": row.forecast_hour,
                        "perturbationNumber": int(m["number"]) + 1, "Nj": row.n_lat, "Ni": row.n_lon,
                        "numberOfForecastsInEnsemble": len(row.members)}
                    parts.append(encode(header, np.asarray(m["values"], "<f4").tobytes()))
                put_file(f"{landing}/{row.name}", b"".join(parts))
            yield batch[["path", "variable", "forecast_hour"]]
    return run


def release_files(fields: DataFrame, landing: str, capacity: int = 50) -> DataFrame:
    """Write each (cycle, variable, step) as one payload file of its members.

    ``capacity`` bounds the members of a file. Fields are whole grids; a band is an error.
    Returns the files written, once they are.
    """
    landing = landing.rstrip("/")
    whole = (F.size("values") == F.col("n_lat") * F.col("n_lon")) & (F.coalesce(F.col("lat_start"), F.lit(0)) == 0)
    inside = F.when((F.col("number") < capacity) & whole, F.struct("number", "values")).otherwise(
        F.raise_error(F.lit("member beyond the ensemble axis, or a band")))
    name = F.concat(F.date_format("cycle_time", "yyyyMMdd_HH"), F.lit("/"),
                    data_name("variable", "forecast_hour"), F.lit(".grib2"))
    files = (fields.groupBy("cycle_time", "variable", "forecast_hour", "n_lat", "n_lon")
             .agg(F.collect_list(inside).alias("members"))
             .withColumn("short_name", F.col("variable"))
             .withColumn("data_date", F.date_format("cycle_time", "yyyyMMdd").cast("int"))
             .withColumn("data_time", F.date_format("cycle_time", "HHmm").cast("int"))
             .withColumn("name", name)
             .withColumn("path", F.concat(F.lit(landing + "/"), "name")))
    return files.mapInPandas(_release(landing), "path string, variable string, forecast_hour int")
