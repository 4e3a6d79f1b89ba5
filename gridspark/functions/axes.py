"""Step, member and grid axes."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from gridspark.functions.scalars import _col

# A step axis is configuration, not data; this bound is what makes broadcasting it safe.
MAX_AXIS = 100_000


@dataclass(frozen=True)
class StepAxis:
    """Hourly up to ``hourly_to``, then every 3 h, then every 6 h (all inclusive)."""

    hourly_to: int = 90
    three_hourly_to: int = 144
    six_hourly_to: int = 360

    def column(self) -> Column:
        """The hours as one array expression."""
        h, t, s = self.hourly_to, self.three_hourly_to, self.six_hourly_to
        parts = [F.sequence(F.lit(0), F.lit(h))]
        if t >= h + 3:
            parts.append(F.sequence(F.lit(h + 3), F.lit(t), F.lit(3)))
        if s >= t + 6:
            parts.append(F.sequence(F.lit(t + 6), F.lit(s), F.lit(6)))
        return F.concat(*parts)

    def table(self, spark: SparkSession) -> DataFrame:
        """``(step_index, forecast_hour)``, one row per step."""
        if self.six_hourly_to > MAX_AXIS:
            raise ValueError("step axis too long to be broadcast")
        return spark.range(1).select(
            F.posexplode(self.column()).alias("step_index", "forecast_hour"))


def with_step_index(df: DataFrame, axis: StepAxis = StepAxis(), hour: str = "forecast_hour") -> DataFrame:
    """Add ``step_index``; NULL where the hour is not on the axis."""
    steps = axis.table(df.sparkSession).withColumnRenamed("forecast_hour", hour)
    # At most MAX_AXIS rows of two integers.
    return df.join(F.broadcast(steps), hour, "left")


def index_axis(df: DataFrame, column: str, index: str = "step_index") -> DataFrame:
    """Dense 0-based index of the distinct values of an axis column, however many there are.

    The values are reduced to the distinct ones first, map-side, and then numbered range
    by range.
    """
    from gridspark.operators.ranking import global_row_number

    axis = df.select(column).where(F.col(column).isNotNull()).distinct()
    return global_row_number(axis, [column], index).select(F.col(index).cast("int").alias(index), column)


def linspace(start: float, stop: float, n: int) -> Column:
    """``n`` FLOAT coordinates, both ends included."""
    if n == 1:
        return F.array(F.lit(start).cast("float"))
    step = (float(stop) - float(start)) / (n - 1)
    return F.transform(
        F.sequence(F.lit(0), F.lit(n - 1)),
        lambda i: (F.lit(float(start)) + i * F.lit(step)).cast("float"))


def coordinates(spark: SparkSession, n_lat: int = 361, n_lon: int = 720,
                lat_range=(90.0, -90.0), lon_range=(0.0, 359.5)) -> DataFrame:
    """One row with the two coordinate arrays of a regular grid."""
    return spark.range(1).select(
        linspace(*lat_range, n_lat).alias("latitude"),
        linspace(*lon_range, n_lon).alias("longitude"))


def describe_grid(df: DataFrame, lat: str = "latitude", lon: str = "longitude", keep=()) -> DataFrame:
    """Size, corners, increments and scan direction from two coordinate arrays."""

    def first(c):
        return F.element_at(c, 1).cast("double")

    def increment(c):
        return F.when(F.size(c) > 1, F.abs(F.element_at(c, 2).cast("double") - first(c))).otherwise(0.0)

    return df.select(
        *keep, F.size(lat).alias("n_lat"), F.size(lon).alias("n_lon"),
        first(lat).alias("lat_first"), F.element_at(lat, -1).cast("double").alias("lat_last"),
        first(lon).alias("lon_first"), F.element_at(lon, -1).cast("double").alias("lon_last"),
        increment(lat).alias("lat_increment"), increment(lon).alias("lon_increment"),
        (first(lat) > F.element_at(lat, -1)).alias("lat_descending"))


def cells(fields: DataFrame, value: str = "value") -> DataFrame:
    """One row per cell: the explode every cell-level operator ends with.

    Selections work on the arrays and belong before this call.
    """
    keep = [c for c in fields.columns if c != "values"]
    lon_start = F.col("lon_start") if "lon_start" in keep else F.lit(None)
    return (fields.select(*keep, F.posexplode("values").alias("pos", value))
            .withColumn("lat_idx", (F.coalesce(F.col("lat_start"), F.lit(0))
                                    + F.call_function("div", "pos", "n_lon")).cast("int"))
            .withColumn("lon_idx", (F.coalesce(lon_start, F.lit(0))
                                    + F.col("pos") % F.col("n_lon")).cast("int")))


def cell_position(lat_idx, lon_idx, n_lon) -> Column:
    """Row-major position of a cell in ``values``."""
    return _col(lat_idx) * _col(n_lon) + _col(lon_idx)


# Halvings that find a place in an axis of any length an array can have.
HALVINGS = 32


def nearest_index(axis: Column, value: Column, circle: float | None = None) -> Column:
    """0-based index of the value of a sorted axis that is nearest to ``value``: binary search, ascending or descending, any spacing.

    Of two values equally near, the one with the lower index. With ``circle`` (360 for degrees of longitude) the axis is
    part of a circle: ``value`` may be given in any turn, and the ends of the axis are neighbours. NULL for a NULL or NaN value and for an empty axis.
    """
    axis, value = axis.cast("array<double>"), value.cast("double")
    n = F.size(axis)
    low, high = F.element_at(axis, 1), F.element_at(axis, -1)
    sign = F.when(high >= low, 1.0).otherwise(-1.0)
    if circle is not None:
        start = F.least(low, high)
        value = start + F.pmod(value - start, F.lit(float(circle)))
    at = lambda i: F.get(axis, i)
    # Invariant: everything before ``a`` lies before the value, nothing from ``b`` on does.
    whole = F.struct(F.lit(0).alias("a"), n.alias("b"))

    def halve(state: Column, _: Column) -> Column:
        middle = F.shiftright(state["a"] + state["b"], 1)
        before = (state["a"] < state["b"]) & (sign * at(middle) < sign * value)
        return F.struct(F.when(before, middle + 1).otherwise(state["a"]).alias("a"),
                        F.when(before | (state["a"] >= state["b"]), state["b"]).otherwise(middle).alias("b"))

    place = F.aggregate(F.sequence(F.lit(1), F.lit(HALVINGS)), whole, halve, lambda state: state["a"])
    candidates = [place - 1, place]
    apart = lambda i: F.abs(at(i) - value)
    if circle is not None:
        candidates += [F.lit(0), n - 1]
        turn = F.lit(float(circle))
        apart = lambda i: F.least(F.abs(at(i) - value), turn - F.abs(at(i) - value))
    ranked = F.array(*[F.struct(apart(c).alias("d"), c.alias("i")) for c in candidates])
    best = F.array_min(F.filter(ranked, lambda r: (r["i"] >= 0) & (r["i"] < n)))
    return F.when(value.isNotNull() & ~F.isnan(value) & (n > 0), best["i"]).cast("int")
