"""Array selections, done on the stored arrays before any explode.

Filters on ``cycle_time``, ``variable`` and ``step_index`` are partition filters of
the store; a selection by latitude also filters the stored bands.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from gridspark.functions.axes import cells, nearest_index
from gridspark.functions.scalars import clamp_index
from gridspark.operators.joins import fits


def step(fields: DataFrame, variable: str, step_index: int) -> DataFrame:
    """One step of a variable: all members, the whole grid."""
    return fields.where((F.col("variable") == variable) & (F.col("step_index") == step_index))


def steps(fields: DataFrame, variable: str, wanted: slice | Sequence[int]) -> DataFrame:
    """A step range ``slice(a, b)`` or a list of steps."""
    return fields.where((F.col("variable") == variable) & _along("step_index", wanted))


def _along(column: str, wanted: slice | Sequence[int]) -> Column:
    if not isinstance(wanted, slice):
        return F.col(column).isin([int(w) for w in wanted])
    if wanted.step not in (None, 1):
        raise ValueError("only contiguous ranges; pass a list of indexes instead")
    inside = F.lit(True)
    if wanted.start is not None:
        inside = inside & (F.col(column) >= wanted.start)
    if wanted.stop is not None:
        inside = inside & (F.col(column) < wanted.stop)
    return inside


def box(fields: DataFrame, lat: slice, lon: slice) -> DataFrame:
    """The part of every grid inside ``[lat0, lat1) x [lon0, lon1)``.

    Bands outside the box are filtered out; ``lat_start``, ``n_lat``, ``lon_start``
    and ``n_lon`` of the result describe the cut-out. Ends beyond the grid are clipped.
    """
    lat0, lat1 = lat.start or 0, lat.stop
    lon0, lon1 = lon.start or 0, lon.stop
    band_end = F.col("lat_start") + F.col("n_lat")
    stop = band_end if lat1 is None else F.least(F.lit(lat1), band_end)
    right = F.col("n_lon") if lon1 is None else F.least(F.lit(lon1), F.col("n_lon"))
    inside = (band_end > lat0) & (F.col("n_lon") > lon0)
    if lat1 is not None:
        inside = inside & (F.col("lat_start") < lat1) & F.lit(lat1 > lat0)
    if lon1 is not None:
        inside = inside & F.lit(lon1 > lon0)
    cut = (fields.where(inside)
           .withColumn("_first", F.greatest(F.lit(lat0), F.col("lat_start")) - F.col("lat_start"))
           .withColumn("_rows", stop - F.col("lat_start") - F.col("_first"))
           .withColumn("_width", right - lon0))
    # The optimizer may look at the cut-out before the filter: it must exist only inside.
    lines = F.when((F.col("_rows") > 0) & (F.col("_width") > 0),
                   F.sequence(F.col("_first"), F.col("_first") + F.col("_rows") - 1))
    rows = F.transform(
        lines, lambda i: F.slice("values", i * F.col("n_lon") + lon0 + 1, F.col("_width")))
    return (cut.withColumn("values", F.flatten(rows))
            .withColumn("lat_start", F.col("lat_start") + F.col("_first"))
            .withColumn("n_lat", F.col("_rows"))
            .withColumn("lon_start", F.lit(lon0))
            .withColumn("n_lon", F.col("_width"))
            .drop("_first", "_rows", "_width"))


def hyperslab(fields: DataFrame, variable: str, step: slice | Sequence[int] = slice(None),
              number: slice | Sequence[int] = slice(None), lat: slice = slice(0, None),
              lon: slice = slice(0, None)) -> DataFrame:
    """4-D hyper-rectangle over step, member, latitude and longitude."""
    picked = steps(fields, variable, step).where(_along("number", number))
    return box(picked, lat, lon)


def point(fields: DataFrame, lat: int = 180, lon: int = 360, number: int | None = 0,
          clamp: bool = False, members: int | None = None) -> DataFrame:
    """Value of one cell per row; index -1 is the last of an axis.

    A negative ``number`` counts from the end of the member axis, whose length is ``members`` (that of the store's spec): a
    member that has not arrived gives no rows. Without it the axis is taken to end with the last member that is there.
    ``clamp`` moves an index beyond the grid to its last one. Bands without the cell
    are filtered out, and an index outside the grid gives no rows. A column ``grid_lat``
    with the number of latitudes saves a look at the bands for -1 and ``clamp``.
    """
    rows = fields
    if number is not None:
        if number < 0 and members is not None:
            rows = rows.where(F.col("number") == members + number)
        elif number < 0:
            # An ensemble has a handful of members: one bounded row decides.
            last = fields.agg(F.max("number").alias("last"))
            rows = rows.withColumn("_last", last.scalar()).where(
                F.col("number") == F.col("_last") + number + 1).drop("_last")
        else:
            rows = rows.where(F.col("number") == number)
    if "grid_lat" in fields.columns:
        grid_lat = F.col("grid_lat")
    elif lat < 0 or clamp:
        grid_lat = fields.agg(F.max(F.col("lat_start") + F.col("n_lat")).alias("grid_lat")).scalar()
    else:
        grid_lat = F.lit(None).cast("int")

    def index(i: int, size: Column) -> Column:
        if i < 0:
            return size + i
        return clamp_index(F.lit(i), size) if clamp else F.lit(i)

    lat_idx, lon_idx = index(lat, grid_lat), index(lon, F.col("n_lon"))
    inside = ((F.col("lat_start") <= lat_idx) & (lat_idx < F.col("lat_start") + F.col("n_lat"))
              & (lon_idx >= 0) & (lon_idx < F.col("n_lon")))
    position = (lat_idx - F.col("lat_start")) * F.col("n_lon") + lon_idx
    return (rows.where(inside)
            .withColumn("lat_idx", lat_idx).withColumn("lon_idx", lon_idx)
            .withColumn("value", F.get("values", position))
            .drop("values"))


def locate(points: DataFrame, axes: DataFrame) -> DataFrame:
    """``points(latitude, longitude, ...)`` with the nearest cell as ``lat_idx`` and ``lon_idx``.

    ``axes`` is one row of coordinates (``store.open_axes``). Longitudes go round; latitudes beyond the grid have its first or last row.
    """
    held = points.withColumn("_lat", axes.select("latitude").scalar()).withColumn("_lon", axes.select("longitude").scalar())
    return (held.withColumn("lat_idx", nearest_index(F.col("_lat"), F.col("latitude")))
            .withColumn("lon_idx", nearest_index(F.col("_lon"), F.col("longitude"), 360.0)).drop("_lat", "_lon"))


def at_points(fields: DataFrame, points: DataFrame, axes: DataFrame) -> DataFrame:
    """The value nearest to every point, for every row of ``fields`` whose band has its cell; all columns of ``points`` come along.

    ``points`` should be a written table. Cells are matched by their indexes, so the work is that of the bands that hold a point.
    """
    wanted = locate(points, axes)
    rows = wanted.select("lat_idx").distinct()
    near = fits(points)
    held = fields.join(F.broadcast(rows) if near else rows,
                       (F.col("lat_idx") >= F.col("lat_start")) & (F.col("lat_idx") < F.col("lat_start") + F.col("n_lat")), "left_semi") if near else fields
    return cells(held).join(F.broadcast(wanted) if near else wanted, ["lat_idx", "lon_idx"])


def nearest(fields: DataFrame, axes: DataFrame, lat: float, lon: float, number: int | None = 0, members: int | None = None) -> DataFrame:
    """``point`` by degrees: the cell whose coordinates are nearest."""
    where = axes.select(nearest_index(F.col("latitude"), F.lit(lat)).alias("lat_idx"), nearest_index(F.col("longitude"), F.lit(lon), 360.0).alias("lon_idx")).first()
    return point(fields, where.lat_idx, where.lon_idx, number, members=members)
