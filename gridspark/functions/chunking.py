"""Chunk arithmetic of slices."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from gridspark.functions.scalars import _col


def _div(a: Column, b: Column) -> Column:
    return F.floor(a / b).cast("long")


def touched(start, stop, chunk) -> Column:
    """Chunks of one axis that ``[start, stop)`` meets; 1 for empty slices or no chunking."""
    start, stop, chunk = _col(start), _col(stop), _col(chunk)
    inside = _div(stop - 1, chunk) - _div(start, chunk) + 1
    return F.when((chunk <= 0) | (stop <= start), F.lit(1).cast("long")).otherwise(inside)


def touched_all(slices) -> Column:
    """Product over axes; ``slices`` is a list of ``(start, stop, chunk)``."""
    return reduce(lambda a, b: a * b, [touched(*s) for s in slices])


def is_single_chunk(slices) -> Column:
    return touched_all(slices) == 1


def choose_slice(axis, size, chunk, seed, aligned: bool = True) -> Column:
    """Struct ``(start, stop)`` of a window on an axis, picked by the hash of ``seed``.

    The start is a multiple of the chunk size when ``aligned``. A window as long as
    the axis or longer is the whole axis.
    """
    axis, size, chunk = _col(axis), _col(size), _col(chunk)
    room = axis - size
    pick = F.xxhash64(_col(seed))
    anywhere = F.pmod(pick, room + 1)
    start = anywhere
    if aligned:
        on_chunk = F.pmod(pick, _div(room, chunk) + 1) * chunk
        start = F.when(chunk.isNotNull() & (chunk > 0), on_chunk).otherwise(anywhere)
    start = F.when(size >= axis, F.lit(0)).otherwise(start).cast("long")
    return F.struct(start.alias("start"), F.least(start + size, axis).cast("long").alias("stop"))


def shape(fields: DataFrame) -> DataFrame:
    """Chunk shape of each variable: one step, all its members, the stored band."""
    return fields.groupBy("variable").agg(
        F.lit(1).alias("step_chunk"),
        (F.max("number") + 1).alias("number_chunk"),
        F.max("n_lat").alias("lat_chunk"),
        F.max("n_lon").alias("lon_chunk"))
