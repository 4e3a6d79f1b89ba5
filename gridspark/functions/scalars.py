"""Time, missing-value and unit expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

ISO_MS = "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


# -- time -----------------------------------------------------------------

def to_utc(c) -> Column:
    """ISO text, zoned or naive time stamp -> TIMESTAMP; naive values are UTC."""
    return _col(c).cast("timestamp")


def floor_cycle(ts, hours: int = 6) -> Column:
    """Start of the forecast cycle that contains ``ts``."""
    width = hours * 3600
    return F.timestamp_seconds(F.floor(F.unix_seconds(to_utc(ts)) / width) * width)


def valid_time(reference, hour) -> Column:
    return _col(reference) + F.make_dt_interval(hours=_col(hour).cast("int"))


def grib_time(date, time) -> Column:
    """``YYYYMMDD`` and ``HHMM`` integers -> TIMESTAMP."""
    d, t = _col(date).cast("int"), _col(time).cast("int")

    def part(x, div, mod=None):
        whole = F.floor(x / div).cast("int")
        return whole if mod is None else whole % mod

    return F.make_timestamp(
        part(d, 10000), part(d, 100, 100), d % 100, part(t, 100), t % 100, F.lit(0))


def epoch_hours(ts) -> Column:
    """Stored time encoding: hours since 1970-01-01."""
    return F.unix_seconds(to_utc(ts)) / F.lit(3600)


def from_epoch_hours(hours) -> Column:
    return F.timestamp_seconds(F.round(_col(hours) * 3600).cast("long"))


def iso_ms(ts) -> Column:
    return F.date_format(to_utc(ts), ISO_MS)


def parse_iso(text) -> Column:
    return F.to_timestamp(_col(text))


def latency_ms(start, end) -> Column:
    """Milliseconds from ``start`` to ``end``."""
    return (F.unix_millis(_col(end)) - F.unix_millis(_col(start))).cast("double")


# -- members and missing values -------------------------------------------

def member_index(perturbation) -> Column:
    """1-based perturbation number -> 0-based member, NULL for the control."""
    p = _col(perturbation)
    return F.when(p > 0, p - 1)


def is_missing(v) -> Column:
    """True for NaN and for NULL (``isnan(NULL)`` is false in Spark)."""
    v = _col(v)
    return v.isNull() | F.isnan(v)


def valid(v) -> Column:
    """``v`` as DOUBLE, NULL where missing, so built-in aggregates skip it."""
    v = _col(v).cast("double")
    return F.when(~is_missing(v), v)


def as_float32(values) -> Column:
    return _col(values).cast("array<float>")


# -- units ------------------------------------------------------------------

def mib(n_bytes) -> Column:
    return _col(n_bytes) / F.lit(1024.0 * 1024.0)


def clamp_size(size, axis) -> Column:
    return F.least(_col(size), _col(axis))


def clamp_index(index, axis_size) -> Column:
    return F.least(_col(index), _col(axis_size) - 1)


def ratio(numerator, denominator) -> Column:
    """``numerator / denominator``, 0 unless the denominator is positive."""
    return F.when(_col(denominator) > 0, _col(numerator) / _col(denominator)).otherwise(F.lit(0.0))


def throughput(amount, total_ms) -> Column:
    """Ratio of sums: amount per second over all rows of the group, 0 without time."""
    seconds = F.sum(_col(total_ms)) / F.lit(1000.0)
    return F.coalesce(ratio(F.sum(_col(amount)), seconds), F.lit(0.0))


def scale_unit(u, low, high) -> Column:
    """U(0,1) -> U(low, high)."""
    return _col(low) + _col(u) * (_col(high) - _col(low))
