"""File, store and variable names as column expressions."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, functions as F

from gridspark.functions.scalars import _col

# Message short name -> CF variable name.
CF_NAMES = {
    "2t": "t2m",
    "10u": "u10",
    "10v": "v10",
    "sp": "sp",
    "msl": "msl",
    "tp": "tp",
    "tcc": "tcc",
    "skt": "skt",
    "stl1": "stl1",
}

STAMP_PATTERN = r"^(\d{4})-?(\d{2})-?(\d{2})T(\d{2}):?(\d{2}):?(\d{2})\.?(\d{3})Z$"
EMIT_PATTERN = r"^(.+)_step(\d{3,})_emit-(.+)_id-([^/]+?)\.grib2(?:\.json)?$"
STORAGE_PATTERN = r"^[A-Za-z][A-Za-z0-9+.-]*://([^@/]+)@([^./]+)(?:\.[^/]*)?/*(.*)$"


def cf_name(cf, short) -> Column:
    """CF name if the message knows it, else the mapped short name, else the short name."""
    table = F.create_map(*[F.lit(x) for x in chain(*CF_NAMES.items())])
    known = F.when((_col(cf) != "unknown") & (_col(cf) != ""), _col(cf))
    return F.coalesce(known, F.try_element_at(table, _col(short)), _col(short))


def emit_name(variable, hour, release_iso, file_id) -> Column:
    """``t2m_step003_emit-20251223T140033.123Z_id-<id>.grib2``."""
    stamp = F.regexp_replace(_col(release_iso), "[:-]", "")
    return F.format_string(
        "%s_step%03d_emit-%s_id-%s.grib2",
        _col(variable), _col(hour).cast("int"), stamp, _col(file_id).cast("string"))


def _once(value: Column, use) -> Column:
    """``use(value)`` with ``value`` computed once, however often ``use`` mentions it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _groups(text: Column, pattern: str, n: int) -> Column:
    """All groups of a match as an array, found in one pass; no array if there is no match."""
    joined = "\u0001".join(f"${i}" for i in range(1, n + 1))
    found = F.split(F.regexp_replace(text, pattern, joined), "\u0001")
    return _once(found, lambda g: F.when(F.size(g) == n, g))


def parse_emit_name(name) -> Column:
    """Struct of a correlation file name, NULL if it is none.

    The time stamp may or may not keep the dot before its milliseconds.
    """
    return _once(_groups(basename(name), EMIT_PATTERN, 4), lambda g: F.when(g.isNotNull(), F.struct(
        g[0].alias("variable"),
        g[1].cast("int").alias("forecast_hour"),
        F.regexp_replace(g[2], STAMP_PATTERN, "$1-$2-$3T$4:$5:$6.$7Z").alias("producer_release_utc"),
        g[3].alias("file_id"))))


def cycle_name(cycle_time, prefix: str = "forecast_") -> Column:
    return F.concat(F.lit(prefix), F.date_format(_col(cycle_time), "yyyyMMdd_HH"))


def data_name(variable, hour) -> Column:
    return F.format_string("%s_step%03d", _col(variable), _col(hour).cast("int"))


def basename(path) -> Column:
    return F.substring_index(_col(path), "/", -1)


def stem(path) -> Column:
    """File name without its last suffix."""
    return F.regexp_replace(basename(path), r"(?<=.)\.[^.]*$", "")


def swap_suffix(path, suffix: str) -> Column:
    """Path with the last suffix of its file name replaced."""
    return F.concat(F.regexp_replace(_col(path), r"(?<=[^/])\.[^./]*$", ""), F.lit(suffix))


def local_path(path) -> Column:
    """Path without its scheme prefix: ``file:/x`` and ``file:///x`` -> ``/x``."""
    return F.regexp_replace(_col(path), r"^[A-Za-z][A-Za-z0-9+.-]*:/+", "/")


def redact(url) -> Column:
    """URL with its query string hidden."""
    return F.regexp_replace(_col(url), r"[?].*$", "?[REDACTED]")


def parse_volume(path) -> Column:
    """``/Volumes/catalog/schema/volume[/sub]`` -> struct, NULL if malformed."""
    parts = F.split(F.regexp_replace(_col(path), "^/+|/+$", ""), "/")
    return _once(parts, lambda p: F.when((F.size(p) >= 4) & (F.lower(p[0]) == "volumes"), F.struct(
        F.array_join(F.slice(p, 2, 3), ".").alias("volume_name"),
        F.when(F.size(p) > 4, F.array_join(F.slice(p, 5, F.size(p)), "/")).alias("subpath"))))


def parse_storage(url) -> Column:
    """``scheme://container@account.host/path`` -> struct, NULL if malformed."""
    return _once(_groups(_col(url), STORAGE_PATTERN, 3), lambda g: F.when(g.isNotNull(), F.struct(
        g[1].alias("account"), g[0].alias("container"), g[2].alias("path"))))


def volume_to_storage_path(path, base_path) -> Column:
    """Path below a volume -> path below the storage folder that backs the volume."""
    return _once(parse_volume(path), lambda v: F.when(v.isNotNull(), F.concat(
        _col(base_path), F.coalesce(F.concat(F.lit("/"), v["subpath"]), F.lit("")))))


__all__ = [
    "CF_NAMES", "basename", "cf_name", "cycle_name", "data_name", "emit_name",
    "local_path", "parse_emit_name", "parse_storage", "parse_volume", "redact", "stem",
    "swap_suffix", "volume_to_storage_path",
]
