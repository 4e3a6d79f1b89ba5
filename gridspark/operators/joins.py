"""Join helpers that hold up under hot keys and unknown sizes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

# Rows of keys and a few numbers, and the bytes of their strings: some 40 MB at most.
BROADCAST_ROWS, BROADCAST_BYTES = 200_000, 32 << 20


def join_on(left: DataFrame, right: DataFrame, keys: list[str], how: str = "left") -> DataFrame:
    """Equi-join where a NULL key matches a NULL key; key columns appear once."""
    renamed = right.select(*[F.col(k).alias(f"_r_{k}") if k in keys else F.col(k)
                             for k in right.columns])
    condition = reduce(lambda a, b: a & b,
                       [F.col(k).eqNullSafe(F.col(f"_r_{k}")) for k in keys])
    return left.join(renamed, condition, how).drop(*[f"_r_{k}" for k in keys])


def fits(small: DataFrame, limit: int = BROADCAST_ROWS) -> bool:
    """Is ``small``, a written table of narrow rows, small enough to be broadcast? Its strings are measured."""
    strings = [F.coalesce(F.octet_length(c), F.lit(0)) for c, kind in small.dtypes if kind in ("string", "binary")]
    size = reduce(lambda a, b: a + b, strings, F.lit(0))
    rows, used = small.agg(F.count("*"), F.coalesce(F.sum(size), F.lit(0))).first()
    return rows <= limit and used <= BROADCAST_BYTES


def attach(rows: DataFrame, small: DataFrame, keys: list[str], broadcast: bool) -> DataFrame:
    """Add the columns of ``small`` (one row per key) to every row; other rows go.

    With ``broadcast``, to be decided by ``fits``, ``rows`` does not move. Otherwise both
    sides are shuffled by the key, and a partition that a hot key makes too large is split
    into as many parts as its size asks for (``skewJoin`` in ``runtime.SETTINGS``).
    """
    return join_on(rows, F.broadcast(small) if broadcast else small, keys, "inner")


def resolve(manifests: DataFrame, listing: DataFrame, path: str = "landing_path",
            listed: str = "path") -> DataFrame:
    """Manifests whose payload is listed."""
    return manifests.join(listing.select(F.col(listed).alias(path)), path, "left_semi")


def missing(expected: DataFrame, listing: DataFrame, path: str = "landing_path",
            listed: str = "path") -> DataFrame:
    """Expected files that are not listed."""
    return expected.join(listing.select(F.col(listed).alias(path)), path, "left_anti")


def staged_or_original(paths: DataFrame, staged: DataFrame, path: str = "path",
                       copy: str = "staged_path") -> DataFrame:
    """Path to read: the staged copy if there is one, else the path itself."""
    return (paths.join(staged.select(path, copy), path, "left")
            .withColumn("read_path", F.coalesce(copy, path)))


def pending(emitted: DataFrame, visible: DataFrame, key: str = "file_id") -> DataFrame:
    """Emitted files that nobody has seen yet."""
    return emitted.join(visible.select(key), key, "left_anti")
