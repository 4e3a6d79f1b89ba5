"""Exact quantiles per group without holding a group in one task.

The built-in exact ``percentile`` keeps every distinct value of a group in one
buffer. Here a bounded sketch only proposes cut points, exact counts between the cut
points tell which interval holds a wanted rank, and only the rows of those intervals
go on. That is repeated inside the intervals until each is small enough to be sorted in
one task. The result is exact whatever the quality of the sketch, because the intervals
cover the whole line.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from gridspark.operators.joins import attach, fits, join_on
from gridspark.runtime import materialise

# Rows of a group that are sorted in one task; a larger one is cut into so many parts.
SORTED_ROWS, PARTS = 100_000, 64
ACCURACY = 10_000


def _rank(p: float, n: Column, method: str) -> Column:
    """0-based, possibly fractional rank of quantile ``p`` among ``n`` values."""
    rank = F.lit(p) * (n - 1).cast("double")
    if method == "nearest":
        # Half to even, as Python's round().
        return F.least(F.greatest(F.bround(rank), F.lit(0.0)), (n - 1).cast("double"))
    if method != "linear":
        raise ValueError(f"unknown method {method!r}")
    return rank


def _sorted(rows: DataFrame, keys: list[str], picks: DataFrame) -> DataFrame:
    """The values at the ranks ``_at``, each group sorted in one task, ties folded first."""
    values = rows.groupBy(*keys, "_x").agg(F.count("*").alias("_c"))
    end = F.sum("_c").over(Window.partitionBy(*keys).orderBy("_x"))
    placed = values.withColumn("_end", end)
    return join_on(placed, picks, keys, "inner").where(
        (F.col("_end") - F.col("_c") <= F.col("_at")) & (F.col("_at") < F.col("_end")))


def _narrowed(rows: DataFrame, keys: list[str], picks: DataFrame, part: str) -> tuple[DataFrame, DataFrame]:
    """The rows between the cut points around each rank, with the number of their interval as the
    further key ``part``, and the ranks counted from the start of their interval."""
    cuts = [k / PARTS for k in range(PARTS + 1)]
    sketch = materialise(rows.groupBy(*keys).agg(
        F.array_sort(F.array_distinct(F.percentile_approx("_x", cuts, ACCURACY))).alias("_cuts")), "sketch")
    interval = F.size(F.filter("_cuts", lambda c: c < F.col("_x"))).alias(part)
    placed = attach(rows, sketch, keys, fits(sketch)).select(*keys, interval, "_x")
    # At most PARTS + 2 rows per group.
    counts = placed.groupBy(*keys, part).agg(F.count("*").alias("_rows"))
    start = F.sum("_rows").over(Window.partitionBy(*keys).orderBy(part)) - F.col("_rows")
    intervals = counts.withColumn("_start", start)
    hit = materialise(
        join_on(intervals, picks, keys, "inner")
        .where((F.col("_start") <= F.col("_at")) & (F.col("_at") < F.col("_start") + F.col("_rows")))
        .withColumn("_at", F.col("_at") - F.col("_start")).drop("_start", "_rows"), "targets")
    wanted = materialise(hit.select(*keys, part).distinct(), "hit")
    return materialise(attach(placed, wanted, [*keys, part], fits(wanted)), "narrowed"), hit


def exact_quantiles(df: DataFrame, keys: list[str], value: str, probs: dict[str, float],
                    method: str = "linear", sorted_rows: int = SORTED_ROWS) -> DataFrame:
    """One row per group: the keys and a DOUBLE column per entry of ``probs``.

    ``linear`` interpolates between neighbours, ``nearest`` takes the element at the
    rounded rank. NULL values are ignored; a group without values has no row. No task
    sorts more than about ``sorted_rows`` different values of a group.
    """
    if not keys:
        whole = df.withColumn("_all", F.lit(0))
        return exact_quantiles(whole, ["_all"], value, probs, method, sorted_rows).drop("_all")
    rows = (df.select(*keys, F.col(value).cast("double").alias("_x"))
            .where(F.col("_x").isNotNull()))
    groups = materialise(rows.groupBy(*keys).agg(F.count("*").alias("_n")), "groups")
    wanted = F.explode(F.array(*[
        F.struct(F.lit(name).alias("_name"), _rank(p, F.col("_n"), method).alias("_rank"))
        for name, p in probs.items()])).alias("_want")
    ranks = groups.select(*keys, wanted).select(*keys, "_want.*").withColumn(
        "_at", F.explode(F.array_distinct(F.array(F.floor("_rank"), F.ceil("_rank")))))
    picks = ranks.withColumn("_pick", F.col("_at"))
    inside, largest = list(keys), groups.agg(F.max("_n")).first()[0] or 0
    while largest > sorted_rows:
        part = f"_part{len(inside)}"
        rows, picks = _narrowed(rows, inside, picks, part)
        inside.append(part)
        # Many equal values are one entry when sorted.
        left = rows.groupBy(*inside).agg(F.approx_count_distinct("_x").alias("_n")).agg(F.max("_n")).first()[0] or 0
        if left >= largest:
            break
        largest = left
    found = _sorted(rows, inside, picks)

    def at(name: str) -> Column:
        mine = F.col("_name") == name
        below = F.max(F.when(mine & (F.col("_pick") == F.floor("_rank")), F.col("_x")))
        above = F.max(F.when(mine & (F.col("_pick") == F.ceil("_rank")), F.col("_x")))
        weight = F.max(F.when(mine, F.col("_rank") - F.floor("_rank")))
        return below + (above - below) * weight

    return found.groupBy(*keys).agg(*[at(name).alias(name) for name in probs])
