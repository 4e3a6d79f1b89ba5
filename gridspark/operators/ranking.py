"""Row numbers over a whole table without a single-task window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from gridspark.operators.joins import attach, fits
from gridspark.runtime import materialise

# ``monotonically_increasing_id`` has the partition above this bit and the row's position in it below.
POSITION_BITS = 33
# Buckets whose sizes are added up by one window.
BLOCK = 1024


def _bucketed(df: DataFrame, order: list[str], buckets: int | None) -> DataFrame:
    """Rows in ``order``, with the number of the key range they are in as ``_bucket`` and their place in it as ``_within``.

    A range exchange: its bounds come from a sample of fixed size per range, and stay with the exchange. Without
    ``buckets`` there are as many ranges as shuffle partitions, of which small ones may be read together.
    """
    ranged = df.repartitionByRange(buckets, *order) if buckets else df.repartitionByRange(*order)
    place = F.col("_place")
    return (ranged.sortWithinPartitions(*order).withColumn("_place", F.monotonically_increasing_id())
            .withColumn("_bucket", F.shiftright(place, POSITION_BITS))
            .withColumn("_within", place.bitwiseAND((1 << POSITION_BITS) - 1)).drop("_place"))


def _offsets(bucketed: DataFrame) -> DataFrame:
    """``(_bucket, _before)``: how many rows are in the buckets before. Buckets are added up in blocks, then the blocks:
    the one window over all of them sees a row for every ``BLOCK`` buckets."""
    sizes = bucketed.groupBy("_bucket").agg(F.count("*").alias("_n")).withColumn("_block", F.floor(F.col("_bucket") / BLOCK))
    blocks = sizes.groupBy("_block").agg(F.sum("_n").alias("_n"))
    earlier = Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select("_block", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_blocks_before"))
    inside = Window.partitionBy("_block").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    return (sizes.withColumn("_in_block", F.coalesce(F.sum("_n").over(inside), F.lit(0))).join(blocks, "_block")
            .select("_bucket", (F.col("_blocks_before") + F.col("_in_block")).alias("_before")))


def global_row_number(df: DataFrame, order: list[str], name: str = "row_number",
                      buckets: int | None = None) -> DataFrame:
    """0-based position of every row in the order of ``order`` (ascending).

    ``order`` must identify a row: put a unique column last. Then a value shared by a
    third of the table is split over buckets as well, because bounds are drawn from
    the whole key. The rows are sorted once, into buckets by range, and written so; a row's number is its place in its bucket and
    what the buckets before hold, which is a prefix sum in two levels. Nothing that grows with the table is in one row, one task or the driver.
    """
    ordered = materialise(_bucketed(df, order, buckets), "ordered")
    offsets = materialise(_offsets(ordered), "offsets")
    return (attach(ordered, offsets, ["_bucket"], fits(offsets))
            .withColumn(name, F.col("_before") + F.col("_within")).drop("_bucket", "_within", "_before"))


def concat_index(df: DataFrame, path: str = "path", name: str = "concat_index") -> DataFrame:
    """Dense 0-based index of the file each row came from, in path order.

    Only the list of distinct paths is ranked and written; the rows, which may carry
    whole grids, stay where they are if the list can be broadcast.
    """
    files = materialise(global_row_number(df.select(path).distinct(), [path], name), "files")
    return attach(df, files, [path], fits(files))


def assign_batches(df: DataFrame, order: list[str], files_per_batch: int,
                   name: str = "batch_id") -> DataFrame:
    """Micro-batch number a source with ``maxFilesPerTrigger`` would give each file."""
    numbered = global_row_number(df, order, "_position")
    return (numbered.withColumn(name, F.floor(F.col("_position") / files_per_batch).cast("long"))
            .drop("_position"))


def schedule(df: DataFrame, order: list[str], start: Column, interval_seconds: float = 1.0,
             name: str = "release_at", burst: bool = False) -> DataFrame:
    """Release time of each row: ``start + i * interval``, or ``start`` for a burst."""
    if burst:
        return df.withColumn(name, start)
    numbered = global_row_number(df, order, "_position")
    micros = (F.col("_position") * F.lit(int(round(interval_seconds * 1_000_000)))).cast("long")
    return numbered.withColumn(name, F.timestamp_micros(F.unix_micros(start) + micros)).drop("_position")


def repeat_plan(plan: DataFrame, order: list[str], total: int) -> DataFrame:
    """The plan over and over until it has ``total`` rows; ``sequence`` is the row's position."""
    numbered = global_row_number(plan, order, "_position")
    size = plan.agg(F.count("*").alias("_size"))
    positions = (plan.sparkSession.range(total).withColumnRenamed("id", "sequence")
                 .withColumn("_size", size.scalar()).where(F.col("_size") > 0)
                 .withColumn("_position", F.pmod("sequence", "_size")).drop("_size"))
    return positions.join(numbered, "_position").drop("_position")
