"""NaN-aware statistics of fields."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

from gridspark.functions.axes import cells
from gridspark.functions.scalars import is_missing, valid

SLOT = ["cycle_time", "variable", "step_index"]
CELL = ["lat_idx", "lon_idx"]


def ensemble_mean(fields: DataFrame, by: list[str] = SLOT) -> DataFrame:
    """Mean over members per cell; NULL where every member is missing.

    Partial sums are made before the shuffle, and the shuffle is by cell, so one
    over-full slot is spread over all tasks.
    """
    return (cells(fields.select(*by, "lat_start", "n_lat", "n_lon", "values"))
            .groupBy(*by, *CELL)
            .agg(F.avg(valid("value")).alias("mean"),
                 F.count(valid("value")).alias("n_members")))


def _partial_sums(by: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows == 0:
                continue
            table = pa.Table.from_batches([batch]).append_column("_row", pa.array(range(batch.num_rows)))
            groups = (table.group_by([*by, "lat_start", "n_lat", "n_lon"])
                      .aggregate([("_row", "list")]))
            values = batch.column(batch.schema.get_field_index("values"))
            sums, counts = [], []
            for rows in groups.column("_row_list").to_pylist():
                block = np.stack([np.asarray(values[i].values, dtype=np.float64) for i in rows])
                present = ~np.isnan(block)
                sums.append(np.where(present, block, 0.0).sum(axis=0))
                counts.append(present.sum(axis=0))
            keys = groups.drop_columns(["_row_list"]).combine_chunks()
            yield from keys.append_column("sums", pa.array(sums, pa.list_(pa.float64()))) \
                .append_column("counts", pa.array(counts, pa.list_(pa.int64()))).to_batches()
    return run


def ensemble_mean_blocks(fields: DataFrame, by: list[str] = SLOT) -> DataFrame:
    """Same result as ``ensemble_mean``, for wide grids.

    The store keeps the members of a slot in one file, so a task adds up whole
    arrays first and explodes one partial array per slot instead of one per member.
    """
    keep = fields.select(*by, "lat_start", "n_lat", "n_lon", "values")
    schema = T.StructType([f for f in keep.schema.fields if f.name != "values"]
                          + [T.StructField("sums", T.ArrayType(T.DoubleType())),
                             T.StructField("counts", T.ArrayType(T.LongType()))])
    partial = keep.mapInArrow(_partial_sums(by), schema)
    zipped = partial.withColumn("values", F.arrays_zip("sums", "counts")).drop("sums", "counts")
    return (cells(zipped).select(*by, *CELL, "value.*")
            .groupBy(*by, *CELL)
            .agg(F.sum("sums").alias("_s"), F.sum("counts").alias("n_members"))
            .select(*by, *CELL,
                    F.when(F.col("n_members") > 0, F.col("_s") / F.col("n_members")).alias("mean"),
                    "n_members"))


# Tasks that a group's partial sums are merged in before the last merge.
FAN_IN = 16


def _merged(schema: pa.Schema, keys: list[str]):
    """Rows sorted by ``keys`` with arrays ``sums`` and ``counts``, those of equal keys added up."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, sums, counts = None, None, None

        def out() -> pa.RecordBatch:
            columns = [*[pa.array([held[k]], schema.field(k).type) for k in keys],
                       pa.array([sums], schema.field("sums").type), pa.array([counts], schema.field("counts").type)]
            return pa.RecordBatch.from_arrays(columns, [*keys, "sums", "counts"])

        for batch in batches:
            owner = batch.select(keys).to_pylist()
            for i, key in enumerate(owner):
                own_sums, own_counts = (batch.column(c)[i].values.to_numpy() for c in ("sums", "counts"))
                if key == held:
                    sums += own_sums
                    counts += own_counts
                    continue
                if held is not None:
                    yield out()
                held, sums, counts = key, own_sums.copy(), own_counts.copy()
        if held is not None:
            yield out()

    return run


def ensemble_mean_arrays(fields: DataFrame, by: list[str] = SLOT) -> DataFrame:
    """``ensemble_mean`` without a row per cell: per slot and band the arrays ``mean`` (NULL where every member is missing) and ``n_members``.

    Every task adds up whole arrays; the partial arrays of a band are merged in two levels, ``FAN_IN`` tasks first,
    so that neither the shuffle nor a task holds more than one array per band and task of the level before. Use
    ``mean_cells`` for a row per cell.
    """
    keys = [*by, "lat_start", "n_lat", "n_lon"]
    keep = fields.select(*keys, "values")
    schema = T.StructType([*[f for f in keep.schema.fields if f.name != "values"],
                           T.StructField("sums", T.ArrayType(T.DoubleType())), T.StructField("counts", T.ArrayType(T.LongType()))])
    partial = keep.mapInArrow(_running_sums(to_arrow_schema(schema), keys), schema).withColumn("_part", F.spark_partition_id() % FAN_IN)
    merge = _merged(to_arrow_schema(schema), keys)
    some = partial.repartition(*keys, "_part").sortWithinPartitions(*keys).drop("_part").mapInArrow(merge, schema)
    whole = some.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(merge, schema)
    mean = F.zip_with("sums", "counts", lambda s, n: F.when(n > 0, s / n))
    return whole.select(*keys, mean.alias("mean"), F.col("counts").alias("n_members"))


def _running_sums(schema: pa.Schema, keys: list[str]):
    """Sums and counts of the valid cells, an array per key, added up while a task's rows of a key follow each other."""
    merge = _merged(schema, keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def prepared() -> Iterator[pa.RecordBatch]:
            for batch in batches:
                # The rows of a key together: a store has the members of a band one after the other.
                order = batch.select(keys).append_column("_row", pa.array(range(batch.num_rows))).sort_by([(k, "ascending") for k in keys])
                for i in order.column("_row").to_pylist():
                    values = np.asarray(batch.column("values")[i].values, dtype=np.float64)
                    valid_cells = ~np.isnan(values)
                    yield pa.RecordBatch.from_arrays(
                        [*[batch.column(k).slice(i, 1) for k in keys], pa.array([np.where(valid_cells, values, 0.0)], pa.list_(pa.float64())),
                         pa.array([valid_cells.astype(np.int64)], pa.list_(pa.int64()))], [*keys, "sums", "counts"])

        yield from merge(prepared())

    return run


def mean_cells(means: DataFrame) -> DataFrame:
    """The arrays of ``ensemble_mean_arrays`` as the rows of ``ensemble_mean``."""
    zipped = means.withColumn("values", F.arrays_zip("mean", "n_members")).drop("mean", "n_members")
    rest = [c for c in means.columns if c not in ("lat_start", "n_lat", "n_lon", "mean", "n_members")]
    return cells(zipped).select(*rest, *CELL, "value.mean", "value.n_members")


def _values(fields: DataFrame, by: list[str]) -> DataFrame:
    """Only the grouping columns and the cell values: the explode stays narrow."""
    return fields.select(*by, F.explode("values").alias("value"))


def global_mean(fields: DataFrame, by: list[str] = ()) -> DataFrame:
    return _values(fields, list(by)).groupBy(*by).agg(F.avg(valid("value")).alias("mean"))


def describe(fields: DataFrame, by: list[str] = ("variable",)) -> DataFrame:
    """min, max, mean and population standard deviation of the valid cells."""
    v = valid("value")
    return _values(fields, list(by)).groupBy(*by).agg(
        F.min(v).alias("min"), F.max(v).alias("max"),
        F.avg(v).alias("mean"), F.stddev_pop(v).alias("std"))


def _nan_share(value: str) -> Column:
    return F.avg(is_missing(value).cast("double")) * 100


def nan_pct(fields: DataFrame, by: list[str] = ("variable",)) -> DataFrame:
    return _values(fields, list(by)).groupBy(*by).agg(_nan_share("value").alias("nan_pct"))


def valid_stats(fields: DataFrame, by: list[str] = ("variable",)) -> DataFrame:
    """Missing share, and min, max, mean of the valid cells (NULL if there is none)."""
    return valid_cell_stats(_values(fields, list(by)), by)


def valid_cell_stats(cells: DataFrame, by: list[str] = ("variable",)) -> DataFrame:
    """``valid_stats`` of rows that are cells with a ``value`` already."""
    v = valid("value")
    return cells.groupBy(*by).agg(
        _nan_share("value").alias("nan_pct"),
        F.min(v).alias("data_min"), F.max(v).alias("data_max"), F.avg(v).alias("data_mean"))


def _axis_size(column: str) -> Column:
    # A set of axis indexes is bounded by the axis and is merged map-side.
    return F.size(F.collect_set(column)).cast("long")


def store_info(fields: DataFrame) -> DataFrame:
    """Per variable: axis sizes, chunk shape, and the missing share of step 0, member 0."""
    dims = fields.groupBy("variable").agg(
        _axis_size("step_index").alias("n_steps"), _axis_size("number").alias("n_members"),
        F.max(F.col("lat_start") + F.col("n_lat")).cast("long").alias("n_lat"),
        F.max("n_lon").cast("long").alias("n_lon"))
    first = fields.where((F.col("step_index") == 0) & (F.col("number") == 0))
    sample = nan_pct(first).withColumnRenamed("nan_pct", "sample_nan_pct")
    return dims.join(sample, "variable", "left").withColumn(
        "chunks", F.format_string("1x%dx%dx%d", "n_members", "n_lat", "n_lon"))


def size_estimate(fields: DataFrame, bytes_per_cell: int = 4) -> DataFrame:
    """Bytes of one chunk, number of chunks and total, for the dense form of each variable."""
    dims = fields.groupBy("variable").agg(
        _axis_size("step_index").alias("n_chunks"), _axis_size("number").alias("n_members"),
        F.max((F.col("lat_start") + F.col("n_lat")) * F.col("n_lon")).cast("long").alias("n_cells"))
    chunk = F.col("n_members") * F.col("n_cells") * bytes_per_cell
    return dims.select(
        "variable", chunk.alias("chunk_bytes"), (chunk / 1024 ** 2).alias("chunk_mib"), "n_chunks",
        (chunk * F.col("n_chunks")).alias("total_bytes"),
        (chunk * F.col("n_chunks") / 1024 ** 3).alias("total_gib"))


def verify(fields: DataFrame, by: list[str] = SLOT, lat_range=(90.0, -90.0),
           lon_range=(0.0, 359.5), axes: DataFrame | None = None) -> DataFrame:
    """Per data file: members, their range, grid size and coordinate range.

    The coordinates are those of ``axes`` (one row, ``store.open_axes``): the first and the last that the file's cells have, NULL where the
    grid goes beyond them. Without ``axes`` a regular grid over the given ranges is taken for granted.
    """

    def last(start, stop, n):
        return F.when(n > 1, F.lit(float(stop))).otherwise(F.lit(float(start)))

    sizes = fields.groupBy(*by).agg(
        _axis_size("number").alias("n_members"),
        F.min("number").cast("long").alias("first_member"),
        F.max("number").cast("long").alias("last_member"),
        F.max(F.col("lat_start") + F.col("n_lat")).cast("long").alias("n_lat"),
        F.max("n_lon").cast("long").alias("n_lon"))
    if axes is None:
        return sizes.select("*", F.lit(float(lat_range[0])).alias("lat_first"), last(*lat_range, F.col("n_lat")).alias("lat_last"),
                            F.lit(float(lon_range[0])).alias("lon_first"), last(*lon_range, F.col("n_lon")).alias("lon_last"))
    held = sizes.withColumn("_lat", axes.select("latitude").scalar()).withColumn("_lon", axes.select("longitude").scalar())
    ends = [F.get(axis, at).cast("double").alias(name) for axis, size, names in (("_lat", "n_lat", ("lat_first", "lat_last")), ("_lon", "n_lon", ("lon_first", "lon_last")))
            for name, at in zip(names, (F.lit(0), (F.col(size) - 1).cast("int")), strict=True)]
    return held.select("*", *ends).drop("_lat", "_lon")


def stack(fields: DataFrame, capacity: int, by: list[str] = SLOT) -> DataFrame:
    """Members of a slot as one array ordered by member.

    ``capacity`` is the length of the member axis and bounds the array. A member
    beyond it is an error of its file and must have been rejected before. The bands of a
    member are put together from north to south.
    """
    inside = F.when(F.col("number") < capacity, F.struct("number", "lat_start", "values")).otherwise(
        F.raise_error(F.lit("member beyond the ensemble axis")))
    bands = fields.groupBy(*by).agg(F.array_sort(F.collect_list(inside)).alias("_bands"))
    numbers = F.array_distinct(F.transform("_bands", lambda b: b["number"]))
    members = F.transform(numbers, lambda n: F.struct(n.alias("number"), F.flatten(F.transform(
        F.filter("_bands", lambda b: b["number"] == n), lambda b: b["values"])).alias("values")))
    return bands.withColumn("members", members).drop("_bands")
