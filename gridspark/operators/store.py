"""Forecast stores: partitioned tables of fields, one row per slot, member and band."""

from __future__ import annotations

import uuid
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field
from datetime import datetime
from itertools import groupby
from operator import itemgetter
from urllib.parse import unquote

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from gridspark.functions.axes import StepAxis, with_step_index
from gridspark.functions.scalars import as_float32
from gridspark.operators import moments
from gridspark.operators.joins import fits, join_on
from gridspark.operators.ranking import concat_index
from gridspark.runtime import hadoop_path, materialise, staging

PARTITION = ["cycle_time", "variable", "step_index"]
SLOT = [*PARTITION, "number", "lat_start"]
MEMBERS_PER_FILE = 64
# About eight full grids: reading one member skips the other row groups of its file.
ROW_GROUP_BYTES = 8 << 20

FIELDS = T.StructType([
    T.StructField("number", T.IntegerType()),
    T.StructField("lat_start", T.IntegerType()),
    T.StructField("n_lat", T.IntegerType()),
    T.StructField("n_lon", T.IntegerType()),
    T.StructField("values", T.ArrayType(T.FloatType())),
    T.StructField("source_path", T.StringType()),
    T.StructField("release_ts", T.TimestampType()),
    T.StructField("cycle_time", T.TimestampType()),
    T.StructField("variable", T.StringType()),
    T.StructField("step_index", T.IntegerType()),
])

# What is in the files: the moments of every grid beside it, which ``open_store`` leaves unread.
IN_FILES = T.StructType([*FIELDS.fields, T.StructField("moments", moments.MOMENTS)])


@dataclass(frozen=True)
class StoreSpec:
    """What a cycle store holds, fixed when it is initialised."""

    variables: Sequence[str] = ("t2m", "u10", "v10", "sp")
    members: int = 50
    n_lat: int = 361
    n_lon: int = 720
    axis: StepAxis = field(default_factory=StepAxis)
    reference_time: datetime | None = None


# -- opening ----------------------------------------------------------------

def exists(spark: SparkSession, path: str) -> bool:
    fs, where = hadoop_path(spark, path)
    return fs.exists(where)


def open_store(spark: SparkSession, path: str, schema: T.StructType | None = FIELDS,
               cycles: Sequence[datetime] | None = None) -> DataFrame:
    """A store with its known schema; ``schema=None`` infers it from the files.

    With ``cycles`` (naive UTC) only the folders of those cycles are listed, which
    matters once a store has thousands of them. Which of them are there is read from the
    names in the store's own folder.
    """
    reader = spark.read if schema is None else spark.read.schema(schema)
    if cycles is None:
        return reader.parquet(path)
    there = set(stored_cycles(spark, path))
    present = [f"{path}/cycle_time={c:%Y-%m-%d %H%%3A%M%%3A%S}" for c in cycles if c in there]
    if not present:
        return reader.parquet(path).where(F.lit(False))
    return reader.option("basePath", path).parquet(*present)


def open_moments(spark: SparkSession, path: str, cycles: Sequence[datetime] | None = None) -> DataFrame:
    """A store with ``moments`` in place of its grids, for the statistics of ``operators.moments``: no grid is read."""
    return open_store(spark, path, T.StructType([f for f in IN_FILES.fields if f.name != "values"]), cycles)


def add_moments(spark: SparkSession, path: str) -> None:
    """Give the grids of a store that was written without moments theirs; only partitions that lack some are written."""
    lacking = open_moments(spark, path).where("moments IS NULL").select(*PARTITION).distinct()
    with staging(spark, "moments") as folder:
        lacking = materialise(lacking, "lacking", folder)
        if not lacking.isEmpty():
            rows = join_on(open_store(spark, path), F.broadcast(lacking) if fits(lacking) else lacking, PARTITION, "left_semi")
            save(materialise(rows, "grids", folder), path)


def touched_cycles(fields: DataFrame) -> list[datetime] | None:
    """The cycles of a write, one name each; None (look at the whole store) if one is unknown."""
    rows = fields.select(F.date_format("cycle_time", "yyyy-MM-dd HH:mm:ss").alias("c")).distinct().collect()
    if any(r.c is None for r in rows):
        return None
    return sorted(datetime.fromisoformat(r.c) for r in rows)


def stored_cycles(spark: SparkSession, path: str) -> list[datetime]:
    """Cycles of a store in time order, from the names of its folders; no file is opened."""
    if not exists(spark, path):
        return []
    fs, where = hadoop_path(spark, path)
    names = [unquote(s.getPath().getName()) for s in fs.listStatus(where)]
    return sorted(datetime.fromisoformat(n.removeprefix("cycle_time=")) for n in names
                  if n.startswith("cycle_time=") and not n.endswith("__HIVE_DEFAULT_PARTITION__"))


def open_first_cycles(spark: SparkSession, path: str, n: int) -> DataFrame:
    """The first ``n`` cycles of a store, listing only their folders."""
    return open_store(spark, path, cycles=stored_cycles(spark, path)[:n])


def open_cycles(fields: DataFrame, n: int) -> DataFrame:
    """The first ``n`` cycles, by time; the cycle filter prunes partitions."""
    first = fields.select("cycle_time").distinct().orderBy("cycle_time").limit(n)
    # n rows of one time stamp.
    return fields.join(F.broadcast(first), "cycle_time", "left_semi")


def open_many(spark: SparkSession, paths: Sequence[str], index: str = "concat_index") -> DataFrame:
    """Several files as one dataset with a new axis in path order."""
    rows = spark.read.parquet(*paths).select("*", F.col("_metadata.file_path").alias("path"))
    return concat_index(rows, "path", index)


def concat(datasets: Sequence[DataFrame], index: str = "concat_index") -> DataFrame:
    """Datasets one after the other along a new axis, in the given order."""
    parts = [d.withColumn(index, F.lit(i)) for i, d in enumerate(datasets)]
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part, allowMissingColumns=True)
    return result


# Names that are coordinates and not data variables.
COORDINATES = ["step", "valid_time", "number", "latitude", "longitude", "time"]


def variables(fields: DataFrame) -> DataFrame:
    """Data variables of a store."""
    return fields.select("variable").where(~F.col("variable").isin(COORDINATES)).distinct()


def first_variable(fields: DataFrame) -> DataFrame:
    return variables(fields).agg(F.min("variable").alias("variable"))


# -- coordinates -----------------------------------------------------------------

AXES = T.StructType([T.StructField("latitude", T.ArrayType(T.FloatType())), T.StructField("longitude", T.ArrayType(T.FloatType()))])


def save_axes(axes: DataFrame, path: str) -> None:
    """Keep the coordinates of a store's cells, one row of ``AXES``, beside its partitions (in a folder that listings leave out)."""
    axes.select(*[F.col(f.name).cast(f.dataType) for f in AXES.fields]).coalesce(1).write.mode("overwrite").parquet(f"{path}/_axes/current")


def open_axes(spark: SparkSession, path: str) -> DataFrame:
    """The coordinates that ``save_axes`` kept, also as a template for another store."""
    return spark.read.schema(AXES).parquet(f"{path}/_axes/current")


# -- initialising --------------------------------------------------------------

def init_cycle(cycles: DataFrame, spec: StoreSpec = StoreSpec(), fill: float | None = None) -> DataFrame:
    """All slots of each cycle in ``cycles(cycle_time)``, one row per member.

    The axes unfold from literal arrays, so the rows are made where the cycles are.
    Absent data is absent rows; give ``fill`` to store a constant grid instead.
    """
    slots = (cycles
             .withColumn("variable", F.explode(F.array(*[F.lit(v) for v in spec.variables])))
             .select("*", F.posexplode(spec.axis.column()).alias("step_index", "forecast_hour"))
             .withColumn("number", F.explode(F.sequence(F.lit(0), F.lit(spec.members - 1))))
             .withColumn("lat_start", F.lit(0))
             .withColumn("n_lat", F.lit(spec.n_lat)).withColumn("n_lon", F.lit(spec.n_lon)))
    if fill is None:
        return slots
    return slots.withColumn(
        "values", F.array_repeat(F.lit(fill).cast("float"), spec.n_lat * spec.n_lon))


def dense_view(skeleton: DataFrame, fields: DataFrame) -> DataFrame:
    """Every slot of the skeleton; an absent one is a grid of NaN.

    The bands of a slot are put together; where one is missing, its cells are NaN.
    """
    slot = [*PARTITION, "number"]
    band = F.struct("lat_start", "n_lat", "values")
    present = fields.groupBy(*slot).agg(F.array_sort(F.collect_list(band)).alias("_bands"))
    return (skeleton.join(present, slot, "left")
            .withColumn("arrived", F.col("_bands").isNotNull())
            .withColumn("values", whole_grid(F.col("_bands"), F.col("n_lat"), F.col("n_lon")))
            .drop("_bands"))


def whole_grid(bands: Column, n_lat: Column, n_lon: Column) -> Column:
    """One grid from the sorted ``(lat_start, n_lat, values)`` of its bands; rows that no band has are NaN."""

    def nan(rows: Column) -> Column:
        return F.array_repeat(F.lit(float("nan")).cast("float"), F.greatest(rows, F.lit(0)) * n_lon)

    start = F.struct(F.lit(0).alias("top"), F.array().cast("array<array<float>>").alias("parts"))
    filled = F.aggregate(
        F.coalesce(bands, F.array().cast("array<struct<lat_start:int,n_lat:int,values:array<float>>>")), start,
        lambda acc, b: F.struct((b["lat_start"] + b["n_lat"]).alias("top"), F.concat(
            acc["parts"], F.array(nan(b["lat_start"] - acc["top"]), b["values"])).alias("parts")),
        lambda acc: F.concat(acc["parts"], F.array(nan(n_lat - acc["top"]))))
    return F.flatten(filled)


def new_cycles(cycles: DataFrame, existing: DataFrame, overwrite: bool = False) -> DataFrame:
    """Cycles to generate: those not stored yet, or all."""
    if overwrite:
        return cycles
    return cycles.join(existing.select("cycle_time").distinct(), "cycle_time", "left_anti")


# -- writing -----------------------------------------------------------------

def latest(writes: DataFrame, slot: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The last write of each slot, by ``order`` descending.

    A maximum is combined before the shuffle, so a slot with a third of all writes
    costs one row per task and not one big window.
    """
    payload = [c for c in writes.columns if c not in slot]
    rest = [c for c in payload if c not in order]
    newest = F.max(F.struct(*order, *rest)).alias("_w")
    return writes.groupBy(*slot).agg(newest).select(*slot, *[f"_w.{c}" for c in payload])


def latest_fields(fields: DataFrame) -> DataFrame:
    """``latest`` for rows with grids.

    Whether any slot occurs twice is asked of the narrow columns alone; if none does,
    which is the rule, no grid is moved. Else the winners are chosen on them as well.
    """
    key = ["release_ts", "source_path"]
    twice = fields.groupBy(*SLOT).agg(F.count("*").alias("n")).where("n > 1")
    if twice.isEmpty():
        return fields
    # The last release of a slot, and the last path of those released then: a maximum of a number is added up in a hash table, one of
    # a struct or a text needs its rows sorted, so only those of the last releases come to it.
    newest = fields.groupBy(*SLOT).agg(F.max("release_ts").alias("release_ts"))
    last = join_on(fields, newest, [*SLOT, "release_ts"], "left_semi")
    winner = last.groupBy(*SLOT, "release_ts").agg(F.max("source_path").alias("source_path"))
    # Identical replays of a file agree in every column.
    return join_on(last, winner, [*SLOT, *key], "left_semi").dropDuplicates(SLOT)


def _problem(spec: StoreSpec, validate: str, given: Sequence[str]) -> Column:
    hour = F.when(F.col("step_index").isNull(), F.concat(
        F.lit("forecast hour "), F.coalesce(F.col("forecast_hour").cast("string"), F.lit("?")),
        F.lit(" not in step mapping")))
    variable = F.when(~F.col("variable").isin(list(spec.variables)) | F.col("variable").isNull(),
                      F.concat(F.lit("variable '"), F.coalesce("variable", F.lit("?")),
                               F.lit("' not found in store")))
    # A slot is found by its cycle; without one nothing could be replaced later.
    undated = F.when(F.col("cycle_time").isNull(), F.lit("no cycle time"))
    # Either way a file with more members than there are slots is refused as a whole.
    members = F.when(F.col("n_members") > spec.members, F.format_string(
        f"ensemble size %d for {spec.members} slots", "n_members"))
    checks = [hour, variable]
    if "cycle_time" in given:
        checks.append(undated)
    if validate == "full":
        # A band is a part of the grid's height; the bands of a file are cut from whole grids.
        height = F.col("grid_lat") if "grid_lat" in given else F.col("n_lat")
        shape = F.when((F.col("n_lon") != spec.n_lon) | (height != spec.n_lat), F.format_string(
            f"spatial shape %d x %d where the store has {spec.n_lat} x {spec.n_lon}", height, "n_lon"))
        checks.append(shape)
        if spec.reference_time is not None:
            expected = F.lit(spec.reference_time).cast("timestamp")
            checks.insert(0, F.when(~F.col("cycle_time").eqNullSafe(expected), F.concat(
                F.lit("reference time "), F.coalesce(F.col("cycle_time").cast("string"), F.lit("?")),
                F.lit(f" in a store of {spec.reference_time}"))))
    elif validate != "minimal":
        raise ValueError(f"unknown validation {validate!r}")
    if "n_members" in given:
        checks.append(members)
    # Either way there is no slot for a member beyond the axis.
    checks.append(F.when(F.col("number") >= spec.members, F.lit("member beyond the ensemble axis")))
    return F.coalesce(*checks)


def check(incoming: DataFrame, spec: StoreSpec, validate: str = "full") -> DataFrame:
    """Add ``step_index`` and ``error`` (NULL if the row may be written).

    ``full`` checks reference time, hour, variable, grid shape and member count; ``minimal``
    leaves out the reference time and the shape. A row without a cycle time, or of a file with
    more members than slots, is refused either way. An ``error`` of the decoder stays. Bands
    tell the height of the grid they are cut from in ``grid_lat``. Rows that have no column for the
    cycle time or the number of members, as of a listing, are not checked for it.
    """
    if "step_index" not in incoming.columns:
        incoming = with_step_index(incoming, spec.axis)
    earlier = F.col("error") if "error" in incoming.columns else F.lit(None).cast("string")
    return incoming.withColumn("error", F.coalesce(earlier, _problem(spec, validate, incoming.columns)))


def write_log(checked: DataFrame) -> DataFrame:
    """One result row per input file."""
    return checked.groupBy(F.col("source_path").alias("path")).agg(
        F.min("error").alias("error"), F.min("variable").alias("variable"),
        F.min("step_index").alias("step_index"), F.min("cycle_time").alias("cycle_time"),
        F.max("n_members").alias("n_members"),
    ).select(
        F.col("error").isNull().alias("success"), "path", "cycle_time", "variable",
        F.when(F.col("error").isNull(), F.col("step_index")).otherwise(-1).alias("step_index"),
        F.when(F.col("error").isNull(), F.col("n_members")).otherwise(0).alias("n_members"), "error")


def merge(existing: DataFrame, incoming: DataFrame, unknown: bool = False) -> DataFrame:
    """Touched partitions as they are after the write: old slots not replaced, and the new ones.

    ``incoming`` should be a written table: its slots are counted. With ``unknown``, columns of
    the slot may be NULL: a NULL then is a value like any other, and no partition is pruned.
    """
    if unknown:
        touched = incoming.select(*PARTITION).distinct()
        kept = join_on(join_on(existing, touched, PARTITION, "left_semi"), incoming.select(*SLOT), SLOT, "left_anti")
        return kept.unionByName(incoming)
    # The bound on step_index makes the optimizer see a selective side, so the scan of
    # the store is pruned at run time to the touched partitions.
    touched = incoming.select(*PARTITION).where(F.col("step_index") >= 0).distinct()
    slots = incoming.select(*SLOT)
    if fits(slots):
        # Then the grids of the store stay where they are.
        touched, slots = F.broadcast(touched), F.broadcast(slots)
    kept = existing.join(touched, PARTITION, "left_semi").join(slots, SLOT, "left_anti")
    return kept.unionByName(incoming)


# What orders the writes of a slot: the release, and the file where two were released at once.
WRITE_ORDER = ["release_ts", "source_path"]


def outdated(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """Slots of ``incoming`` for which the store holds a later release.

    Only the keys of both sides are read. A row without a release time has no place in the order: it
    is a plain write and replaces what is there, as any dated row replaces it. The same file again is not outdated.
    """
    mine = incoming.select(*SLOT, *WRITE_ORDER).where(F.col("release_ts").isNotNull())
    theirs = existing.where(F.col("release_ts").isNotNull()).select(*SLOT, F.struct(*WRITE_ORDER).alias("_stored"))
    touched = mine.select(*PARTITION).distinct()
    theirs = join_on(theirs, F.broadcast(touched) if fits(touched) else touched, PARTITION, "left_semi")
    return join_on(mine, theirs, SLOT, "inner").where(F.col("_stored") > F.struct(*WRITE_ORDER)).select(*SLOT)


# What Hive and Spark escape in the names of partition folders.
_ESCAPED = {c: f"%{c:02X}" for c in [*range(1, 32), 127, *map(ord, "\"#%'*/:=?\\{[]^")]}


def partition_folder(values: Sequence[str | None]) -> str:
    """The folder of a partition, as Spark names it, from its values as text."""
    named = [v.translate(_ESCAPED) if v else "__HIVE_DEFAULT_PARTITION__" for v in values]
    return "/".join(f"{c}={v}" for c, v in zip(PARTITION, named, strict=True))


def _hidden(name: str) -> str:
    """The name of a file that is not to be seen yet."""
    return f"_next.{name}"


def _stage(path: str, run: str):
    """Write the rows of a task, which are in the order of their folders, a file per folder, under names that no reader lists."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.parquet as pq
        from pyspark import TaskContext

        from gridspark.sources.files import new_file

        name = f"part-{TaskContext.get().partitionId():05d}-{run}.parquet"
        for folder, parts in groupby(pieces(batches), key=itemgetter(0)):
            folder = partition_folder(folder)
            with new_file(f"{path}/{folder}/{_hidden(name)}") as out:
                writer, pending, held = None, [], 0
                for _, part in parts:
                    writer = writer or pq.ParquetWriter(out, part.schema)
                    pending, held = [*pending, part], held + part.nbytes
                    if held >= ROW_GROUP_BYTES:
                        flush(writer, pending, held)
                        pending, held = [], 0
                if pending:
                    flush(writer, pending, held)
                writer.close()
            yield pa.RecordBatch.from_pydict({"folder": [folder], "name": [name]})

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, pa.RecordBatch]]:
        for batch in batches:
            keys = list(zip(*(batch.column(f"_{c}").to_pylist() for c in PARTITION), strict=True))
            rows = batch.select([c for c in batch.schema.names if c[1:] not in PARTITION])
            start = 0
            for key, same in groupby(keys):
                n = len(list(same))
                yield key, rows.slice(start, n)
                start += n

    def flush(writer, parts: list[pa.RecordBatch], held: int) -> None:
        table = pa.Table.from_batches(parts)
        writer.write_table(table, row_group_size=max(1, len(table) * ROW_GROUP_BYTES // max(1, held)))

    return write


def _replace(path: str):
    """Per folder, whose files are in one task: what was there goes, the new files get their names. Doing it again changes nothing."""

    def swap(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from gridspark.sources.files import clear_folder, move_file

        rows = pd.concat(list(batches) or [pd.DataFrame(columns=["folder", "name"])])
        for folder, own in rows.groupby("folder"):
            names = own["name"].tolist()
            clear_folder(f"{path}/{folder}", {*names, *map(_hidden, names)})
            for name in names:
                move_file(f"{path}/{folder}/{_hidden(name)}", f"{path}/{folder}/{name}")
        yield rows[["folder"]]

    return swap


def save(fields: DataFrame, path: str) -> None:
    """Replace the partitions that occur in ``fields``.

    A file holds up to ``MEMBERS_PER_FILE`` members of one band of one slot, which is
    also the most that one shuffle key can hold, so no task gets a huge share. Grids that come without
    their ``moments`` get them here.

    Tasks write the files under hidden names; when all are there, each folder's old files go and the new ones get
    their names, by the tasks as well: a store has a folder per slot, and neither its files nor its folders pass one by one through the driver.
    """
    spark = fields.sparkSession
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    piece = [*PARTITION, "lat_start", F.floor(F.col("number") / MEMBERS_PER_FILE)]
    if "moments" not in fields.columns:
        fields = fields.withColumn("moments", moments.of("values"))
    fs, where = hadoop_path(spark, path)
    fs.mkdirs(where)
    named = [f"_{c}" for c in PARTITION]
    rows = (fields.select(*IN_FILES.names).repartition(tasks, *piece)
            .select(*[c for c in IN_FILES.names if c not in PARTITION], *[F.col(c).cast("string").alias(f"_{c}") for c in PARTITION])
            .sortWithinPartitions(*named, "lat_start", "number"))
    with staging(spark, "save") as folder:
        written = materialise(rows.mapInArrow(_stage(path, uuid.uuid4().hex), "folder string, name string"), "written", folder)
        written.repartition(tasks, "folder").mapInPandas(_replace(path), "folder string").count()
    spark.catalog.refreshByPath(path)


def write_region(fields: DataFrame, path: str) -> None:
    """Put fields into their slots; the rest of each touched partition is kept.

    A slot keeps its last write by release time, then path, whatever the order in which writes come:
    a late file of an earlier release leaves the stored one in place.
    The merged partitions are written to the shared folder first. A job that dies
    while it replaces partitions can be repeated from there or from its input; both
    give the same store, because a write replaces slots and never adds to them.
    """
    spark = fields.sparkSession
    newest = latest_fields(fields.select(
        *[as_float32("values").alias("values") if c == "values" else F.col(c) for c in FIELDS.names]))
    if not exists(spark, path):
        save(newest, path)
        return
    with staging(spark, "write") as folder:
        incoming = materialise(newest.withColumn("moments", moments.of("values")), "incoming", folder)
        cycles = touched_cycles(incoming)
        unknown = cycles is None or not incoming.where("variable IS NULL OR step_index IS NULL").isEmpty()
        existing = open_store(spark, path, IN_FILES, cycles)
        late = materialise(outdated(existing, incoming), "late", folder)
        if not late.isEmpty():
            incoming = materialise(join_on(incoming, F.broadcast(late) if fits(late) else late, SLOT, "left_anti"), "in-order", folder)
            if incoming.isEmpty():
                return
        save(materialise(merge(existing, incoming, unknown), "merged", folder), path)
