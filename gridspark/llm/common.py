"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from gridspark.runtime import hadoop_path, new_dir, prepare

# ``monotonically_increasing_id`` puts the partition above this bit and the row's position below it.
TAG_BITS = 33
# Tables up to this many narrow rows (keys and a few numbers, about 40 bytes each) may be broadcast.
BROADCAST_ROWS = 200_000
# Such rows in a file of theirs, at least, where there are more partitions than the cores need.
FILE_ROWS = 100_000
ROW_GROUP_BYTES = 8 << 20


# A batch of texts is in a Python worker's memory several times over: as text, as ids, as output.
BATCH_ROWS = "2000"


def ready(spark: SparkSession) -> SparkSession:
    """The session with the package's settings, and batches of texts small enough for two workers per core."""
    prepare(spark).conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    return spark


def stage(df: DataFrame, label: str, rows: int | None = None) -> DataFrame:
    """Write ``df`` to the folder all executors share and read it back; it survives lost executors.

    ``rows`` tells that ``df`` has, and is made from, about so many narrow rows at most. Its partitions then
    go to files together, at least two for each core and one per ``FILE_ROWS``, as with ``stage_made``.
    """
    if rows is not None:
        return stage_made(df, None, df.schema, label, rows)
    path = new_dir(df.sparkSession, f"llm-{label}")
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def stage_made(df: DataFrame, make: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]] | None, schema: str | StructType,
               label: str, rows: int | None = None) -> DataFrame:
    """What ``make`` (None: nothing is changed) makes of the batches of each partition, staged; for keys, numbers and
    bytes, not for whole rows of a table. See ``stage`` for ``rows``.

    On a local or mounted file system the Python workers write the files: for each file and folder that Hadoop
    makes there it starts processes to set permissions, and until such a process runs it counts as large as the
    executor that starts it. A task may run more than once: each run writes a hidden file, and those of the runs
    that counted get names. Other file systems have Spark's writer.
    """
    spark = df.sparkSession
    path = new_dir(spark, f"llm-{label}")
    if rows is not None:
        df = df.coalesce(max(2 * spark.sparkContext.defaultParallelism, -(-rows // FILE_ROWS)))
    fs, folder = hadoop_path(spark, path)
    if fs.getScheme() != "file":
        made = df if make is None else df.mapInArrow(make, schema)
        made.write.option("compression", "zstd").parquet(path)
        return spark.read.schema(schema).parquet(path)
    names = [r["name"] for r in df.mapInArrow(_to_file(fs.makeQualified(folder).toString(), make or iter), "name string").collect()]
    if not names:
        return spark.createDataFrame([], schema)
    place = spark._jvm.org.apache.hadoop.fs.Path
    for name in names:
        if not fs.rename(place(folder, f"_{name}"), place(folder, name)):
            raise OSError(f"{path}/_{name} cannot be renamed")
    return spark.read.schema(schema).parquet(path)


def _to_file(path: str, make: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]):
    """Write what ``make`` makes of a partition to a hidden file, and give its name without the mark that hides it."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.parquet as pq

        from gridspark.sources.files import locate

        made = (batch for batch in make(batches) if batch.num_rows)
        first = next(made, None)
        if first is None:
            return
        fs, folder = locate(path)
        name = f"part-{uuid.uuid4().hex}.parquet"
        fs.create_dir(folder, recursive=True)
        with fs.open_output_stream(f"{folder}/_{name}") as out, pq.ParquetWriter(out, first.schema, compression="zstd") as writer:
            held, size = [], 0
            for batch in chain([first], made):
                held.append(batch)
                size += batch.nbytes
                if size >= ROW_GROUP_BYTES:
                    writer.write_table(pa.Table.from_batches(held))
                    held, size = [], 0
            if held:
                writer.write_table(pa.Table.from_batches(held))
        yield pa.RecordBatch.from_pydict({"name": [name]})

    return write


def tagged(docs: DataFrame) -> DataFrame:
    """One row per input row: ``tag`` identifies it, ``row`` holds all its columns.

    The columns are packed so that no name of theirs can clash with a working column. ``tag``
    depends on how the input is split, so a table with tags must be staged before it is read twice.
    """
    return docs.select(F.monotonically_increasing_id().alias("tag"), F.struct(*[docs[c] for c in docs.columns]).alias("row"))


def with_columns(docs: DataFrame, added: dict[str, Column]) -> list[Column]:
    """``row``'s columns and the added ones; an added column replaces one of the same name."""
    new = {k.lower() for k in added}
    return [F.col("row").getField(c).alias(c) for c in docs.columns if c.lower() not in new] + \
        [c.alias(k) for k, c in added.items()]


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df``, a written table of narrow rows, marked for a broadcast if a count shows that it fits."""
    return F.broadcast(df) if df.count() <= rows else df


def text_buffers(texts: pa.Array) -> Iterator[np.ndarray]:
    """The UTF-8 bytes of every text of an Arrow string or binary array, without copies; null is empty."""
    if isinstance(texts, pa.ChunkedArray):
        for chunk in texts.chunks:
            yield from text_buffers(chunk)
        return
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    valid, offsets, data = texts.buffers()
    ends = np.frombuffer(offsets, np.int64 if wide else np.int32)[texts.offset:texts.offset + len(texts) + 1]
    values = np.frombuffer(data, np.uint8) if data is not None and data.size else np.empty(0, np.uint8)
    nulls = texts.is_null().to_numpy(zero_copy_only=False) if texts.null_count else None
    for i in range(len(texts)):
        yield values[:0] if nulls is not None and nulls[i] else values[ends[i]:ends[i + 1]]


def crc_mod(column: str, modulus: int) -> Column:
    """crc32 of a column's text, modulo; null stays null."""
    return F.crc32(F.col(column).cast("string")) % modulus
