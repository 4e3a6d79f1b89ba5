"""Grid files as a table that takes filters: a selection reads the byte ranges of its bands only.

A row is one latitude band of one member. Filters on variable, hour, member and band that Spark can hand to a source
are applied while the files are planned and read: those on a message's header leave out the message, those on
``lat_start`` leave out bands, and what is left are byte ranges, read together where they are neighbours.
"""

from __future__ import annotations

import operator
import re
from collections.abc import Callable, Iterator, Sequence
from fnmatch import fnmatch

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.datasource import (DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In,
                                    InputPartition, IsNotNull, LessThan, LessThanOrEqual)
from pyspark.sql.pandas.types import to_arrow_schema

from gridspark.operators import selection
from gridspark.sources.files import MESSAGE_GLOB, locate
from gridspark.sources.ingest import members
from gridspark.sources.messages import DECODERS, Message
from gridspark.sources.ranges import GAP, Files, read_ranges

SOURCE, BANDS = "gridspark_grids", 16
# Bytes of files dealt to one task, and of values in one batch of rows.
TASK_BYTES, BATCH_BYTES = 128 << 20, 32 << 20

ROWS = T.StructType([
    T.StructField("source_path", T.StringType()), T.StructField("variable", T.StringType()), T.StructField("data_date", T.IntegerType()),
    T.StructField("data_time", T.IntegerType()), T.StructField("forecast_hour", T.IntegerType()), T.StructField("number", T.IntegerType()),
    T.StructField("grid_lat", T.IntegerType()), T.StructField("lat_start", T.IntegerType()), T.StructField("n_lat", T.IntegerType()),
    T.StructField("n_lon", T.IntegerType()), T.StructField("values", T.ArrayType(T.FloatType())),
    T.StructField("read_offset", T.LongType()), T.StructField("read_length", T.LongType())])
TESTS: dict[type, Callable] = {EqualTo: operator.eq, GreaterThan: operator.gt, GreaterThanOrEqual: operator.ge,
                               LessThan: operator.lt, LessThanOrEqual: operator.le, In: lambda value, wanted: value in wanted,
                               IsNotNull: lambda value, _: True}
HEADER, BAND = ("variable", "data_date", "data_time", "forecast_hour", "number"), ("lat_start",)


class _Part(InputPartition):
    def __init__(self, files: list[tuple[str, int]]):
        self.files = files


def _passes(row: dict, tests: list) -> bool:
    return all(row[name] is not None and TESTS[kind](row[name], value) for kind, name, value in tests)


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.glob = options["path"], options.get("glob", MESSAGE_GLOB)
        self.decoder, self.bands, self.gap = options.get("decoder", "framed"), int(options.get("bands", BANDS)), int(options.get("gap", GAP))
        self.member_from = options.get("member_from", "position")
        self.header, self.band = [], []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            name = f.attribute[0] if type(f) in TESTS and len(f.attribute) == 1 else None
            if name in HEADER or name in BAND:
                (self.header if name in HEADER else self.band).append((type(f), name, getattr(f, "value", None)))
            else:
                yield f

    def partitions(self) -> Sequence[_Part]:
        """Files by name, dealt out by size."""
        fs, root = locate(self.path)
        scheme = re.match(r"^(?!file:)[A-Za-z][A-Za-z0-9+.-]*://[^/]*/", self.path)
        globs = [self.glob] if "{" not in self.glob else [self.glob.split("{")[0] + end for end in self.glob.split("{")[1].rstrip("}").split(",")]
        info = fs.get_file_info(root)
        found = [info] if info.is_file else fs.get_file_info(pafs.FileSelector(root, recursive=True))
        files = sorted((i.path, i.size) for i in found if i.is_file and not i.base_name.startswith(("_", "."))
                       and any(fnmatch(i.base_name, g) for g in globs))
        parts, held = [], TASK_BYTES
        for path, size in files:
            if held >= TASK_BYTES:
                parts.append([])
                held = 0
            parts[-1].append((scheme[0] + path.split("/", 1)[1] if scheme and "/" in path else path, size))
            held += size
        return [_Part(p) for p in parts] or [_Part([])]

    def _bands(self, path: str, messages: list[Message]) -> Iterator[tuple[dict, int, int]]:
        """(row without values, offset, length) of every band that the filters leave."""
        for number, m in zip(members(messages, self.member_from), messages, strict=True):
            h = m.header
            row = {"source_path": path, "variable": h.get("cfVarName") or h.get("shortName"), "data_date": h.get("dataDate"),
                   "data_time": h.get("dataTime"), "forecast_hour": h.get("step"), "number": number, "grid_lat": h["Nj"], "n_lon": h["Ni"]}
            if not _passes(row, self.header):
                continue
            for top in range(0, h["Nj"], self.bands):
                height = min(self.bands, h["Nj"] - top)
                if _passes({"lat_start": top}, self.band):
                    yield row | {"lat_start": top, "n_lat": height}, m.offset + 4 * top * h["Ni"], 4 * height * h["Ni"]

    def read(self, partition: _Part) -> Iterator[pa.RecordBatch]:
        from gridspark.sources.files import open_input

        schema, files, rows, held = to_arrow_schema(ROWS), Files(), [], 0
        try:
            for path, size in partition.files:
                with open_input(path) as file:
                    wanted = list(self._bands(path, list(DECODERS[self.decoder](file, size, {}))))
                for i, data, offset, length in read_ranges(files, [(path, o, n) for _, o, n in wanted], self.gap):
                    rows.append(wanted[i][0] | {"values": np.frombuffer(data, "<f4"), "read_offset": offset, "read_length": length})
                    held += len(data)
                    if held >= BATCH_BYTES:
                        yield pa.RecordBatch.from_pylist(rows, schema)
                        rows, held = [], 0
            yield pa.RecordBatch.from_pylist(rows, schema)
        finally:
            files.close()


class GridFiles(DataSource):
    """``spark.read.format(SOURCE).option("bands", 16).load(folder)``."""

    @classmethod
    def name(cls) -> str:
        return SOURCE

    def schema(self) -> T.StructType:
        return ROWS

    def reader(self, schema: T.StructType) -> _Reader:
        return _Reader(dict(self.options))


def open_grids(spark: SparkSession, path: str, bands: int = BANDS, gap: int = GAP, decoder: str = "framed",
               member_from: str = "position") -> DataFrame:
    """The bands of all grid files below ``path`` (or of one file), with columns ``ROWS``; filter before use.

    ``number`` is the position in the file, or follows its header with ``member_from="metadata"``. ``read_offset`` and ``read_length`` tell which bytes a row came with. A file that
    cannot be read is an error of the query; files that may be damaged belong through ``sources.ingest.decode_files``.
    """
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(GridFiles)
    return (spark.read.format(SOURCE).option("bands", bands).option("gap", gap).option("decoder", decoder)
            .option("member_from", member_from).load(path))


def box(grids: DataFrame, lat: slice, lon: slice, bands: int = BANDS) -> DataFrame:
    """``selection.box`` of ``open_grids(bands=bands)``, with the bounds of ``lat`` in a form that the source takes."""
    inside = F.col("lat_start") > (lat.start or 0) - bands
    if lat.stop is not None:
        inside = inside & (F.col("lat_start") < lat.stop)
    return selection.box(grids.where(inside), lat, lon)


def bytes_read(grids: DataFrame) -> DataFrame:
    """Reads and bytes of the rows of ``open_grids``, headers not counted."""
    each = grids.groupBy("source_path", "read_offset").agg(F.max("read_length").alias("n"))
    return each.agg(F.count("*").alias("n_reads"), F.coalesce(F.sum("n"), F.lit(0)).alias("bytes_read"))
