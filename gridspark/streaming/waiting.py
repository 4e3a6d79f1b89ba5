"""A streaming source of manifests that could not be read when they were seen.

The table of those that wait holds, for each, its size and modification time when it was last read. The source looks
at the files themselves at every trigger: one that has changed since is handed out again. Its offset names
the files of a step with the state in which they were found, so a step that is replayed reads the same files. Whether anything else
arrives does not matter, and nothing but the names of files that changed passes through the driver.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence

from pyspark.sql import DataFrame, SparkSession, types as T
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from gridspark.sources.files import locate, open_input
from gridspark.sources.manifests import MANIFEST

SOURCE = "gridspark_waiting_manifests"
# What is known of a file when it is read.
STATE = T.StructType([
    T.StructField("manifest_path", T.StringType()), T.StructField("modified_ms", T.LongType()), T.StructField("size", T.LongType())])
ROWS = T.StructType([*MANIFEST.fields, *STATE.fields, T.StructField("corrupt", T.BooleanType())])
# Files read by one task.
PER_TASK = 32


def parse(data: bytes) -> tuple | None:
    """The fields of a manifest; None if it is not whole: no JSON object, a field of another kind, no id or no path."""
    try:
        found = json.loads(data)
    except ValueError:
        return None
    if not isinstance(found, dict):
        return None
    kinds = {"string": str, "int": int}
    values = []
    for field in MANIFEST.fields:
        value = found.get(field.name)
        if value is not None and (not isinstance(value, kinds[field.dataType.simpleString()]) or isinstance(value, bool)):
            return None
        values.append(value)
    named = dict(zip(MANIFEST.names, values, strict=True))
    return None if named["file_id"] is None or named["landing_path"] is None else tuple(values)


def states(paths: Sequence[str]) -> list[tuple[int, int] | None]:
    """(modification time in ms, size) of files; None of one that is not there."""
    out = []
    for path in paths:
        fs, p = locate(path)
        info = fs.get_file_info(p)
        out.append((info.mtime_ns // 1_000_000, info.size) if info.is_file else None)
    return out


class _Files(InputPartition):
    def __init__(self, files: list[list]):
        self.files = files


class _Reader(DataSourceStreamReader):
    def __init__(self, table: str, limit: int):
        self.table, self.limit, self.last = table, limit, None

    def initialOffset(self) -> dict:
        return {"files": "[]"}

    def latestOffset(self) -> dict:
        """The next files to read again; the offset before if none has changed."""
        ready = []
        for path, modified, size in self._waiting():
            state = states([path])[0]
            if state is not None and state != (modified, size):
                ready.append([path, *state])
                if len(ready) == self.limit:
                    break
        if ready or self.last is None:
            self.last = {"files": json.dumps(sorted(ready))}
        return self.last

    def _waiting(self) -> Iterator[tuple[str, int, int]]:
        """The table of those that wait, a batch of rows at a time."""
        import pyarrow.dataset as ds

        fs, path = locate(self.table)
        if not fs.get_file_info(path).type.name == "Directory":
            return
        try:
            for batch in ds.dataset(path, filesystem=fs, format="parquet").to_batches():
                yield from zip(*(batch.column(c).to_pylist() for c in ("manifest_path", "modified_ms", "size")), strict=True)
        except FileNotFoundError:  # being replaced by the batch at work: the next trigger sees it
            return

    def partitions(self, start: dict, end: dict) -> list[_Files]:
        if start == end:
            return []
        files = json.loads(end["files"])
        return [_Files(files[k:k + PER_TASK]) for k in range(0, len(files), PER_TASK)]

    def read(self, partition: _Files) -> Iterator[tuple]:
        for path, modified, size in partition.files:
            try:
                with open_input(path) as file:
                    found = parse(file.read())
            except FileNotFoundError:
                found = None
            yield (*(found or [None] * len(MANIFEST.fields)), path, modified, size, found is None)


class WaitingManifests(DataSource):
    """``spark.readStream.format(SOURCE).option("table", ...)``."""

    @classmethod
    def name(cls) -> str:
        return SOURCE

    def schema(self) -> T.StructType:
        return ROWS

    def streamReader(self, schema: T.StructType) -> _Reader:
        return _Reader(self.options["table"], int(self.options.get("maxfilespertrigger", 100)))


def waiting_manifests(spark: SparkSession, table: str, max_files: int = 100) -> DataFrame:
    """Manifests named in ``table`` (columns ``STATE``) as soon as they have changed, with ``corrupt`` marked."""
    spark.dataSource.register(WaitingManifests)
    return spark.readStream.format(SOURCE).option("table", table).option("maxFilesPerTrigger", max_files).load()
