"""Virtual reference sets: byte ranges of existing files as a table."""

from __future__ import annotations

import base64
import codecs
import json
from collections.abc import Callable, Iterator, Sequence
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

from gridspark.operators.ranking import concat_index
from gridspark.sources.files import match, open_input
from gridspark.sources.messages import DECODERS
from gridspark.sources.ranges import GAP, MOST, Files, read_ranges

INDEXED = T.StructType([
    T.StructField("ref_set", T.StringType()),
    T.StructField("variable", T.StringType()),
    T.StructField("chunk_key", T.StringType()),
    T.StructField("path", T.StringType()),
    T.StructField("offset", T.LongType()),
    T.StructField("length", T.LongType()),
    T.StructField("inline", T.StringType()),
    T.StructField("error", T.StringType()),
])


def _file_refs(path: str, decoder: Callable, threshold: int) -> list[dict]:
    from gridspark.sources.files import open_input

    rows = []
    with open_input(path) as file:
        for member, m in enumerate(decoder(file, file.size(), {})):
            variable = m.header.get("cfVarName") or m.header["shortName"]
            if member == 0:
                coordinates = {"step": m.header["step"], "reference": m.header["dataDate"],
                               "shape": f"{m.header['Nj']}x{m.header['Ni']}"}
                rows += [{"ref_set": path, "variable": name, "chunk_key": f"{name}/0", "inline": str(value)}
                         for name, value in coordinates.items()]
            entry = {"ref_set": path, "variable": variable, "chunk_key": f"{variable}/{member}.0.0"}
            if m.length < threshold:
                file.seek(m.offset)
                entry["inline"] = "base64:" + base64.b64encode(file.read(m.length)).decode()
            else:
                entry |= {"path": path, "offset": m.offset, "length": m.length}
            rows.append(entry)
    if not rows:
        raise ValueError("no message in file")
    return rows


def _index(decoder: Callable, threshold: int, schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column("path").to_pylist():
                try:
                    rows = _file_refs(path, decoder, threshold)
                except Exception as e:  # a bad file is a result row
                    rows = [{"ref_set": path, "error": f"{type(e).__name__}: {e}"}]
                yield pa.RecordBatch.from_pylist(rows, schema)
    return run


def index_files(files: DataFrame, decoder: str | Callable = "framed", inline_threshold: int = 100) -> DataFrame:
    """One reference set per file of ``files(path)``: where each message's values lie.

    Only headers are read. Entries shorter than ``inline_threshold`` bytes, and the
    coordinates, are stored inline. A file that cannot be indexed is a row with ``error``.
    """
    decode = DECODERS[decoder] if isinstance(decoder, str) else decoder
    tasks = int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return (files.select("path").repartition(tasks, F.xxhash64("path"))
            .mapInArrow(_index(decode, inline_threshold, to_arrow_schema(INDEXED)), INDEXED))


def index_summary(indexed: DataFrame) -> DataFrame:
    """Per file: did indexing succeed, and how many references came of it."""
    return indexed.groupBy("ref_set").agg(
        F.max("error").isNull().alias("success"),
        F.count("chunk_key").alias("n_refs"), F.max("error").alias("error"))


def combine(refs: DataFrame, identical: Sequence[str] = ("shape",)) -> DataFrame:
    """Many reference sets as one, along a new axis in the order of their names.

    Entries of ``identical`` variables are kept once, from the first set; run
    ``check_identical`` to see that they agree.
    """
    good = refs.where(F.col("chunk_key").isNotNull()).drop("error")
    shared = F.col("variable").isin(list(identical))
    indexed = concat_index(good.where(~shared), "ref_set")
    once = (good.where(shared).groupBy("variable", "chunk_key")
            .agg(F.min(F.struct(*[c for c in good.columns if c not in ("variable", "chunk_key")])).alias("_r"))
            .select("variable", "chunk_key", "_r.*").withColumn("concat_index", F.lit(None).cast("long")))
    return indexed.unionByName(once, allowMissingColumns=True)


def check_identical(refs: DataFrame, dims: Sequence[str], value: str = "inline") -> DataFrame:
    """Per dimension entry: do all sets agree on it?"""
    return (refs.where(F.col("variable").isin(list(dims)))
            .groupBy("variable", "chunk_key")
            .agg(F.min(value).alias("_low"), F.max(value).alias("_high"), F.count("*").alias("n_sets"))
            .select("variable", "chunk_key", "n_sets", F.col("_low").eqNullSafe(F.col("_high")).alias("identical")))


# Characters of a reference file read at once, and entries in a batch of rows.
TEXT_AT_ONCE, ENTRIES_AT_ONCE = 1 << 20, 10_000


class _Text:
    """The JSON values of a text stream, one at a time; only the text of the one at hand is held."""

    def __init__(self, stream):
        self.stream, self.text, self.at, self.ended = codecs.getreader("utf-8")(stream), "", 0, False

    def _more(self) -> None:
        # As much again as is held, so that a long value is not tried too often.
        more = self.stream.read(max(TEXT_AT_ONCE, len(self.text) - self.at))
        self.text, self.at, self.ended = self.text[self.at:] + more, 0, not more

    def peek(self) -> str:
        """The next character that is no white space, empty at the end."""
        while True:
            while self.at < len(self.text) and self.text[self.at] in " \t\r\n":
                self.at += 1
            if self.at < len(self.text) or self.ended:
                return self.text[self.at:self.at + 1]
            self._more()

    def take(self, wanted: str) -> None:
        if self.peek() != wanted:
            raise ValueError(f"{wanted!r} expected, {self.peek()!r} found")
        self.at += 1

    def value(self):
        self.peek()
        while True:
            try:
                found, end = _DECODER.raw_decode(self.text, self.at)
                # A number may go on beyond what is held.
                if end < len(self.text) or self.ended:
                    self.at = end
                    return found
            except json.JSONDecodeError:
                if self.ended:
                    raise
            self._more()

    def keys(self) -> Iterator[str]:
        """The keys of an object; its values are to be taken in turn."""
        self.take("{")
        while self.peek() != "}":
            key = self.value()
            self.take(":")
            yield key
            if self.peek() != "}":
                self.take(",")
        self.take("}")


_DECODER = json.JSONDecoder()


def entries_of(stream) -> Iterator[tuple[str, str]]:
    """(key, entry) of the ``refs`` of a reference file, in order; whatever is no text is given as JSON."""
    text = _Text(stream)
    for name in text.keys():
        if name != "refs" or text.peek() != "{":
            text.value()
            continue
        for key in text.keys():
            value = text.value()
            yield key, value if isinstance(value, str) else json.dumps(value, separators=(",", ":"))


def _load(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for ref_set, path in zip(batch["ref_set"].to_pylist(), batch["path"].to_pylist(), strict=True):
            with open_input(path) as stream:
                try:
                    entries = entries_of(stream)
                    while part := list(islice(entries, ENTRIES_AT_ONCE)):
                        yield pa.RecordBatch.from_pydict({"ref_set": [ref_set] * len(part), "chunk_key": [k for k, _ in part], "entry": [e for _, e in part]},
                                                         pa.schema([(c, pa.string()) for c in ("ref_set", "chunk_key", "entry")]))
                except ValueError as e:
                    raise ValueError(f"{path} is no reference file: {e}") from e


def load_json(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """Reference JSON files (``refs``: inline text or ``[path, offset, length]``) as rows.

    ``master.json`` is left out where a folder of sets is read. A file is read a part at a time, however many
    references it has; one that is cut short or no JSON is an error that names it.
    """
    files = spark.read.format("binaryFile").load(paths).select(F.col("_metadata.file_path").alias("ref_set"), "path")
    many = not isinstance(paths, str) or not paths.endswith(".json")
    if many:
        files = files.where(match(F.col("ref_set"), exclude="master.json"))
    return parse_entries(files.mapInArrow(_load, "ref_set string, chunk_key string, entry string"))


def parse_entries(entries: DataFrame) -> DataFrame:
    """``(ref_set, chunk_key, entry)`` -> chunk references."""
    triple = F.from_json("entry", "array<string>")
    is_range = F.col("entry").startswith("[") & (F.size(triple) == 3)
    return entries.select(
        "ref_set", F.substring_index("chunk_key", "/", 1).alias("variable"), "chunk_key",
        F.when(is_range, triple[0]).alias("path"),
        F.when(is_range, triple[1].cast("long")).alias("offset"),
        F.when(is_range, triple[2].cast("long")).alias("length"),
        F.when(~is_range, F.col("entry")).alias("inline"))


def open_many(spark: SparkSession, folder: str) -> DataFrame:
    """All reference sets of a folder along a new axis in name order."""
    return concat_index(load_json(spark, folder), "ref_set")


# Bytes of values in one batch of rows that leaves a reader.
BATCH_BYTES = 32 << 20


def _inline(text: str) -> bytes:
    data = base64.b64decode(text[7:]) if text.startswith("base64:") else text.encode()
    if len(data) % 4:
        raise ValueError(f"inline text of {len(data)} bytes is no array of float32")
    return data


def _read(gap: int, most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files = Files()
        try:
            for batch in batches:
                inline = batch.column("inline").to_pylist()
                lengths = [len(t) if t is not None else n for t, n in zip(inline, batch.column("length").to_pylist(), strict=True)]
                paths, offsets = batch.column("path").to_pylist(), batch.column("offset").to_pylist()
                start, held = 0, 0
                for stop, n in enumerate(lengths, 1):
                    held += n
                    if held >= BATCH_BYTES or stop == len(lengths):
                        yield part(files, batch.slice(start, stop - start), inline[start:stop],
                                   list(zip(paths[start:stop], offsets[start:stop], lengths[start:stop], strict=True)))
                        start, held = stop, 0
        finally:
            files.close()

    def part(files: Files, rows: pa.RecordBatch, inline: list, ranges: list) -> pa.RecordBatch:
        values, reads = [None] * len(inline), [(None, 0)] * len(inline)
        for i, text in enumerate(inline):
            if text is not None:
                values[i] = np.frombuffer(_inline(text), "<f4")
        stored = [i for i, text in enumerate(inline) if text is None]
        for k, data, offset, length in read_ranges(files, [ranges[i] for i in stored], gap, most):
            values[stored[k]], reads[stored[k]] = np.frombuffer(data, "<f4"), (offset, length)
        return (rows.append_column("values", pa.array(values, pa.list_(pa.float32())))
                .append_column("read_offset", pa.array([o for o, _ in reads], pa.int64()))
                .append_column("read_length", pa.array([n for _, n in reads], pa.int64())))

    return run


def save(refs: DataFrame, path: str) -> None:
    """Keep a reference table, clustered as ``open_refs`` reads it."""
    (refs.repartitionByRange("variable", "path", "offset").sortWithinPartitions("variable", "path", "offset")
     .write.mode("overwrite").parquet(path))


def open_refs(refs: DataFrame, variable: str | None = None, gap: int = GAP, most: int = MOST, report: bool = False) -> DataFrame:
    """References with the float32 ``values`` they point to.

    Filter the references before: only those rows are read. They are range-partitioned
    by file and offset, so a task reads a few files front to back, and one file with a
    third of all references is shared by several tasks. References that are at most ``gap`` bytes apart are
    one read of up to ``most`` bytes; with ``report``, ``read_offset`` and ``read_length`` tell which (see ``reads``).
    """
    rows = refs if variable is None else refs.where(F.col("variable") == variable)
    schema = T.StructType([*rows.schema.fields, T.StructField("values", T.ArrayType(T.FloatType())),
                           T.StructField("read_offset", T.LongType()), T.StructField("read_length", T.LongType())])
    ordered = rows.repartitionByRange("path", "offset", "chunk_key").sortWithinPartitions("path", "offset")
    found = ordered.mapInArrow(_read(gap, most), schema)
    return found if report else found.drop("read_offset", "read_length")


def reads(opened: DataFrame) -> DataFrame:
    """What ``open_refs(report=True)`` read of every file: references, reads and bytes."""
    each = (opened.where(F.col("read_offset").isNotNull()).groupBy("path", "read_offset", "read_length").agg(F.count("*").alias("n")))
    return each.groupBy("path").agg(F.sum("n").alias("n_refs"), F.count("*").alias("n_reads"), F.sum("read_length").alias("bytes_read"))


def to_json(refs: DataFrame) -> DataFrame:
    """One reference entry per row in the JSON form of ``load_json``."""
    triple = F.to_json(F.array(F.col("path"), F.col("offset").cast("string"), F.col("length").cast("string")))
    return refs.select("ref_set", "chunk_key", F.coalesce("inline", triple).alias("entry"))


__all__ = ["check_identical", "combine", "index_files", "index_summary", "load_json", "open_many",
           "open_refs", "parse_entries", "reads", "save", "to_json"]
