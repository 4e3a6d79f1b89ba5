"""Decoding payload files into fields, on the executors."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from gridspark.functions.naming import cf_name
from gridspark.functions.scalars import grib_time, member_index, valid_time
from gridspark.sources.messages import DECODERS

MESSAGE = ("source_path string, short_name string, cf_var string, data_date int, data_time int, "
           "forecast_hour int, perturbation int, n_ensemble int, number int, n_messages int, "
           "lat_start int, n_lat int, n_lon int, grid_lat int, {values}decode_error string{carry}")

CONTEXT = ["shortName", "cfVarName", "dataDate", "dataTime", "step", "Nj", "Ni"]


def members(messages: list, member_from: str) -> list[int]:
    """The member of every message: its position, or its perturbation number counted from 0.

    The control run has no perturbation (or 0) and comes after the perturbed members. Two
    messages of one member are an error of the file.
    """
    if member_from == "position":
        return list(range(len(messages)))
    numbers = [m.header.get("perturbationNumber") or 0 for m in messages]
    members = [n - 1 if n > 0 else max([0, *numbers]) for n in numbers]
    if len(set(members)) < len(members):
        raise ValueError("two messages of one member")
    return members


def _rows(path, size, context, carried, decoder, bands, with_values, member_from) -> Iterator[dict]:
    from gridspark.sources.files import open_input

    base = {"source_path": path, "lat_start": 0, **carried}
    try:
        with open_input(path) as file:
            size = file.size() if size is None else size
            messages = list(decoder(file, size, context))
            if not messages:
                raise ValueError("no message in file")
            first = messages[0].header
            base |= {
                "short_name": first.get("shortName"), "cf_var": first.get("cfVarName"),
                "data_date": first.get("dataDate"), "data_time": first.get("dataTime"),
                "forecast_hour": first.get("step"), "n_messages": len(messages),
                "n_ensemble": first.get("numberOfForecastsInEnsemble")}
            shape = (first["Nj"], first["Ni"])
            for m in messages:
                if (m.header["Nj"], m.header["Ni"]) != shape:
                    raise ValueError("messages of one file differ in shape")
            numbers = members(messages, member_from)
            if size < max(m.offset + m.length for m in messages):
                raise ValueError("file is cut short")
            for number, m in zip(numbers, messages if with_values else messages[:1]):
                row = base | {"number": number, "n_lon": shape[1], "grid_lat": shape[0],
                              "perturbation": m.header.get("perturbationNumber")}
                if not with_values:
                    yield row | {"n_lat": shape[0]}
                    continue
                for top in range(0, shape[0], bands or shape[0]):
                    height = min(bands or shape[0], shape[0] - top)
                    file.seek(m.offset + 4 * top * shape[1])
                    data = file.read(4 * height * shape[1])
                    if len(data) < 4 * height * shape[1]:
                        raise ValueError(f"short read of member {number}")
                    yield row | {"lat_start": top, "n_lat": height, "values": np.frombuffer(data, "<f4")}
    except Exception as e:  # a bad file is a result row, never a failed job
        yield base | {"decode_error": f"{type(e).__name__}: {e}"}


def _decode(decoder: Callable, bands: int | None, with_values: bool, member_from: str, schema: pa.Schema,
            context_columns: Sequence[str], carry: Sequence[str], batch_bytes: int = 32 << 20):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pending, held = [], 0
            for record in batch.to_pylist():
                context = {k: record[k] for k in context_columns}
                carried = {k: record[k] for k in carry}
                for row in _rows(record["path"], record.get("size"), context, carried, decoder, bands, with_values, member_from):
                    pending.append(row)
                    held += row["values"].nbytes if "values" in row else 256
                    if held >= batch_bytes:
                        yield pa.RecordBatch.from_pylist(pending, schema)
                        pending, held = [], 0
            if pending:
                yield pa.RecordBatch.from_pylist(pending, schema)
    return run


def _scan(files: DataFrame, decoder: str | Callable, bands: int | None, with_values: bool,
          carry: Sequence[str] = (), member_from: str = "position") -> DataFrame:
    decode = DECODERS[decoder] if isinstance(decoder, str) else decoder
    carried = "".join(f", {c} {files.schema[c].dataType.simpleString()}" for c in carry)
    schema = StructType.fromDDL(MESSAGE.format(values="values array<float>, " if with_values else "", carry=carried))
    context = [c for c in CONTEXT if c in files.columns]
    given = files.select("path", *(["size"] if "size" in files.columns else []), *context, *carry)
    tasks = int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # One row per file: this moves names, not data, and spreads the reading evenly.
    return given.repartition(tasks, F.xxhash64("path")).mapInArrow(
        _decode(decode, bands, with_values, member_from, to_arrow_schema(schema), context, carry), schema)


def _described(messages: DataFrame) -> DataFrame:
    return (messages
            .withColumn("variable", cf_name("cf_var", "short_name"))
            .withColumn("cycle_time", grib_time("data_date", "data_time"))
            .withColumn("valid_time", valid_time("cycle_time", "forecast_hour")))


def decode_files(files: DataFrame, decoder: str | Callable = "framed", member_from: str = "position",
                 bands: int | None = None, carry: Sequence[str] = ()) -> DataFrame:
    """All messages of every file in ``files(path[, size, ...])`` as fields.

    The metadata of a file is that of its first message; ``number`` is the position in
    the file, or follows the perturbation number with ``member_from="metadata"``. A file that
    cannot be read, or holds no message, is one row with ``error``; one that fails half way has
    such a row besides what was read, and ``run_batch`` writes nothing of it. Grids may be cut
    into ``bands`` of that many latitudes. Columns named in ``carry`` come along with
    every row, so nothing has to be joined to the grids later. Memory per task is one
    Arrow batch.
    """
    if member_from not in ("position", "metadata"):
        raise ValueError(f"unknown source of members {member_from!r}")
    rows = _described(_scan(files, decoder, bands, True, carry, member_from))
    return rows.select(
        "cycle_time", "variable", "forecast_hour", "valid_time", "number",
        "lat_start", "n_lat", "n_lon", "grid_lat", "values", F.col("n_messages").alias("n_members"),
        "n_ensemble", "source_path", F.col("decode_error").alias("error"), *carry)


def decode_metadata(files: DataFrame, decoder: str | Callable = "framed") -> DataFrame:
    """Metadata of the first message of every file; no values are read."""
    return _described(_scan(files, decoder, None, False)).select(
        "source_path", "variable", "forecast_hour", F.col("cycle_time").alias("reference_time"),
        "valid_time", member_index("perturbation").alias("ensemble_member"), "n_ensemble",
        "n_lat", "n_lon", F.col("decode_error").alias("error"))
