"""File listings and small file-system helpers for tasks."""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator, Sequence
from contextlib import contextmanager

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

# Suffixes of message files, and of the manifests beside them.
MESSAGE_GLOB = "*.{grib,grib2,grb,grb2}"
MANIFEST_GLOB = "*.grib2.json"

LISTING = T.StructType([
    T.StructField("path", T.StringType()),
    T.StructField("modificationTime", T.TimestampType()),
    T.StructField("length", T.LongType()),
    T.StructField("content", T.BinaryType()),
])


def list_files(spark: SparkSession, root: str | Sequence[str], glob: str | None = MESSAGE_GLOB,
               ignore_missing: bool = True, recursive: bool = True) -> DataFrame:
    """``(path, size, modified)`` of the files below ``root``; contents are never read.

    Spark leaves files of length 0 out of a scan. An empty payload is reported where a
    manifest names it.
    """
    reader = (spark.read.format("binaryFile")
              .option("recursiveFileLookup", str(recursive).lower())
              .option("ignoreMissingFiles", str(ignore_missing).lower()))
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return reader.load(root).select(
        "path", F.col("length").alias("size"), F.col("modificationTime").alias("modified"))


def relative_to(listing: DataFrame, root: str) -> DataFrame:
    """Listing with paths relative to ``root``."""
    base = re.escape(re.sub(r"^file:/+", "/", root.rstrip("/")))
    return listing.withColumn("path", F.regexp_replace(
        F.regexp_replace("path", "^file:/+", "/"), f"^{base}/", ""))


def match(path: Column, suffix: str | None = None, like: str | None = None,
          exclude: str | None = None) -> Column:
    """Path predicate: case-insensitive suffix and LIKE pattern, and a suffix to leave out."""
    test = F.lit(True)
    if suffix is not None:
        test = test & F.lower(path).endswith(suffix.lower())
    if like is not None:
        test = test & F.lower(path).like(like.lower())
    if exclude is not None:
        test = test & ~path.endswith(exclude)
    return test


# -- used inside tasks -----------------------------------------------------------

def locate(path: str) -> tuple[pafs.FileSystem, str]:
    """File system and path for a URI or a plain absolute path.

    Spark gives paths unescaped, so only scheme and authority are parsed as a URI.
    """
    remote = re.match(r"^(?!file:)([A-Za-z][A-Za-z0-9+.-]*://[^/]*)/*(.*)$", path)
    if not remote:
        return pafs.LocalFileSystem(), re.sub(r"^file:/+", "/", path)
    fs, base = pafs.FileSystem.from_uri(remote[1] + "/")
    return fs, f"{base.rstrip('/')}/{remote[2]}"


def open_input(path: str):
    fs, p = locate(path)
    return fs.open_input_file(p)


def _part(path: str) -> str:
    """Name of an unfinished file: not seen by listings, and different for every attempt,
    as a task may run twice at the same time."""
    folder, name = path.rsplit("/", 1)
    return f"{folder}/_part.{uuid.uuid4().hex}.{name}"


@contextmanager
def new_file(path: str) -> Iterator[pa.NativeFile]:
    """A stream into a file that appears under its name only when complete."""
    fs, p = locate(path)
    fs.create_dir(p.rsplit("/", 1)[0], recursive=True)
    part = _part(p)
    with fs.open_output_stream(part) as out:
        yield out
    fs.move(part, p)


def put_file(path: str, data: bytes) -> None:
    """Write a file so that it appears under its name only when complete."""
    with new_file(path) as out:
        out.write(data)


def copy_file(source: str, destination: str) -> None:
    """Copy one file in blocks; it appears under its name only when complete."""
    src_fs, src = locate(source)
    fs, dst = locate(destination)
    fs.create_dir(dst.rsplit("/", 1)[0], recursive=True)
    part = _part(dst)
    pafs.copy_files(src, part, source_filesystem=src_fs, destination_filesystem=fs)
    fs.move(part, dst)


def move_file(source: str, destination: str) -> None:
    """Rename a file; one that is there already under its new name was moved before."""
    fs, src = locate(source)
    _, dst = locate(destination)
    infos = fs.get_file_info([src, dst])
    if infos[0].type == pafs.FileType.NotFound and infos[1].type != pafs.FileType.NotFound:
        return
    fs.move(src, dst)


def delete_file(path: str) -> None:
    fs, p = locate(path)
    if fs.get_file_info(p).type != pafs.FileType.NotFound:
        fs.delete_file(p)


def clear_folder(path: str, keep: set[str]) -> None:
    """Delete the files of a folder except those named in ``keep``."""
    fs, p = locate(path)
    for info in fs.get_file_info(pafs.FileSelector(p)):
        if info.type == pafs.FileType.File and info.base_name not in keep:
            delete_file(f"{path}/{info.base_name}")
