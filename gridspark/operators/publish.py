"""Incremental publishing: copy what changed, file by file, on the executors."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from gridspark.operators.joins import fits
from gridspark.runtime import hadoop_path, materialise
from gridspark.sources.files import relative_to

LOG = "path string, action string, size long, success boolean, error string"


def _like(path: Column, pattern: str | None) -> Column:
    """Glob over names, several separated by ``;``."""
    if pattern is None:
        return F.lit(True)
    wild = {"*": ".*", "?": "."}
    regex = "|".join("".join(wild.get(c) or re.escape(c) for c in p.strip()) for p in pattern.split(";"))
    return F.substring_index(path, "/", -1).rlike(f"^(?:{regex})$")


def plan(source: DataFrame, destination: DataFrame, delete: bool = False, include: str | None = None,
         exclude: str | None = None, by_time: bool = True) -> DataFrame:
    """What a sync of two listings ``(path, size[, modified])`` has to do.

    ``path`` is relative to the listed root. A file is ``changed`` if its size differs
    or, with ``by_time``, the source is newer; extra files are ``delete`` if asked for
    and else ``extra``.
    """

    def chosen(listing: DataFrame) -> DataFrame:
        rows = listing.where(_like(F.col("path"), include))
        return rows if exclude is None else rows.where(~_like(F.col("path"), exclude))

    left = chosen(source).select("path", *[F.col(c).alias(f"src_{c}") for c in source.columns if c != "path"])
    right = chosen(destination).select(
        "path", *[F.col(c).alias(f"dst_{c}") for c in destination.columns if c != "path"])
    changed = F.col("src_size") != F.col("dst_size")
    if by_time and "modified" in source.columns and "modified" in destination.columns:
        changed = changed | (F.col("src_modified") > F.col("dst_modified"))
    action = (F.when(F.col("dst_size").isNull(), "new")
              .when(F.col("src_size").isNull(), "delete" if delete else "extra")
              .when(changed, "changed").otherwise("same"))
    return left.join(right, "path", "full_outer").select(
        "path", action.alias("action"), F.coalesce("src_size", "dst_size").alias("size"))


def plan_chunks(plan_rows: DataFrame, partition_pattern: str) -> DataFrame:
    """Changed files counted per store partition, as the publish log reports them."""
    return (plan_rows.where(F.col("action").isin("new", "changed"))
            .groupBy(F.regexp_extract("path", partition_pattern, 0).alias("chunk"))
            .agg(F.count("*").alias("n_files"), F.sum("size").alias("n_bytes")))


def _next(path: str) -> str:
    """Name of a copy that is not to be seen yet; no reader lists names with an underscore."""
    folder, _, name = path.rpartition("/")
    return f"{folder}/_next.{name}"


def _tried(step, *values) -> str | None:
    try:
        step(*values)
    except Exception as e:  # one file never fails the sync
        return f"{type(e).__name__}: {e}"
    return None


def _copy(src_root: str, dst_root: str):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from gridspark.sources.files import copy_file

        for batch in batches:
            errors = [None if action == "delete" else _tried(
                copy_file, f"{src_root}/{path}", _next(f"{dst_root}/{path}") if swap else f"{dst_root}/{path}")
                for path, action, swap in zip(batch["path"], batch["action"], batch["swap"])]
            yield batch.assign(success=[e is None for e in errors], error=errors)
    return run


def _swap(dst_root: str):
    """Per folder, whose rows are in one task: old files out, new ones in; nothing if a copy is missing."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from gridspark.sources.files import delete_file, move_file

        rows = pd.concat(list(batches) or [pd.DataFrame(columns=["folder", "path", "action", "size", "success", "error"])])
        for _, own in rows.groupby("folder"):
            if not own["success"].all():
                own = own.assign(error=own["error"].fillna("another file of the folder failed"), success=False)
            else:
                gone, come = own[own["action"] == "delete"], own[own["action"] != "delete"]
                errors = [_tried(delete_file, f"{dst_root}/{p}") for p in gone["path"]]
                errors += [_tried(move_file, _next(f"{dst_root}/{p}"), f"{dst_root}/{p}") for p in come["path"]]
                own = pd.concat([gone, come]).assign(error=errors, success=[e is None for e in errors])
            yield own[["path", "action", "size", "success", "error"]]
    return run


def store_listing(fields: DataFrame, root: str, partitions: DataFrame | None = None) -> DataFrame:
    """Files of an opened store as ``(path, size, modified)``, relative to ``root``.

    With ``partitions`` (distinct partition columns) only theirs; no others are opened.
    """
    keys = [] if partitions is None else partitions.columns
    files = fields.select(*keys, "_metadata.file_path", "_metadata.file_size", "_metadata.file_modification_time")
    if partitions is not None:
        files = files.join(partitions, keys, "left_semi")
    # The metadata column escapes what a URI must escape; a listing does not.
    path = F.url_decode(F.replace("file_path", F.lit("+"), F.lit("%2B")))
    listing = files.select(path.alias("path"), F.col("file_size").alias("size"),
                           F.col("file_modification_time").alias("modified")).distinct()
    return relative_to(listing, root)


def apply(plan_rows: DataFrame, src_root: str, dst_root: str, dry_run: bool = False,
          within: str | None = None) -> DataFrame:
    """Carry out a plan and return its log; ``dry_run`` only returns what would be done.

    Rows are spread over tasks at random, so one directory with most of the files is
    copied by all of them. A copy lands under its name when it is complete, and doing
    it again changes nothing: a lost executor's files are simply copied again.

    In a folder that also loses files (a partition that was written again), the new files
    come under hidden names first; when all are there, the old ones go and the new ones
    get their names. A reader sees the old content, nothing for a moment, or the new
    content, but never both. If a copy fails, the folder stays as it was.
    """
    todo = plan_rows.where(F.col("action").isin("new", "changed", "delete")).select("path", "action", "size")
    if dry_run:
        return todo
    tasks = int(todo.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    todo = todo.withColumn("folder", F.regexp_extract("path", "^(.*)/[^/]*$", 1))
    replaced = materialise(todo.where("action = 'delete'").select("folder").distinct().withColumn("swap", F.lit(True)), "replaced", within)
    todo = todo.join(F.broadcast(replaced) if fits(replaced) else replaced, "folder", "left").withColumn("swap", F.coalesce("swap", F.lit(False)))
    copied = todo.repartition(tasks, F.xxhash64("path")).mapInPandas(_copy(src_root, dst_root), f"{LOG}, folder string, swap boolean")
    copied = materialise(copied, "copied", within)
    swapped = copied.where("swap").repartition(tasks, "folder").mapInPandas(_swap(dst_root), LOG)
    return materialise(copied.where("NOT swap").select("path", "action", "size", "success", "error").unionByName(swapped), "publish-log", within)


def incremental(source: DataFrame, destination: DataFrame, src_root: str, dst_root: str, **options) -> DataFrame:
    """``plan`` and ``apply`` in one call."""
    how = {k: options.pop(k) for k in ("dry_run", "within") if k in options}
    return apply(plan(source, destination, **options), src_root, dst_root, **how)


# -- versions ------------------------------------------------------------------------
#
# A published folder holds the files of a partition below ``data/version=N/...``, where N is the publish that brought them, a
# manifest per publish (which folder every partition has then), and a file that names the current manifest. A publish only adds files;
# putting that one file in place is what readers see of it, so they have all of one publish or all of another.

VERSIONS = "folder string, version bigint, n_files bigint, n_bytes bigint, digest bigint"


def digests(listing: DataFrame) -> DataFrame:
    """Per folder of a listing ``(path, size, modified)``: its files, bytes, and a digest of names, sizes and times in any order."""
    folder, name = F.regexp_extract("path", "^(.*)/[^/]*$", 1), F.substring_index("path", "/", -1)
    return listing.groupBy(folder.alias("folder")).agg(
        F.count("*").alias("n_files"), F.sum("size").alias("n_bytes"), F.bit_xor(F.xxhash64(name, "size", F.unix_millis("modified"))).alias("digest"))


def current_version(root: str) -> int | None:
    """The publish that readers see; None before the first."""
    from gridspark.sources.files import open_input

    try:
        with open_input(f"{root}/_current") as file:
            return int(file.read())
    except FileNotFoundError:
        return None


def manifest(spark: SparkSession, root: str, version: int) -> DataFrame:
    """The folders of one publish."""
    return spark.read.schema(VERSIONS).parquet(f"{root}/manifests/{version}")


def _copy_versions(src_root: str, dst_root: str, version: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from gridspark.sources.files import copy_file

        for batch in batches:
            errors = [_tried(copy_file, f"{src_root}/{p}", f"{dst_root}/data/version={version}/{p}") for p in batch["path"]]
            yield batch[["path", "size"]].assign(success=[e is None for e in errors], error=errors)

    return run


def publish_version(listing: DataFrame, src_root: str, dst_root: str, partitions: DataFrame | None = None) -> DataFrame:
    """Publish the folders of ``listing`` whose digest is not the published one; the log ``(path, size, success, error)`` of the files copied.

    ``listing`` has all of a store, or with ``partitions`` (one column ``folder``) all of those folders, the others staying
    as they are. A folder that is not listed any more is no longer published. If any copy fails, readers go on seeing the last publish, and the
    next one copies what is missing. One publisher at a time.
    """
    spark = listing.sparkSession
    before = current_version(dst_root)
    published = manifest(spark, dst_root, before) if before is not None else spark.createDataFrame([], VERSIONS)
    version = 0 if before is None else before + 1
    listing = materialise(listing.withColumn("folder", F.regexp_extract("path", "^(.*)/[^/]*$", 1)), "listing")
    now = digests(listing)
    held = published.select("folder", "version", F.struct("n_files", "n_bytes", "digest").alias("_held"))
    state = materialise(now.join(held, "folder", "left").withColumn(
        "changed", ~F.struct("n_files", "n_bytes", "digest").eqNullSafe(F.col("_held"))).drop("_held"), "state")
    wanted = state.where("changed").select("folder")
    files = listing.join(F.broadcast(wanted) if fits(wanted) else wanted, "folder", "left_semi").select("path", "size")
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    log = materialise(files.repartition(tasks, F.xxhash64("path")).mapInPandas(
        _copy_versions(src_root, dst_root, version), "path string, size bigint, success boolean, error string"), "publish-log")
    if not log.where("NOT success").isEmpty():
        return log
    after = state.select("folder", F.when(F.col("changed"), version).otherwise(F.col("version")).cast("long").alias("version"), "n_files", "n_bytes", "digest")
    if partitions is not None:
        after = after.unionByName(published.join(partitions.select("folder"), "folder", "left_anti"))
    from gridspark.sources.files import put_file

    after.write.mode("overwrite").parquet(f"{dst_root}/manifests/{version}")
    put_file(f"{dst_root}/_current", str(version).encode())
    return log


def open_published(spark: SparkSession, root: str, schema: T.StructType, version: int | None = None, folders: Column | None = None) -> DataFrame:
    """What the current publish (or ``version``) holds, with ``version`` telling which publish brought a row.

    Only the named folders are listed; ``folders`` is a condition on ``folder`` that leaves out others.
    """
    version = current_version(root) if version is None else version
    if version is None:
        raise FileNotFoundError(f"nothing is published at {root}")
    rows = manifest(spark, root, version)
    named = [f"{root}/data/version={r.version}/{r.folder}" for r in (rows if folders is None else rows.where(folders)).select("version", "folder").collect()]
    full = T.StructType([*schema.fields, T.StructField("version", T.LongType())])
    reader = spark.read.schema(full)
    return reader.option("basePath", f"{root}/data").parquet(*named) if named else spark.createDataFrame([], full)


def prune(spark: SparkSession, root: str, keep: int = 2) -> list[int]:
    """Remove the manifests before the last ``keep`` publishes, and the versions none of whose folders these hold; the versions removed."""
    last = current_version(root)
    if last is None:
        return []
    kept = [v for v in range(max(0, last - keep + 1), last + 1)]
    used = {r.version for r in spark.read.schema(VERSIONS).parquet(*[f"{root}/manifests/{v}" for v in kept]).select("version").distinct().collect()}
    gone = []
    for v in range(kept[0]):
        fs, where = hadoop_path(spark, f"{root}/manifests/{v}")
        fs.delete(where, True)
        fs, where = hadoop_path(spark, f"{root}/data/version={v}")
        if v not in used and fs.exists(where):
            fs.delete(where, True)
            gone.append(v)
    return gone
