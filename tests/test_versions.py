import threading
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from gridspark.operators import publish, store

CYCLE = datetime(2024, 1, 1)


def fields(spark, value, steps):
    return spark.range(steps).select(
        F.lit(CYCLE).alias("cycle_time"), F.lit("t2m").alias("variable"), F.col("id").cast("int").alias("step_index"), F.lit(0).alias("number"),
        F.lit(0).alias("lat_start"), F.lit(1).alias("n_lat"), F.lit(1).alias("n_lon"), F.array(F.lit(float(value)).cast("float")).alias("values"),
        F.lit(f"f{value}").alias("source_path"), F.lit(None).cast("timestamp").alias("release_ts"))


def send(spark, root, out, rows=None):
    partitions = None if rows is None else rows.select(*store.PARTITION).distinct()
    listing = publish.store_listing(store.open_store(spark, root), root, partitions)
    return publish.publish_version(listing, root, out, None if rows is None else publish.digests(listing).select("folder")).collect()


def seen(spark, out, **kw):
    return sorted((r.step_index, r["values"][0], r.version) for r in publish.open_published(spark, out, store.FIELDS, **kw).collect())


def test_only_changed_folders_are_copied(spark, tmp_path):
    root, out = str(tmp_path / "store"), str(tmp_path / "out")
    with pytest.raises(FileNotFoundError):
        publish.open_published(spark, out, store.FIELDS)
    store.write_region(fields(spark, 1, 12), root)
    assert len(send(spark, root, out)) == 12 and send(spark, root, out) == []
    one = fields(spark, 2, 12).where("step_index = 7")
    store.write_region(one, root)
    log = send(spark, root, out, one)
    assert len(log) == 1 and "step_index=7" in log[0].path
    assert seen(spark, out) == [(s, 2.0 if s == 7 else 1.0, 2 if s == 7 else 0) for s in range(12)]
    # A reader of an earlier publish still has all of it.
    assert seen(spark, out, version=0) == [(s, 1.0, 0) for s in range(12)]
    assert seen(spark, out, folders=F.col("folder").endswith("step_index=7")) == [(7, 2.0, 2)]
    assert publish.prune(spark, out, keep=1) == [] and len(seen(spark, out)) == 12
    store.write_region(fields(spark, 3, 12), root)
    send(spark, root, out)
    assert publish.prune(spark, out, keep=1) == [0, 2] and seen(spark, out) == [(s, 3.0, 3) for s in range(12)]


def test_a_reader_sees_one_publish_or_the_other(spark, tmp_path):
    root, out = str(tmp_path / "store"), str(tmp_path / "out")
    store.write_region(fields(spark, 0, 6), root)
    send(spark, root, out)
    stop, found, errors = threading.Event(), [], []

    def read():
        while not stop.is_set():
            try:
                found.append({(s, v) for s, v, _ in seen(spark, out)})
            except Exception as e:
                errors.append(e)

    reader = threading.Thread(target=read)
    reader.start()
    for value in (1, 2):
        store.write_region(fields(spark, value, 6), root)
        send(spark, root, out)
    stop.set()
    reader.join()
    assert not errors and found and all(rows in [{(s, float(v)) for s in range(6)} for v in range(3)] for rows in found)


def test_a_failed_copy_changes_nothing_for_readers(spark, tmp_path):
    root, out = str(tmp_path / "store"), str(tmp_path / "out")
    store.write_region(fields(spark, 0, 3), root)
    send(spark, root, out)
    store.write_region(fields(spark, 1, 3), root)
    listing = publish.store_listing(store.open_store(spark, root), root)
    more = listing.unionByName(spark.createDataFrame([("cycle_time=x/variable=t2m/step_index=0/gone.parquet", 5)], "path string, size bigint")
                               .withColumn("modified", F.current_timestamp()))
    assert [r.success for r in publish.publish_version(more, root, out).collect()].count(False) == 1
    assert seen(spark, out) == [(s, 0.0, 0) for s in range(3)]
    send(spark, root, out)
    assert seen(spark, out) == [(s, 1.0, 1) for s in range(3)]
