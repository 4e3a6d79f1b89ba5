"""Tables that are written to be read again."""

import os

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from gridspark.llm import common, dedup, jaccard


@pytest.fixture
def staged(monkeypatch, tmp_path):
    """The folders of the tables staged since, by label."""
    made = iter(range(10_000))
    monkeypatch.setattr(common, "new_dir", lambda spark, label: f"{tmp_path}/{label}-{next(made)}")
    return lambda: {d.name.rsplit("-", 1)[0]: [p.name for p in d.iterdir()] for d in tmp_path.iterdir()}


def by_hadoop(folders):
    """Labels of the tables whose files Hadoop made: it puts a checksum beside each file of a local file system."""
    return {label for label, names in folders.items() if any(n.endswith(".crc") for n in names)}


def test_narrow_tables_are_written_by_workers(spark, staged):
    rows = spark.range(1000).select(
        "id", (F.col("id") % 7).cast("int").alias("k"), (F.col("id") % 2 == 0).alias("even"), F.when(F.col("id") % 3 > 0, F.col("id").cast("string").cast("binary")).alias("b"),
        F.struct((F.col("id") / 3).alias("x"), F.col("id").cast("string").alias("s")).alias("pair"))
    read = common.stage(rows, "narrow", 1000)
    assert read.dtypes == rows.dtypes
    assert sorted(read.collect()) == sorted(rows.collect())
    assert by_hadoop(staged()) == set()
    assert common.stage(rows.where("id < 0"), "none", 0).collect() == []
    assert common.stage(rows.where("id < 0"), "none", 0).dtypes == rows.dtypes


def test_only_the_runs_that_counted_are_read(spark, staged, tmp_path):
    """A file that a failed or second run of a task has left in the folder is hidden."""

    def twice(batches):
        batches = list(batches)
        write = common._to_file(f"{tmp_path}/llm-made-0", iter)
        assert len(list(write(iter(batches)))) == (len(batches) > 0)
        yield from batches

    read = common.stage_made(spark.range(100).repartition(4), twice, "id bigint", "made")
    assert sorted(r.id for r in read.collect()) == list(range(100))
    names = staged()["llm-made"]
    assert sum(n.startswith("part-") for n in names) == sum(n.startswith("_part-") for n in names) > 0


def test_large_parts_have_several_row_groups(spark, staged, monkeypatch):
    import pyarrow.parquet as pq

    def bytes_of(batches):
        for batch in batches:
            for i in batch.column(0).to_pylist():
                yield pa.RecordBatch.from_pydict({"id": [i], "data": [os.urandom(3 << 20)]})

    read = common.stage_made(spark.range(0, 8, 1, 1), bytes_of, "id bigint, data binary", "large")
    file, = [p.removeprefix("file:") for p in read.inputFiles()]
    assert pq.ParquetFile("/" + file.lstrip("/")).num_row_groups == 3
    assert read.where(F.length("data") == 3 << 20).count() == 8


def test_near_dedup_starts_no_process_per_narrow_table(spark, documents, staged):
    rng = np.random.default_rng(5)
    words = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(120):
        base = list(rng.choice(words, 40)) if i % 4 == 0 else base
        rows.append((i, " ".join([*base[:i % 4], "new", *base[i % 4 + 1:]])))
    assert 0 < jaccard.one_per_group(documents(rows).repartition(6)).count() < 120
    folders = staged()
    assert by_hadoop(folders) == {"llm-described"} and len(folders) > 8


def test_exact_groups_start_no_process(spark, documents, staged):
    assert dedup.exact_dedup(documents([(i, f"text {i % 5}") for i in range(40)])).count() == 5
    assert "llm-groups" in staged() and "llm-groups" not in by_hadoop(staged())
