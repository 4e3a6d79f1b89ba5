import json
import struct
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from gridspark.operators import selection
from gridspark.sources import grids, ranges, refs
from gridspark.sources.files import list_files
from gridspark.sources.messages import encode


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.sampled_from("ab"), st.integers(0, 60), st.integers(0, 12)), max_size=30), st.integers(0, 9), st.integers(1, 40))
def test_runs_cover_all_ranges(found, gap, most):
    found = sorted(found)
    at = 0
    for first, last, start, length in ranges.runs(found, gap, most):
        own = found[first:last]
        assert first == at and len({p for p, *_ in own}) == 1
        assert start == own[0][1] and start + length == max(o + n for _, o, n in own)
        assert length <= most or len(own) == 1
        end = own[0][1]
        for _, offset, n in own:
            assert offset <= end + gap or offset == start
            end = max(end, offset + n)
        at = last
    assert at == len(found)


@pytest.fixture(scope="module")
def wide(tmp_path_factory):
    """One file of 50 members of 361 x 720 cells, each cell its own number."""
    folder = tmp_path_factory.mktemp("wide")
    cells = np.arange(361 * 720, dtype="<f4")
    with open(folder / "t2m.grib2", "wb") as f:
        for m in range(50):
            f.write(encode({"shortName": "2t", "cfVarName": "t2m", "dataDate": 20240101, "dataTime": 0, "step": 3, "Nj": 361, "Ni": 720},
                           (cells + m).tobytes()))
    return str(folder)


def test_a_box_reads_its_bands_only(spark, wide):
    """50 x 100 cells of 50 members: four bands of 16 rows each, one read per member."""
    rows = grids.open_grids(spark, wide, gap=0).where("variable = 't2m' AND forecast_hour = 3")
    part = grids.box(rows, slice(100, 150), slice(200, 300))
    got = part.select("number", "lat_start", "n_lat", F.size("values").alias("n"), F.get("values", F.lit(0)).alias("v")).collect()
    assert Counter(r.number for r in got) == {m: 4 for m in range(50)} and sum(r.n for r in got) == 50 * 50 * 100
    assert all(r.v == r.lat_start * 720 + 200 + r.number for r in got)
    assert grids.bytes_read(rows.where("lat_start > 84 AND lat_start < 150")).first() == (50, 50 * 4 * 16 * 720 * 4)
    # Filters on the header leave out whole messages, and several members in a row are one read.
    one = grids.open_grids(spark, wide).where(F.col("number").isin(7, 8))
    assert grids.bytes_read(one).first().bytes_read < 2 * 361 * 720 * 4 + 200
    assert grids.bytes_read(grids.open_grids(spark, wide).where("variable = 'u10'")).first() == (0, 0)


def test_filters_are_taken_by_the_source(spark, wide):
    rows = grids.open_grids(spark, wide).where("number >= 3 AND number < 5 AND lat_start = 16 AND n_lon = 720")
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "n_lon" in plan.split("Filter")[1].split("\n")[0] and "number" not in plan.split("Filter")[1].split("\n")[0]
    assert sorted((r.number, r.lat_start, r.n_lat) for r in rows.select("number", "lat_start", "n_lat").collect()) == [(3, 16, 16), (4, 16, 16)]


def test_box_of_files_is_box_of_fields(spark, wide):
    whole = grids.open_grids(spark, wide, bands=361).where("number = 2")
    want = selection.box(whole, slice(350, None), slice(700, None)).first()
    for bands in (1, 7, 16, 400):
        got = grids.box(grids.open_grids(spark, wide, bands=bands).where("number = 2"), slice(350, None), slice(700, None), bands)
        rows = got.orderBy("lat_start").select("values").collect()
        assert [v for r in rows for v in r["values"]] == want["values"]


def test_empty_folder(spark, tmp_path):
    assert grids.open_grids(spark, str(tmp_path)).count() == 0


@pytest.mark.parametrize("gap, most", [(0, 1 << 24), (1 << 16, 1 << 24), (10**9, 1), (200, 300)])
def test_coalesced_references_have_the_same_values(spark, tmp_path, gap, most):
    """One file with most of all references, several small ones, and inline values."""
    folder = tmp_path / "files"
    folder.mkdir()
    values = np.arange(300 * 8, dtype="<f4")
    (folder / "big.grib2").write_bytes(values.tobytes())
    rows = [(f"b{i}", str(folder / "big.grib2"), 32 * i, 32, None) for i in range(0, 300, 1 + (gap == 0))]
    for k in range(5):
        (folder / f"s{k}.grib2").write_bytes(values[:16].tobytes())
        rows += [(f"s{k}-{i}", str(folder / f"s{k}.grib2"), 32 * i, 32, None) for i in range(2)]
    rows.append(("inline", None, None, None, struct.pack("<f", 2.0).decode("latin1") if False else "abcd"))
    table = spark.createDataFrame(rows, "chunk_key string, path string, offset bigint, length bigint, inline string")
    opened = refs.open_refs(table, gap=gap, most=most, report=True).cache()
    got = {r.chunk_key: list(r["values"]) for r in opened.collect()}
    want = {key: values[o // 4:o // 4 + 8].tolist() for key, p, o, _, _ in rows if p}
    assert {k: v for k, v in got.items() if k != "inline"} == want and len(got["inline"]) == 1
    reads = {r.path.rsplit("/", 1)[1]: (r.n_refs, r.n_reads, r.bytes_read) for r in refs.reads(opened).collect()}
    assert sum(n for n, *_ in reads.values()) == len(want)
    n, many, size = reads["big.grib2"]
    if most == 1 or gap == 0:
        assert (many, size) == (n, 32 * n)
    elif most == 1 << 24:
        assert many <= 8 and size == 9600  # at most one read per task
    opened.unpersist()


def test_index_of_files_is_read_in_few_reads(spark, wide):
    indexed = refs.index_files(list_files(spark, wide)).where("length IS NOT NULL")
    opened = refs.open_refs(indexed, report=True, most=8 << 20).cache()
    row = refs.reads(opened).first()
    assert row.n_refs == 50 and row.n_reads <= 15 and row.bytes_read < 50 * 361 * 720 * 4 + 50 * 400
    assert json.loads(opened.agg(F.to_json(F.struct(F.min(F.get("values", F.lit(0))).alias("v")))).first()[0]) == {"v": 0.0}
    opened.unpersist()
