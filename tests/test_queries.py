"""Every registered query against its SQL twin, on the smallest tables."""

import re
from pathlib import Path

import pytest

import __spark_entry__ as entry
from gridspark.plans.registry import QUERIES
from tools.check import compare, connect

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(FOLDER).exists(), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.mark.parametrize("name", list(QUERIES))
def test_twin(spark, con, name):
    assert compare(spark, con, FOLDER, name, entry.oracle_sql().get(name)) is None


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_every_query_reads_a_table(spark):
    names = {p.stem for p in Path(FOLDER).glob("*.parquet")}
    for name, sql in ((n, q.sql) for n, q in QUERIES.items() if q.sql):
        assert names & set(re.findall(r"\w+", sql)), name
