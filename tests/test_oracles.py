"""Every driver query against its reference SQL in DuckDB."""

import os

import pytest

import __spark_entry__ as entry
from tools.compare import compare, duck
from workloads.registry import ORACLES, QUERIES

SF_DIR = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.01")


@pytest.fixture(scope="module")
def con():
    if not os.path.isdir(SF_DIR):
        pytest.skip("no test tables")
    return duck(SF_DIR)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query_matches_sql(spark, con, name):
    assert compare(spark, con, name, SF_DIR) == ""


def test_every_query_has_reference_sql():
    assert set(ORACLES) == set(QUERIES)


def test_entry_runs(spark):
    assert entry.entry(spark).count() > 0
