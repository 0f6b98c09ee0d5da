"""Every registered query against its DuckDB text on the smallest tables."""

import pytest
from parity import check, duck

from barloom.catalog import ORACLES, QUERIES

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return duck(FOLDER)


@pytest.mark.parametrize("name", [n for n in QUERIES if n in ORACLES])
def test_query_equals_sql(spark, con, name):
    rows, problem = check(spark, con, name, FOLDER)
    assert problem is None, problem
    assert rows > 0
