"""Every query that SQL can express, against DuckDB."""

import pytest

from millrace.queries import ORACLES, QUERIES
from tests.oracle import compare, connection

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def con():
    return connection(SF)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query(spark, con, name):
    compare(spark, con, name, QUERIES[name], ORACLES[name], SF)
