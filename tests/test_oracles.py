"""Every registered query against its SQL on the smallest test tables."""

import os

import pytest

from __spark_entry__ import entry
from checks import MODULES
from checks.compare import DATA, compare, connect

SF = f"{DATA}/sf0.001"
QUERIES = {k: v for m in MODULES for k, v in m.QUERIES.items()}
SQL = {k: v for m in MODULES for k, v in m.SQL.items()}
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not there")


@pytest.fixture(scope="module")
def con():
    return connect(SF)


def test_every_query_has_sql():
    assert set(QUERIES) == set(SQL)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, con, name):
    ok, message = compare(spark, con, QUERIES[name], SQL[name], SF)
    assert ok, message


def test_entry(spark):
    assert entry(spark).count() == 1
