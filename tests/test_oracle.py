"""Every registered query against its SQL on the smallest tables."""

import pytest

from __spark_entry__ import oracle_sql, queries
from oracle_check import compare, connect

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(queries()))
def test_query(spark, con, name):
    assert compare(spark, con, SF, name, queries()[name], oracle_sql().get(name)) == ""


def test_every_sql_has_a_query():
    assert set(oracle_sql()) <= set(queries())
