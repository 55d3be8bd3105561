"""Every registered query next to its SQL on the smallest tables."""

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from tests.check_oracle import compare, database

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return database(SF)


def test_entry(spark):
    rows = entry(spark).collect()
    assert {r.model for r in rows} == {"model_A", "model_N", "model_R"}


def test_every_sql_has_a_query():
    assert set(oracle_sql()) <= set(queries())


@pytest.mark.parametrize("name", sorted(queries()))
def test_query(spark, con, name):
    sql = oracle_sql().get(name)
    if sql is None:
        assert queries()[name](spark, SF).count() > 0
        return
    problem, n = compare(spark, con, name, queries()[name], sql, SF)
    assert problem is None
