"""Every registered query against its independent SQL, on the smallest tables."""

import pytest

import __spark_entry__ as entry
from oracle_check import compare, connect

SF = "/root/testdata/sf0.001"
SQL = entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connect(SF)


def test_every_oracle_has_a_query():
    assert set(SQL) <= set(entry.queries())


@pytest.mark.parametrize("name", list(entry.queries()))
def test_query(spark, con, name):
    verdict, rows, _ = compare(spark, con, SF, name, entry.queries()[name], SQL.get(name))
    assert verdict.startswith(("ok", "rows-only")), verdict


def test_entry(spark):
    assert entry.entry(spark).count() == 20
