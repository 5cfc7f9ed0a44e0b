"""Every registered query: against its SQL where there is one, else that it runs."""

import pytest

import __spark_entry__ as entry
from checks.compare import compare, connect

from .conftest import SF

SQL = entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_query(spark, con, name):
    ok, note = compare(spark, con, SF, name, entry.queries()[name], SQL.get(name))
    assert ok, note


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["Name", "Season", "Level", "N", "Miss", "Chase", "V90"]
    assert df.count() > 0


def test_oracle_names_are_queries():
    assert set(SQL) <= set(entry.queries())
