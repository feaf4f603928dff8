"""Every registered query against its SQL at the smallest size."""

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from tests.compare import database, same, types

SF = "/root/testdata/sf0.001"
ORACLES = oracle_sql()


@pytest.fixture(scope="module")
def con():
    return database(SF)


@pytest.mark.parametrize("name", list(queries()))
def test_query(spark, con, name):
    df = queries()[name](spark, SF)
    if name not in ORACLES:
        assert df.count() >= 0
        return
    assert same(df, con.execute(ORACLES[name]).df()) is None
    assert not types(df, con, ORACLES[name])


def test_entry(spark):
    assert entry(spark).count() > 0
