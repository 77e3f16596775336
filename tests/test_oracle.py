import pytest
from oracle import BASE, agree, connect

from keystrata.plans import storage, store, training

CATALOGUE = training.CATALOGUE | store.CATALOGUE | storage.CATALOGUE


@pytest.fixture(scope="module")
def con():
    return connect()


@pytest.mark.parametrize("name", CATALOGUE)
def test_query(spark, con, name):
    query, sql = CATALOGUE[name]
    if sql:
        agree(spark, con, query, sql)
    else:
        assert query(spark, BASE).count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
