import pytest
from oracle import BASE, agree, connect

from keystrata.llm.queries import CATALOGUE


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
