import pytest
from odd_tables import write

from keystrata.llm.queries import CATALOGUE


@pytest.mark.parametrize("rows", [0, 3])
def test_queries_take_empty_and_null_tables(spark, tmp_path, rows):
    base = write(tmp_path, rows)
    for name, (query, _) in CATALOGUE.items():
        try:
            query(spark, base).collect()
        except Exception as e:
            raise AssertionError(name) from e
