import pytest
from odd_tables import write

from keystrata.plans import storage, store, training

#: Queries that name a version or index must say so when it isn't there.
REFUSE = {"diffs_from"}


@pytest.fixture
def quick(spark):
    """Rows this few aren't worth compiling for."""
    settings = {"spark.sql.codegen.wholeStage": "false", "spark.sql.codegen.factoryMode": "NO_CODEGEN", "spark.sql.shuffle.partitions": "3"}
    before = {k: spark.conf.get(k) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    yield spark
    for k, v in before.items():
        spark.conf.set(k, v)


@pytest.mark.parametrize("rows", [0, 3])
def test_queries_take_empty_and_null_tables(quick, tmp_path, rows):
    spark = quick
    base = write(tmp_path, rows)
    for name, (query, _) in (training.CATALOGUE | store.CATALOGUE | storage.CATALOGUE).items():
        try:
            query(spark, base).collect()
        except ValueError:
            assert name in REFUSE, name
        except Exception as e:
            raise AssertionError(name) from e
