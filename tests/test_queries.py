import pytest
from conftest import DATA
from oracle import same

import sheetwright.plans.file_queries  # noqa: F401
from sheetwright.plans.queries import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, name):
    sf_dir = f"{DATA}/sf0.001"
    assert same(QUERIES[name](spark, sf_dir), ORACLES[name], sf_dir) >= 0


def test_entry_and_registry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 10
    assert set(e.oracle_sql()) <= set(e.queries()) and set(QUERIES) <= set(e.queries())
