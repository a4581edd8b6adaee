"""Every core query that has SQL gives the same rows as DuckDB."""

import pytest

from sortkit.queries import ORACLE_SQL, QUERIES
from tests.oracle import both

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", list(QUERIES))
def test_query_equals_sql(spark, name):
    cols, sql_cols, mine, theirs = both(spark, QUERIES[name], ORACLE_SQL[name], SF)
    assert cols == sql_cols
    assert mine == theirs


def test_entry_imports_and_lists():
    import __spark_entry__ as e

    assert set(QUERIES) <= set(e.queries())
    assert set(e.oracle_sql()) <= set(e.queries())


def test_entry_smoke(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 16
