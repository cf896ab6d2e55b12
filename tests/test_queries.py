"""Every registered query runs; where there is SQL, DuckDB gives the same rows."""

import pytest
from compare import duck, rows_of

from kbspark.plans import registry

SF = "/root/testdata/sf0.001"
QUERIES, SQL = registry.queries(), registry.oracle_sql()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    cols, rows = rows_of(QUERIES[name](spark, SF))
    assert cols
    if name in SQL:
        assert (cols, rows) == duck(SQL[name], SF)


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 1
    assert set(e.oracle_sql()) <= set(e.queries())
