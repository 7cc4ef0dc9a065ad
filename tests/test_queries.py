"""Every query with oracle SQL against DuckDB on the smallest tables; the others run."""

import pytest

from conftest import SF, duck, rows_of
from millrace.jobs import registry


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_against_duckdb(spark, name):
    assert rows_of(registry.QUERIES[name](spark, SF)) == duck(registry.SQL[name])


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.SQL)))
def test_runs(spark, name):
    assert registry.QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
