"""Every query with SQL agrees with DuckDB on the smallest tables."""

import pytest

from sparkloom import registry
from tests.conftest import compared

SQL = registry.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_oracle(spark, sf, name):
    ours, theirs = compared(registry.queries()[name](spark, sf), SQL[name], sf)
    assert ours == theirs


def test_entry(spark):
    import __spark_entry__ as e

    df = e.entry(spark)
    assert df.columns == ["file_path", "other_path", "shared"] and df.count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
