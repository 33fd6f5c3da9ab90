"""Operators with SQL: equal to DuckDB on the small tables."""

import duckdb
import pytest

from parley.llm import registry
from tests.compare import assert_same, views


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_oracle(spark, sf_dir, name):
    with duckdb.connect() as con:
        views(con, sf_dir)
        assert_same(registry.queries()[name](spark, sf_dir), con.sql(registry.oracle_sql()[name]))
