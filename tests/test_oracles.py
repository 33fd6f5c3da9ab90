"""Every query with an oracle equals DuckDB on the small tables."""

import duckdb
import pytest

from parley.plans import catalog
from tests.compare import assert_same, views


@pytest.fixture(scope="module")
def con(sf_dir):
    with duckdb.connect() as c:
        views(c, sf_dir)
        yield c


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_oracle(spark, sf_dir, con, name):
    assert_same(catalog.queries()[name](spark, sf_dir), con.sql(catalog.oracle_sql()[name]))


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(catalog.oracle_sql())))
def test_runs(spark, sf_dir, name):
    assert catalog.queries()[name](spark, sf_dir).count() > 0
