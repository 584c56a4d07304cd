"""Every query with SQL against DuckDB on the small tables; the others give rows."""

import pytest

from phrasemill.catalog import load
from tests.compare import connect, difference

QUERIES, SQL = load()


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_sql(spark, sf, con, name):
    assert difference(con, QUERIES[name](spark, sf), SQL[name]) is None


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_gives_rows(spark, sf, name):
    assert QUERIES[name](spark, sf).count() > 0
