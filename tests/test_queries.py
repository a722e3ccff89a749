"""Every named query against its SQL, or at least run to its end."""

import pytest

from assayer.catalog import ORACLE, QUERIES
from tools.compare import connect, difference


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_sql(spark, sf, con, name):
    assert difference(QUERIES[name](spark, sf), con, ORACLE[name]) is None


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_query_runs(spark, sf, name):
    df = QUERIES[name](spark, sf)
    assert df.columns and df.count() > 0


def test_entry(spark):
    import __spark_entry__ as entry

    df = entry.entry(spark)
    assert df.count() > 0 and set(entry.oracle_sql()) <= set(entry.queries())
