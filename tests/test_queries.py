"""Every registered query with SQL gives the same rows as the SQL; the others give rows of a stable schema."""

import pytest

from docmill.plans.catalogue import QUERIES, SQL
from tests.compare import compare


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, sf, name):
    assert compare(spark, sf, name, QUERIES[name], SQL[name]) is None


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_query_without_sql_runs(spark, sf, name):
    df = QUERIES[name](spark, sf)
    assert df.count() > 0
    assert df.schema == QUERIES[name](spark, sf).schema


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
