"""Every query of the core runs over whole tables and agrees with its SQL twin."""

import pytest

from linkloom.plans import catalog

from duck import connect, rows


@pytest.fixture(scope="module")
def duck(small):
    return connect(small)


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_query_agrees_with_sql(spark, small, duck, name):
    mine = catalog.QUERIES[name](spark, small).toPandas()
    other = duck.execute(catalog.SQL[name]).df()
    assert sorted(mine.columns) == sorted(other.columns)
    assert rows(mine) == rows(other)


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.SQL)))
def test_query_without_sql_runs(spark, small, name):
    df = catalog.QUERIES[name](spark, small)
    assert len(df.columns) == len({c.lower() for c in df.columns})
    df.count()


def test_entry_point_has_rows(spark, small):
    assert catalog.entry(spark, small).count() > 0
