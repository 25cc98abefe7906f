"""Every query that has SQL gives the rows of its SQL."""

import pytest
from engines import rows_of

from inkglass.plans import audit_queries, decision_queries, link_queries, meaning_queries, overlap_queries, rewrite_queries, text_queries  # noqa: F401
from inkglass.plans.registry import QUERIES, SQL


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows_as_sql(spark, duck, small, name):
    df = QUERIES[name](spark, small)
    expected = duck.sql(SQL[name])
    assert sorted(df.columns) == sorted(expected.columns)
    assert rows_of(df.columns, df.collect()) == rows_of(expected.columns, expected.fetchall())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_others_give_rows(spark, small, name):
    assert QUERIES[name](spark, small).limit(1).count() == 1


def test_entry(spark, small):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
