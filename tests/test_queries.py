"""Every core query against its SQL on the smallest tables; queries without SQL must run."""

import pytest

from aguayo.plans.registry import QUERIES, SQL

from .conftest import TESTDATA


def test_every_sql_has_a_query():
    assert set(SQL) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(compare, name):
    compare(QUERIES[name], SQL[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, name):
    df = QUERIES[name](spark, TESTDATA)
    assert df.columns and df.count() > 0


def test_entry_is_the_corpus(spark):
    import __spark_entry__ as e

    assert set(QUERIES) <= set(e.queries()) and set(SQL) <= set(e.oracle_sql())
    df = e.entry(spark)
    assert len(df.columns) == 42 and df.count() > 0
