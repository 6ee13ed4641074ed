"""Every query of the subpackage: against its SQL where there is one, else that it runs with a stable schema."""

import pytest

from aguayo.llm.registry import QUERIES, SQL

from ..conftest import TESTDATA

COLUMNS = {
    "p3_found": ["row_id", "field_name"],
    "p5_found": ["row_id", "field_name", "entry_id"],
    "p7_found": ["field_name", "value_text", "mark"],
    "p9_found": ["doc_id", "item_id"],
    "p10_found": ["doc_id"],
}


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(compare, name):
    compare(QUERIES[name], SQL[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, name):
    df = QUERIES[name](spark, TESTDATA)
    assert df.count() > 0  # the smallest tables hold cases of every problem
    assert df.columns == COLUMNS.get(name, df.columns)
