import os

import pytest

from ledgerloom.llm import queries

ROOT = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(ROOT), reason="needs the test tables")
@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_runs_with_distinct_rows(spark, name):
    df = queries.queries()[name](spark, ROOT)
    assert df.count() >= 0
    if name.endswith("_found"):
        assert df.count() == df.distinct().count()


def test_each_sql_has_a_query():
    assert set(queries.oracle_sql()) <= set(queries.queries())
