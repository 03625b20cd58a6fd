import os

import pytest

from ledgerloom import queries
from ledgerloom.plans import shape

ROOT = "/root/testdata/sf0.001"
here = pytest.mark.skipif(not os.path.isdir(ROOT), reason="needs the test tables")


@here
def test_each_query_has_its_sql():
    assert set(queries.queries()) == set(queries.oracle_sql())


@here
@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_equals_sql(spark, name):
    import duckdb

    from tools.compare import rows

    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for f in os.listdir(ROOT):
        con.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{ROOT}/{f}'")
    cursor = con.execute(queries.oracle_sql()[name])
    want = rows([d[0] for d in cursor.description], cursor.fetchall())
    df = queries.queries()[name](spark, ROOT)
    assert len(set(df.columns)) == len(df.columns)
    assert rows(df.columns, [tuple(r) for r in df.collect()]) == want


def query(spark, name):
    return queries.queries()[name](spark, ROOT)


@here
@pytest.mark.parametrize("name", ["signals_scored", "alerts_rules", "companies_overview", "keyword_search", "vector_search", "cost_metrics", "risk_delta_pairs", "p6_found", "replace_children", "upsert_merge"])
def test_stays_in_the_jvm(spark, name):
    df = query(spark, name)
    assert shape.stays_in_jvm(df) and not shape.pairs_all(df)


@here
def test_top_k_and_pruning(spark):
    for name in ("keyword_search", "vector_search", "companies_overview"):
        assert shape.nodes(query(spark, name))["TakeOrderedAndProject"] == 1
    assert shape.read_columns(query(spark, "slug_counts")) == [{"slug"}]
    assert all("text" not in c for c in shape.read_columns(query(spark, "p6_found")))


@here
def test_shapes_are_told_apart(spark):
    assert not shape.stays_in_jvm(query(spark, "html_text")) and shape.pairs_all(spark.range(3).crossJoin(spark.range(4).withColumnRenamed("id", "x")))
