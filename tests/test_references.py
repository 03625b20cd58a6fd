from datetime import datetime

from ledgerloom.operators import orphans

T = datetime


def tables(spark):
    companies = [("0000000001", T(2020, 1, 1)), ("0000000001", T(2022, 1, 1)), ("0000000002", T(2020, 1, 1)), ("0000000003", T(2023, 6, 1))]
    filings = [
        ("0000000009-20-000001", "CIK 0000000001", T(2020, 2, 1)), ("0000000009-20-000002", "2", T(2020, 2, 1)), ("0000000009-20-000003", None, T(2020, 2, 1)), ("0000000009-20-000004", " ", T(2020, 2, 1)),
        ("0000000009-21-000005", "77", T(2021, 2, 1)), ("0000000009-21-000006", " 0000000003 ", T(2021, 2, 1)), ("0000000009-21-000005", "77", T(2021, 2, 1)), ("0000000009-99-000007", "no number", T(2021, 2, 1)),
    ]
    sections = [
        ("0000000009-20-000001:mdna", "000000000920000001"), ("0000000009-20-000002:mdna", " 0000000009–20–000002\t"), ("0000000009-30-000001:x", "0000000009-30-000001"), ("0000000009-20-000003:y", None),
        ("0000000009-20-000001:mdna", "000000000920000001"), ("0000000009-21-000006:gone", "0000000009-21-000006"),
    ]
    chunks = [
        ("c1", "0000000009-20-000001 : MDNA "), ("c2", "0000000009-20-000001:other"), ("c3", None), ("c4", " "), ("c5", "0000000009-21-000006:gone"), ("c2", "0000000009-20-000001:other"), (None, "0000000009-20-000001:other"),
    ]
    tombstones = [
        ("companies", "0000000001", T(2021, 1, 1)), ("companies", "0000000002", T(2021, 1, 1)), ("filings", "0000000009-20-000002", T(2019, 1, 1)), ("sections", "0000000009-21-000006:gone", T(2010, 1, 1)),
        ("companies", "0000000003", None), ("others", "1", T(2020, 1, 1)), (None, None, None),
    ]
    return {
        "companies": spark.createDataFrame([(*r, "k") for r in companies], "cik string, fetched_at timestamp_ntz, key string"),
        "filings": spark.createDataFrame([(*r, "s") for r in filings], "accession string, cik string, fetched_at timestamp_ntz, state string"),
        "sections": spark.createDataFrame([(*r, 1) for r in sections], "section_id string, accession string, row_key int"),
        "chunks": spark.createDataFrame(chunks, "chunk_id string, section_id string"),
        "tombstones": spark.createDataFrame(tombstones, "entity string, entity_key string, removed_at timestamp_ntz"),
    }


def test_orphans(spark):
    got = {(r.table_name, r.row_key, r.state, r.period) for r in orphans.orphans(tables(spark)).collect()}
    assert got == {
        ("filings", "0000000009-20-000002", "deleted", 2020), ("filings", "0000000009-21-000005", "missing", 2021), ("filings", "0000000009-21-000006", "deleted", 2021), ("filings", "0000000009-99-000007", "missing", 1999),
        ("sections", "0000000009-30-000001:x", "missing", 2030), ("chunks", "c2", "missing", None), ("chunks", "c5", "deleted", None), ("chunks", None, "missing", None),
    }


def test_report_tells_late_ones(spark):
    t = tables(spark)
    late = spark.createDataFrame([("0000000004", T(2025, 1, 1), "")], "cik string, fetched_at timestamp_ntz, key string")
    t["companies"] = t["companies"].union(late)
    t["filings"] = t["filings"].union(spark.createDataFrame([("0000000009-22-000001", "4", T(2022, 1, 1), "")], "accession string, cik string, fetched_at timestamp_ntz, state string"))
    got = {tuple(r) for r in orphans.reference_report(t).collect()}
    assert ("filings", 2022, "late", 1) in got and ("filings", 2021, "missing", 1) in got
    assert sum(r[3] for r in got if r[2] != "late") == orphans.orphans(t).count()


def test_empty_tables(spark):
    t = tables(spark)
    for name in t:
        less = t | {name: t[name].limit(0)}
        orphans.orphans(less).collect()
    assert orphans.orphans({k: v.limit(0) for k, v in t.items()}).collect() == []
    none = t | {"sections": t["sections"].limit(0)}
    assert {r.row_key for r in orphans.orphans(none).filter("table_name = 'chunks'").collect()} == {"c1", "c2", "c5", None}


def test_plan_merges_sorted_keys(spark):
    t = tables(spark)
    plan = orphans.merged_keys(t["chunks"], t["sections"], t["tombstones"], orphans.REFERENCES[0])._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Python" not in plan and "CartesianProduct" not in plan
