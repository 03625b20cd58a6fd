"""Queries on references between the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ledgerloom.operators import orphans
from ledgerloom.sources.tables import table


def _tables(spark: SparkSession, root: str) -> dict[str, DataFrame]:
    return {t: table(spark, root, t) for t in ("chunks", "sections", "filings", "companies", "tombstones")}


def p6_found(spark: SparkSession, root: str) -> DataFrame:
    return orphans.orphans(_tables(spark, root)).select("table_name", "row_key").distinct()


def p6_report(spark: SparkSession, root: str) -> DataFrame:
    return orphans.reference_report(_tables(spark, root))


_D = "regexp_replace({0}, '[^0-9]', '', 'g')"
_STRIP = r"regexp_replace({0}, '^[\s\p{{Z}}]+|[\s\p{{Z}}]+$', '', 'g')"
_ACC = f"CASE WHEN length({_D}) = 18 THEN {_D} ELSE '?' || {_STRIP} END"
_CIK = f"coalesce(CAST(TRY_CAST({_D} AS BIGINT) AS VARCHAR), '?' || {_STRIP})"


def _acc(c: str) -> str:
    return _ACC.format(c)


def _sec(c: str) -> str:
    return f"({_acc(f'split_part({c}, chr(58), 1)')}) || ':' || lower({_STRIP.format(f'split_part({c}, chr(58), -1)')})"


_CTE = f"""
WITH parents AS (
  SELECT 'chunks' AS child, {_sec('section_id')} AS key, TRUE AS held, NULL::TIMESTAMP AS seen, NULL::TIMESTAMP AS removed FROM sections
  UNION ALL SELECT 'sections', {_acc('accession')}, TRUE, fetched_at, NULL FROM filings
  UNION ALL SELECT 'filings', {_CIK.format('cik')}, TRUE, fetched_at, NULL FROM companies
  UNION ALL SELECT 'chunks', {_sec('entity_key')}, FALSE, NULL, removed_at FROM tombstones WHERE entity = 'sections'
  UNION ALL SELECT 'sections', {_acc('entity_key')}, FALSE, NULL, removed_at FROM tombstones WHERE entity = 'filings'
  UNION ALL SELECT 'filings', {_CIK.format('entity_key')}, FALSE, NULL, removed_at FROM tombstones WHERE entity = 'companies'
), states AS (
  SELECT child, key, bool_or(held) AS held, min(seen) AS first_seen,
         CASE WHEN max(removed) IS NOT NULL AND (child = 'chunks' OR NOT coalesce(max(seen) > max(removed), FALSE)) THEN 'deleted'
              WHEN NOT bool_or(held) THEN 'missing' ELSE 'present' END AS state
  FROM parents GROUP BY child, key
), refs AS (
  SELECT 'chunks' AS table_name, chunk_id AS row_key, section_id AS ref, {_sec('section_id')} AS key, NULL::TIMESTAMP AS at FROM chunks
  UNION ALL SELECT 'sections', section_id, accession, {_acc('accession')}, NULL FROM sections
  UNION ALL SELECT 'filings', accession, cik, {_CIK.format('cik')}, fetched_at FROM filings
), judged AS (
  SELECT r.table_name, r.row_key, coalesce(s.state, 'missing') AS state,
         coalesce(s.state, 'missing') = 'present' AND coalesce(s.first_seen > r.at, FALSE) AS late
  FROM refs r LEFT JOIN states s ON s.child = r.table_name AND s.key = r.key
  WHERE r.ref IS NOT NULL AND length({_STRIP.format('r.ref')}) > 0
)"""

QUERIES = {"p6_found": p6_found, "p6_report": p6_report}
SQL = {
    "p6_found": _CTE + " SELECT DISTINCT table_name, row_key FROM judged WHERE state <> 'present'",
    "p6_report": _CTE
    + """, years AS (
  SELECT DISTINCT table_name, row_key, CASE WHEN late THEN 'late' ELSE state END AS state,
         TRY_CAST(substr(regexp_replace(split_part(row_key, ':', 1), '[^0-9]', '', 'g'), 11, 2) AS INTEGER) AS yy
  FROM judged WHERE late OR state <> 'present')
SELECT table_name, CAST(CASE WHEN yy >= 70 THEN yy + 1900 ELSE yy + 2000 END AS INTEGER) AS period, state, count(*) AS n_rows
FROM years GROUP BY ALL""",
}
