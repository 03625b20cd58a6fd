"""Signals, alerts, composites, reviews and listings, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom import service, tasks
from ledgerloom.operators import extraction, signals
from ledgerloom.queries import views
from ledgerloom.queries.views import sql

RULES, PRIORITIES = tasks.RULES, tasks.PRIORITIES


def _signals(spark: SparkSession, root: str) -> DataFrame:
    sign = signals.lookup({"bullish": 1.0, "bearish": -1.0, "neutral": 0.0}, F.col("direction"))
    return signals.scored(views.extractions(spark, root), views.filings(spark, root), views.companies(spark, root), sign * signals.lookup(views.LEVELS, F.col("level")))


def signals_scored(spark, root):
    return _signals(spark, root).drop("confidence")


def signals_composite(spark, root):
    return signals.composite(_signals(spark, root), views.WEIGHTS)


def signals_list(spark, root):
    return signals.listed(_signals(spark, root), views.companies(spark, root), least=0.3, limit=50).select("signal_id", "name", "cik", "ticker", "as_of", "score", "direction", "company")


def signals_for_ticker(spark, root):
    return signals.listed(_signals(spark, root), views.companies(spark, root), ticker="t7", limit=50).select("signal_id", "name", "as_of", "score")


def signals_lowest(spark, root):
    return _signals(spark, root).orderBy("score", "signal_id").limit(20).select("signal_id", "score")


def alerts_rules(spark, root):
    return signals.alerts(_signals(spark, root), RULES).drop("score", "detail")


def alerts_list(spark, root):
    s = _signals(spark, root)
    rows = service.alerts_view(signals.alerts(s, RULES), s, views.companies(spark, root))
    return rows.orderBy(signals.severity_rank(F.col("severity")), "alert_id").limit(50).select("alert_id", "rule", "severity", "name", "ticker", "company")


def alerts_by_strength(spark, root):
    rows = signals.alerts(_signals(spark, root), RULES)
    return rows.orderBy(signals.severity_rank(F.col("severity")), -F.abs("score"), "alert_id").limit(40).select("alert_id", "severity", "score")


def companies_overview(spark, root):
    return signals.companies_overview(views.companies(spark, root), views.filings(spark, root), 200)


def review_queue_open(spark, root):
    rows = extraction.review_queue(views.extractions(spark, root), PRIORITIES).filter("status = 'open'")
    return rows.orderBy(F.col("priority").desc(), "review_id").limit(60)


def review_reasons(spark, root):
    return extraction.review_queue(views.extractions(spark, root), PRIORITIES).groupBy("task", "reason").agg(F.count(F.lit(1)).alias("n"))


def table_counts(spark, root):
    from ledgerloom.sources.tables import table

    return service.table_counts({n: table(spark, root, n) for n in ("companies", "filings", "sections", "chunks", "documents", "tombstones")})


_ALERTS = """, alerts AS (
  SELECT substr(sha256(rule || '|' || signal_id), 1, 24) AS alert_id, * FROM (
    SELECT 'guidance_withdrawn_or_cut' AS rule, 'critical' AS severity, coalesce(ticker, cik) || ': forward guidance deteriorated' AS headline, * FROM signals WHERE name = 'guidance_tone' AND score <= -0.5 AND confidence >= 0.6
    UNION ALL SELECT 'material_risk_escalation', 'warn', coalesce(ticker, cik) || ': risk disclosure escalated materially', * FROM signals WHERE name = 'risk_delta' AND score <= -0.55 AND confidence >= 0.55
    UNION ALL SELECT 'high_materiality_event', CASE WHEN score < 0 THEN 'critical' ELSE 'warn' END, coalesce(ticker, cik) || ': material ' || CASE WHEN score > 0 THEN 'positive' ELSE 'negative' END || ' 8-K event', * FROM signals WHERE name = 'event_class' AND abs(score) >= 0.6
    UNION ALL SELECT 'confident_positive', 'info', coalesce(ticker, cik) || ': positive disclosure signal (' || name || ')', * FROM signals WHERE score >= 0.65 AND confidence >= 0.6))"""
_RANK = "CASE severity WHEN 'critical' THEN 0 WHEN 'warn' THEN 1 WHEN 'info' THEN 2 ELSE 3 END"
_REVIEW = """, review AS (
  SELECT task || ':' || extraction_id AS review_id, extraction_id, task,
         CASE WHEN NOT valid THEN 'invalid' WHEN coalesce(grounded_ratio, 0) < 1 THEN 'ungrounded' WHEN confidence < CAST(0.45 AS DOUBLE) THEN 'low_confidence' END AS reason FROM ext)"""

QUERIES = {
    f.__name__: f
    for f in (
        signals_scored, signals_composite, signals_list, signals_for_ticker, signals_lowest, alerts_rules, alerts_list, alerts_by_strength, companies_overview, review_queue_open, review_reasons, table_counts,
    )
}
SQL = {
    "signals_scored": sql("SELECT signal_id, name, cik, ticker, accession, as_of, score, direction FROM signals"),
    "signals_composite": sql(
        """, last AS (SELECT cik, name, score FROM signals QUALIFY row_number() OVER (PARTITION BY cik, name ORDER BY as_of DESC, accession DESC, signal_id DESC) = 1),
        w AS (SELECT cik, CAST(score AS DECIMAL(12,6)) AS score, CAST(CASE name WHEN 'event_class' THEN 0.45 WHEN 'guidance_tone' THEN 0.35 ELSE 0.2 END AS DECIMAL(6,3)) AS weight FROM last),
        s AS (SELECT cik, CAST(sum(score * weight) AS DOUBLE) / CAST(sum(weight) AS DOUBLE) AS x, CAST(sum(weight) AS DOUBLE) AS k, count(*) AS n_names FROM w GROUP BY cik)
        SELECT cik, sign(x) * floor(abs(x) * 10000::DOUBLE + 0.5::DOUBLE) / 10000::DOUBLE AS score, floor(k * 1000::DOUBLE + 0.5::DOUBLE) / 1000::DOUBLE AS coverage, n_names FROM s"""
    ),
    "signals_list": sql(
        "SELECT signal_id, s.name, s.cik, coalesce(s.ticker, c.ticker) AS ticker, as_of, score, direction, c.name AS company FROM signals s LEFT JOIN comp c ON c.cik = s.cik WHERE abs(score) >= 0.3 ORDER BY as_of DESC, abs(score) DESC, signal_id LIMIT 50"
    ),
    "signals_for_ticker": sql("SELECT signal_id, name, as_of, score FROM signals WHERE upper(ticker) = 'T7' ORDER BY as_of DESC, abs(score) DESC, signal_id LIMIT 50"),
    "signals_lowest": sql("SELECT signal_id, score FROM signals ORDER BY score, signal_id LIMIT 20"),
    "alerts_rules": sql(_ALERTS + " SELECT alert_id, signal_id, rule, severity, headline FROM alerts"),
    "alerts_list": sql(_ALERTS + f" SELECT alert_id, rule, severity, a.name, coalesce(a.ticker, c.ticker) AS ticker, c.name AS company FROM alerts a LEFT JOIN comp c ON c.cik = a.cik ORDER BY {_RANK}, alert_id LIMIT 50"),
    "alerts_by_strength": sql(_ALERTS + f" SELECT alert_id, severity, score FROM alerts ORDER BY {_RANK}, -abs(score), alert_id LIMIT 40"),
    "companies_overview": sql(
        "SELECT c.cik, c.name, c.ticker, count(f.accession) AS n_filings, max(f.filing_date) AS last_filing FROM comp c LEFT JOIN fil f ON f.cik = c.cik GROUP BY 1, 2, 3 ORDER BY n_filings DESC, c.cik LIMIT 200"
    ),
    "review_queue_open": sql(
        _REVIEW + " SELECT review_id, extraction_id, task, reason, CAST(CASE reason WHEN 'invalid' THEN 9 WHEN 'ungrounded' THEN 7 ELSE 3 END AS INTEGER) AS priority, 'open' AS status FROM review WHERE reason IS NOT NULL ORDER BY priority DESC, review_id LIMIT 60"
    ),
    "review_reasons": sql(_REVIEW + " SELECT task, reason, count(*) AS n FROM review WHERE reason IS NOT NULL GROUP BY task, reason"),
    "table_counts": " UNION ALL ".join(f"SELECT '{t}' AS table_name, count(*) AS n_rows FROM {t}" for t in ("companies", "filings", "sections", "chunks", "documents", "tombstones")),
}
