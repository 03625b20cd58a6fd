"""The chain from sections to stored extractions, signals and alerts, with its SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ledgerloom import tasks
from ledgerloom.agent.router import offline
from ledgerloom.functions import scalars
from ledgerloom.operators import signals
from ledgerloom.pipeline import Pipeline
from ledgerloom.plans.cut import shared_folder
from ledgerloom.queries import text_queries, views
from ledgerloom.queries.text_queries import _BLANK, _COUNT, _MODEL, _fit
from ledgerloom.queries.views import sql
from ledgerloom.schemas import BAD_WORDS, GOOD_WORDS
from ledgerloom.warehouse import Warehouse


def _warehouse(spark) -> Warehouse:
    """A new warehouse in the shared folder, removed when the driver ends."""
    path = f"{shared_folder(spark).rstrip('/')}/ledgerloom/warehouse-{uuid.uuid4().hex}"
    own = Warehouse.open(spark, path, buckets=8)
    own._fs.deleteOnExit(own._path(path))
    return own


def extract_persist(spark, root):
    """All tasks over all units, read by the heuristic, stored and read back."""
    w = _warehouse(spark)
    s, f, c = text_queries._model(spark, root)
    w.ingest_filing_rows(f.filter("cik IS NOT NULL").drop("key"), s.filter("text IS NOT NULL"), w.table("chunks"))
    w.upsert("companies", c)
    pipeline = Pipeline(w)
    for name, task in tasks.TASKS.items():
        pipeline.extract(name, offline(task.schema))
    payload = F.col("payload")
    return w.table("extractions").select(
        "task", "accession", "section_id", "valid", "repair_attempts", "grounded_ratio", F.get_json_object(payload, "$.direction").alias("direction"),
        F.size(F.from_json(F.get_json_object(payload, "$.evidence"), "array<string>")).alias("n_quotes"),
    )


_CHANGES = {"low": "none", "medium": "lowered", "high": "withdrawn"}
_FIELD = {"guidance_tone": "guidance_change", "risk_delta": "severity", "event_class": "materiality"}


def _stored(spark, root):
    """Extractions with payloads; those of every thirteenth filing are no longer valid."""
    level = F.when(F.col("task") == "guidance_tone", signals.lookup(_CHANGES, F.col("level"))).otherwise(F.col("level"))
    way = F.when(F.col("accession").cast("long") % 13 == 0, "sideways").otherwise(F.col("direction"))
    more = F.when(F.col("task") == "event_class", F.lit('"event_type":"An  Event!",')).otherwise("")
    payload = F.concat(
        F.lit('{"direction":"'), way, F.lit('","'), signals.lookup(_FIELD, F.col("task")), F.lit('":"'), level, F.lit('",'), more, F.lit('"confidence":'), F.col("confidence").cast("string"),
        F.lit(',"rationale":"because of '), F.col("extraction_id"), F.lit('","evidence":["a quote that is long enough"]}'),
    )
    return views.extractions(spark, root).withColumn("payload", payload).drop("direction", "level", "confidence")


def _scored(spark, root):
    return signals.score_stored(_stored(spark, root), views.filings(spark, root), views.companies(spark, root), tasks.SCORING)


def score_stored(spark, root):
    rows = _scored(spark, root)
    return rows.select("signal_id", "name", "cik", "ticker", "accession", "as_of", "score", scalars.round_half_away(F.col("confidence"), 9).alias("confidence"), "direction", "rationale", F.array_join("extraction_ids", ",").alias("extraction_ids"), F.array_join("evidence", "|").alias("evidence"))


def alerts_persist(spark, root):
    w = _warehouse(spark)
    w.upsert("alerts", signals.alerts(_scored(spark, root), tasks.RULES).drop("score"))
    return w.table("alerts").select("alert_id", "signal_id", "rule", "severity", "headline", "detail")


def _hits(words) -> str:
    return f"len(list_filter(fit, lambda s: regexp_matches(lower(s), '{'|'.join(words)}')))"


_UNITS = _MODEL + f""", r AS (SELECT * FROM j WHERE slug = 'risk_factors' AND form IN ('10-K', '10-Q')),
p AS (SELECT *, lag(text) OVER (PARTITION BY cik, form ORDER BY filing_date, accession, section_id) AS before FROM r),
t AS (SELECT accession, coalesce(string_agg(heading || chr(10) || text, chr(10) || chr(10) ORDER BY ordinal, section_id), '') AS body FROM j WHERE form = '8-K' GROUP BY accession, cik, name, items, filing_date),
u AS (SELECT 'guidance_tone' AS task, accession, section_id, {_fit('text', 8000)} AS d FROM j WHERE slug IN ('mdna', 'results_of_operations')
  UNION ALL SELECT 'risk_delta', accession, section_id, {_fit('text', 4800)} FROM p WHERE before IS NOT NULL
  UNION ALL SELECT 'event_class', accession, NULL, {_fit('body', 6000)} FROM t),
n AS (SELECT *, {_COUNT(GOOD_WORDS).replace('lower(text)', 'lower(d)')} AS g, {_COUNT(BAD_WORDS).replace('lower(text)', 'lower(d)')} AS b,
  list_filter(list_transform(string_split(regexp_replace(d, '([.!?]){_BLANK}+', '\\1' || chr(1), 'g'), chr(1)), lambda s: regexp_replace(s, '^{_BLANK}+|{_BLANK}+$', '', 'g')), lambda s: length(s) > 25 AND length(s) < 400) AS fit FROM u),
l AS (SELECT *, CASE WHEN g + b > 0 THEN sign(g - b) * floor(abs((g - b) / (g + b)::DOUBLE) * 1000::DOUBLE + 0.5::DOUBLE) / 1000::DOUBLE ELSE 0.0::DOUBLE END AS lean FROM n),
h AS (SELECT *, CASE WHEN lean < 0 THEN {_hits(BAD_WORDS)} ELSE {_hits(GOOD_WORDS)} END AS hits FROM l)
SELECT task, accession, section_id, TRUE AS valid, 0 AS repair_attempts, 1.0::DOUBLE AS grounded_ratio,
  CASE WHEN lean < -0.15 THEN 'bearish' WHEN lean > 0.15 THEN 'bullish' ELSE 'neutral' END AS direction, CAST(CASE WHEN hits > 0 THEN least(hits, 3) ELSE least(len(fit), 1) END AS INTEGER) AS n_quotes FROM h"""

_SCORED = f""", q AS (
  SELECT e.*, f.filing_date, f.report_date, c.ticker, greatest(0.0::DOUBLE, least(1.0::DOUBLE, CASE WHEN e.confidence > 1 AND e.confidence <= 100 THEN e.confidence / 100 ELSE e.confidence END)) AS conf,
    CASE direction WHEN 'bullish' THEN 1.0 WHEN 'bearish' THEN -1.0 ELSE 0.0 END::DOUBLE AS sgn FROM ext e JOIN fil f USING (accession) LEFT JOIN comp c ON c.cik = e.cik
  WHERE e.valid AND e.grounded_ratio >= 0.5 AND CAST(e.accession AS BIGINT) % 13 <> 0
), o AS (SELECT *, CASE task WHEN 'guidance_tone' THEN CASE level WHEN 'medium' THEN -1.0::DOUBLE WHEN 'high' THEN -0.85::DOUBLE ELSE sgn * 0.6::DOUBLE END
    WHEN 'risk_delta' THEN sgn * CASE level WHEN 'low' THEN 0.3::DOUBLE WHEN 'medium' THEN 0.65::DOUBLE ELSE 1.0::DOUBLE END ELSE sgn * CASE level WHEN 'low' THEN 0.25::DOUBLE WHEN 'medium' THEN 0.6::DOUBLE ELSE 1.0::DOUBLE END END AS pol FROM q
), z AS (SELECT *, greatest(-1.0::DOUBLE, least(1.0::DOUBLE, pol * (0.25::DOUBLE + 0.75::DOUBLE * conf))) AS x FROM o
), y AS (SELECT substr(sha256(task || '|' || cik || '|' || accession || '|score-v1'), 1, 24) AS signal_id, task AS name, cik, ticker, accession, coalesce(report_date, filing_date) AS as_of,
    sign(x) * floor(abs(x) * 10000::DOUBLE + 0.5::DOUBLE) / 10000::DOUBLE AS score, sign(conf) * floor(conf * 1e9::DOUBLE + 0.5::DOUBLE) / 1e9::DOUBLE AS confidence, 'because of ' || extraction_id AS rationale, extraction_id AS extraction_ids FROM z)"""

QUERIES = {f.__name__: f for f in (extract_persist, score_stored, alerts_persist)}
SQL = {
    "extract_persist": _UNITS,
    "score_stored": sql(_SCORED + " SELECT *, CASE WHEN score > 0.1 THEN 'bullish' WHEN score < -0.1 THEN 'bearish' ELSE 'neutral' END AS direction, 'a quote that is long enough' AS evidence FROM y"),
    "alerts_persist": sql(
        _SCORED
        + """, a AS (
    SELECT 'guidance_withdrawn_or_cut' AS rule, 'critical' AS severity, coalesce(ticker, cik) || ': forward guidance deteriorated' AS headline, * FROM y WHERE name = 'guidance_tone' AND score <= -0.5 AND confidence >= 0.6
    UNION ALL SELECT 'material_risk_escalation', 'warn', coalesce(ticker, cik) || ': risk disclosure escalated materially', * FROM y WHERE name = 'risk_delta' AND score <= -0.55 AND confidence >= 0.55
    UNION ALL SELECT 'high_materiality_event', CASE WHEN score < 0 THEN 'critical' ELSE 'warn' END, coalesce(ticker, cik) || ': material ' || CASE WHEN score > 0 THEN 'positive' ELSE 'negative' END || ' 8-K event', * FROM y WHERE name = 'event_class' AND abs(score) >= 0.6
    UNION ALL SELECT 'confident_positive', 'info', coalesce(ticker, cik) || ': positive disclosure signal (' || name || ')', * FROM y WHERE score >= 0.65 AND confidence >= 0.6)
  SELECT substr(sha256(rule || '|' || signal_id), 1, 24) AS alert_id, signal_id, rule, severity, headline, rationale AS detail FROM a"""
    ),
}
