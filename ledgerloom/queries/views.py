"""The star-schema tables seen as companies, filings, extractions, spans and graded outcomes, for the queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerloom.sources.tables import table

TASKS = ("guidance_tone", "risk_delta", "event_class")
LEVELS = {"low": 0.25, "medium": 0.6, "high": 1.0}
WEIGHTS = {"event_class": 0.45, "guidance_tone": 0.35, "risk_delta": 0.2}


def companies(spark: SparkSession, root: str) -> DataFrame:
    c, n = table(spark, root, "customer"), table(spark, root, "nation")
    return c.join(n, c.c_nationkey == n.n_nationkey, "left").select(
        F.lpad(F.col("c_custkey").cast("string"), 10, "0").alias("cik"), F.when(F.col("c_custkey") % 5 != 0, F.concat(F.lit("T"), F.col("c_custkey").cast("string"))).alias("ticker"),
        F.col("c_name").alias("name"), F.col("c_mktsegment").alias("sic"), F.col("n_name").alias("exchange"),
    )


def filings(spark: SparkSession, root: str) -> DataFrame:
    day = F.col("o_orderdate").cast("date")
    return table(spark, root, "orders").select(
        F.col("o_orderkey").cast("string").alias("accession"), F.lpad(F.col("o_custkey").cast("string"), 10, "0").alias("cik"),
        F.when(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH"), "8-K").when(F.col("o_orderpriority") == "3-MEDIUM", "10-K").otherwise("10-Q").alias("form"),
        day.alias("filing_date"), F.when(F.col("o_orderstatus") != "P", F.date_sub(day, 30)).alias("report_date"), F.lit(None).cast("string").alias("items"),
    )


def extractions(spark: SparkSession, root: str) -> DataFrame:
    """One extraction per filing and task."""
    task = F.element_at(F.array(*map(F.lit, TASKS)), (F.col("l_linenumber") % 3 + 1).cast("int"))
    level = F.element_at(F.array(*map(F.lit, LEVELS)), (F.col("l_quantity").cast("int") % 3 + 1).cast("int"))
    w = Window.partitionBy("l_orderkey", F.col("l_linenumber") % 3).orderBy(*[F.col(c).desc() for c in ("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")])
    rows = table(spark, root, "lineitem").withColumn("n", F.row_number().over(w)).filter("n = 1").select(
        F.col("l_orderkey").cast("string").alias("accession"), F.concat_ws(":", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")).alias("extraction_id"), task.alias("task"),
        F.when(F.col("l_returnflag") == "A", "bullish").when(F.col("l_returnflag") == "R", "bearish").otherwise("neutral").alias("direction"), level.alias("level"),
        (F.col("l_discount") * 10).alias("confidence"), (F.col("l_tax") / 0.08).alias("grounded_ratio"), (F.col("l_linestatus") == "O").alias("valid"),
    )
    return rows.join(filings(spark, root).select("accession", "cik"), "accession")


def spans(spark: SparkSession, root: str) -> DataFrame:
    e = table(spark, root, "events")
    return e.select(
        F.col("event_id").cast("string").alias("span_id"), F.col("user_id").cast("string").alias("trace_id"), F.when(F.col("event_id") % 4 != 0, F.col("user_id").cast("string")).alias("parent_id"),
        F.when(F.col("event_id") % 3 == 0, "tool").otherwise("llm").alias("kind"), F.when(F.col("event_id") % 17 == 0, "error").otherwise("ok").alias("status"),
        F.col("ts").cast("timestamp").alias("started_at"), F.col("value").alias("duration_ms"), F.col("event_type").alias("model"), F.concat(F.lit("p"), (F.col("user_id") % 2).cast("string")).alias("provider"),
        (F.col("event_id") % 900).alias("tokens_in"), (F.col("event_id") % 300).alias("tokens_out"), ((F.col("event_id") % 1000) / 1000.0).alias("cost_usd"), (F.col("event_id") % 5 == 0).alias("cached"),
    )


def outcomes(spark: SparkSession, root: str) -> DataFrame:
    """Graded outcomes, one per order line."""
    words = ("bullish", "bearish", "neutral")
    pick = lambda c: F.element_at(F.array(*map(F.lit, words)), (c % 3 + 1).cast("int"))
    li = table(spark, root, "lineitem")
    want, got, valid = pick(F.col("l_partkey")), pick(F.col("l_partkey") + F.when(F.col("l_suppkey") % 4 == 0, 1).otherwise(0)), F.col("l_quantity") > 3
    rows = li.select(
        F.concat_ws(":", *[F.col(c).cast("string") for c in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")]).alias("case_id"), F.concat(F.lit("m"), (F.col("l_suppkey") % 3).cast("string")).alias("model"),
        want.alias("want"), F.when(valid, got).alias("got"), (F.col("l_discount") * 10).alias("confidence"), (F.col("l_tax") / 0.08).alias("grounded_ratio"), valid.alias("valid"),
        (F.col("l_linenumber") % 3 - 1).alias("r"), F.col("l_extendedprice").alias("latency_ms"), (F.col("l_linenumber") / 1000.0).alias("cost_usd"),
    )
    hit = F.coalesce(F.col("want") == F.col("got"), F.lit(False))
    return rows.select(
        "case_id", "model", F.create_map(F.lit("direction"), "want").alias("expected"), F.when(F.col("got").isNotNull(), F.create_map(F.lit("direction"), "got")).alias("actual"),
        "confidence", "grounded_ratio", (F.col("grounded_ratio") < 0.3).alias("hallucinated"), "valid", F.greatest(F.lit(0), "r").alias("repair_attempts"), "latency_ms", "cost_usd",
        hit.alias("correct"), hit.alias("direction_correct"),
    )


SQL = """
comp AS (
  SELECT lpad(CAST(c_custkey AS VARCHAR), 10, '0') AS cik, CASE WHEN c_custkey % 5 <> 0 THEN 'T' || CAST(c_custkey AS VARCHAR) END AS ticker,
         c_name AS name, c_mktsegment AS sic, n_name AS exchange FROM customer LEFT JOIN nation ON n_nationkey = c_nationkey
), fil AS (
  SELECT CAST(o_orderkey AS VARCHAR) AS accession, lpad(CAST(o_custkey AS VARCHAR), 10, '0') AS cik,
         CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN '8-K' WHEN o_orderpriority = '3-MEDIUM' THEN '10-K' ELSE '10-Q' END AS form,
         CAST(o_orderdate AS DATE) AS filing_date, CASE WHEN o_orderstatus <> 'P' THEN CAST(o_orderdate AS DATE) - 30 END AS report_date FROM orders
), ext AS (
  SELECT e.*, fil.cik FROM (
    SELECT CAST(l_orderkey AS VARCHAR) AS accession, l_orderkey || ':' || l_linenumber AS extraction_id,
           list_extract(['guidance_tone', 'risk_delta', 'event_class'], CAST(l_linenumber % 3 + 1 AS INTEGER)) AS task,
           CASE l_returnflag WHEN 'A' THEN 'bullish' WHEN 'R' THEN 'bearish' ELSE 'neutral' END AS direction,
           list_extract(['low', 'medium', 'high'], CAST(CAST(floor(l_quantity) AS INTEGER) % 3 + 1 AS INTEGER)) AS level,
           l_discount * 10 AS confidence, l_tax / CAST(0.08 AS DOUBLE) AS grounded_ratio, l_linestatus = 'O' AS valid
    FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber % 3 ORDER BY l_linenumber DESC, l_partkey DESC, l_suppkey DESC, l_quantity DESC, l_extendedprice DESC) = 1
  ) e JOIN fil USING (accession)
), pol AS (
  SELECT *, CASE direction WHEN 'bullish' THEN 1.0 WHEN 'bearish' THEN -1.0 ELSE 0.0 END::DOUBLE * CASE level WHEN 'low' THEN 0.25 WHEN 'medium' THEN 0.6 ELSE 1.0 END::DOUBLE AS polarity FROM ext
), raw AS (
  SELECT p.*, f.filing_date, f.report_date, c.ticker, greatest(-1.0::DOUBLE, least(1.0::DOUBLE, p.polarity * (0.25::DOUBLE + 0.75::DOUBLE * p.confidence))) AS x
  FROM pol p JOIN fil f USING (accession) LEFT JOIN comp c ON c.cik = p.cik WHERE p.valid AND p.grounded_ratio >= 0.5
), sig AS (
  SELECT substr(sha256(task || '|' || cik || '|' || accession || '|v1'), 1, 24) AS signal_id, task AS name, cik, ticker, accession, coalesce(report_date, filing_date) AS as_of,
         sign(x) * floor(abs(x) * 10000::DOUBLE + 0.5::DOUBLE) / 10000::DOUBLE AS score, confidence FROM raw
), signals AS (
  SELECT *, CASE WHEN score > 0.1 THEN 'bullish' WHEN score < -0.1 THEN 'bearish' ELSE 'neutral' END AS direction FROM sig
), spans AS (
  SELECT CAST(event_id AS VARCHAR) AS span_id, CAST(user_id AS VARCHAR) AS trace_id, CASE WHEN event_id % 4 <> 0 THEN CAST(user_id AS VARCHAR) END AS parent_id,
         CASE WHEN event_id % 3 = 0 THEN 'tool' ELSE 'llm' END AS kind, CASE WHEN event_id % 17 = 0 THEN 'error' ELSE 'ok' END AS status, ts AS started_at, value AS duration_ms,
         event_type AS model, 'p' || CAST(user_id % 2 AS VARCHAR) AS provider, event_id % 900 AS tokens_in, event_id % 300 AS tokens_out, (event_id % 1000) / 1000.0::DOUBLE AS cost_usd, event_id % 5 = 0 AS cached
  FROM events
), outc AS (
  SELECT l_orderkey || ':' || l_linenumber || ':' || l_partkey || ':' || l_suppkey AS case_id, 'm' || CAST(l_suppkey % 3 AS VARCHAR) AS model,
         list_extract(['bullish', 'bearish', 'neutral'], CAST(l_partkey % 3 + 1 AS INTEGER)) AS want,
         CASE WHEN l_quantity > 3 THEN list_extract(['bullish', 'bearish', 'neutral'], CAST((l_partkey + CASE WHEN l_suppkey % 4 = 0 THEN 1 ELSE 0 END) % 3 + 1 AS INTEGER)) END AS got,
         l_discount * 10 AS confidence, l_tax / CAST(0.08 AS DOUBLE) AS grounded_ratio, l_quantity > 3 AS valid, greatest(0, l_linenumber % 3 - 1) AS repair_attempts,
         l_extendedprice AS latency_ms, l_linenumber / 1000.0::DOUBLE AS cost_usd FROM lineitem
), outcomes AS (
  SELECT *, coalesce(want = got, FALSE) AS correct, grounded_ratio < 0.3 AS hallucinated FROM outc
)
"""


def sql(body: str) -> str:
    """A body, which may begin with more common tables, behind the views."""
    return f"WITH {SQL} {body}"
