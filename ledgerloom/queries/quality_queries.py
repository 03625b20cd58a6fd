"""Evaluation, costs, warehouse writes and open SQL, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerloom import warehouse
from ledgerloom.agent import sqltool
from ledgerloom.operators import evaluation, extraction, observability
from ledgerloom.functions.scalars import clamped_confidence, round_half_away
from ledgerloom.queries import views
from ledgerloom.queries.views import sql
from ledgerloom.sources.tables import table


def _rounded(df, places=6):
    return df.select(*[round_half_away(F.col(c), places).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def eval_summary(spark, root):
    return _rounded(evaluation.summary(views.outcomes(spark, root)).drop("macro_f1", "ece", "brier", "mean_confidence", "overconfidence", "confusion"), 4)


def eval_summary_by_model(spark, root):
    """The calibration, F1 and confusion of the full summary, by model."""
    s = evaluation.summary(views.outcomes(spark, root), ("model",))
    return _rounded(s.select("model", "macro_f1", "ece", "brier", "mean_confidence", "overconfidence", "confusion"), 4)


def bakeoff(spark, root):
    s = evaluation.summary(views.outcomes(spark, root), ("model",)).select("model", "n", "accuracy", "hallucination_rate", "latency_p95")
    return _rounded(evaluation.compared(s, "model"), 4)


def macro_f1(spark, root):
    return evaluation.macro_f1(views.outcomes(spark, root), "direction")


def confusion(spark, root):
    return evaluation.confusion(views.outcomes(spark, root), "direction")


def calibration(spark, root):
    return evaluation.calibration(views.outcomes(spark, root))


def gate(spark, root):
    s = evaluation.summary(views.outcomes(spark, root)).select(F.lit("direction").alias("task"), "accuracy", "hallucination_rate", "schema_violation_rate")
    limits = spark.createDataFrame(
        [("direction", "accuracy", ">=", 0.4), ("direction", "hallucination_rate", "<=", 0.05), ("direction", "schema_violation_rate", "<=", 0.5), ("direction", "nothing", "<=", 1.0)],
        "task string, metric string, op string, threshold double",
    )
    return evaluation.gate(evaluation.unpivoted(s, ["task"]), limits).select("metric", "passed", "message")


def recommend(spark, root):
    s = evaluation.summary(views.outcomes(spark, root), ("model",))
    return evaluation.recommended(s, {"accuracy": (">=", 0.5), "hallucination_rate": ("<=", 0.9)}, ("cost_usd", "latency_p95")).select("model", F.size("reasons").alias("n_reasons"), "chosen")


def failing_cases(spark, root):
    return evaluation.failing(views.outcomes(spark, root)).select("case_id", "valid")


def served_models(spark, root):
    return evaluation.served_models(views.outcomes(spark, root))


def cost_metrics(spark, root):
    t = views.spans(spark, root)
    now = F.lit("2024-01-31 00:00:00").cast("timestamp")
    return observability.cost_metrics(t, now, 20)


def cost_totals(spark, root):
    return observability.totals(cost_metrics(spark, root))


def tracer_summary(spark, root):
    return observability.trace_summary(views.spans(spark, root))


def cost_cap_prefix(spark, root):
    return observability.within_budget(views.spans(spark, root).withColumn("id", F.col("span_id").cast("long")), 7.5, "trace_id", "id").select("span_id")


def daily_costs(spark, root):
    return observability.daily(views.spans(spark, root)).select(F.col("day").cast("date").alias("day"), "model", "calls", round_half_away(F.col("cost_usd"), 6).alias("cost_usd"))


def confidence_clamp(spark, root):
    """Values as they are, and none for every eleventh."""
    return table(spark, root, "events").select("event_id", clamped_confidence(F.when(F.col("event_id") % 11 != 0, F.col("value") - 1)).alias("confidence"))


def upsert_merge(spark, root):
    """Names of a third of the companies anew, and some companies more; other columns stay."""
    old = table(spark, root, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"))
    new = table(spark, root, "supplier").select((F.col("s_suppkey") * 30).alias("id"), F.col("s_name").alias("name"))
    return warehouse.upserted(old, new, ("id",))


def replace_children(spark, root):
    li = table(spark, root, "lineitem").select(F.col("l_orderkey").alias("accession"), F.col("l_linenumber").alias("n"), F.col("l_partkey").alias("v")).distinct()
    parents = table(spark, root, "orders").filter("o_orderkey % 3 = 0").select(F.col("o_orderkey").alias("accession"))
    fresh = parents.select("accession", F.lit(1).cast("int").alias("n"), F.lit(-1).cast("bigint").alias("v"))
    return warehouse.replaced(li, fresh, parents, "accession")


def _cache(spark, root):
    e = table(spark, root, "events")
    cache = e.filter("event_id % 6 = 0").groupBy(F.concat(F.lit("k"), (F.col("event_id") % 400).cast("string")).alias("key")).agg(F.lit("{}").alias("response"), F.lit(0).cast("bigint").alias("hits"))
    return e.select(F.concat(F.lit("k"), (F.col("event_id") % 700).cast("string")).alias("key"), "event_id"), cache


def cache_probe(spark, root):
    hits, misses = extraction.cache_probe(*_cache(spark, root))
    return hits.select("key", F.lit("hit").alias("what")).distinct().unionByName(misses.select("key", F.lit("miss").alias("what")))


def cache_stats(spark, root):
    requests, cache = _cache(spark, root)
    hits, _ = extraction.cache_probe(requests, cache)
    return extraction.cache_stats(extraction.cache_after(cache, hits, cache.limit(0)))


_OPEN = "SELECT form, count(*) AS n FROM filings WHERE filing_date IS NOT NULL GROUP BY form UNION ALL SELECT 'sections', count(*) FROM sections"
_SETS = "WITH a AS (SELECT DISTINCT accession FROM filings), b AS (SELECT DISTINCT accession FROM sections) SELECT 'both' AS which, count(*) AS n FROM (SELECT * FROM a INTERSECT SELECT * FROM b) x UNION ALL SELECT 'without', count(*) FROM (SELECT * FROM a EXCEPT SELECT * FROM b) y"


def _open(spark, root, text):
    for name in ("companies", "filings", "sections", "chunks"):
        table(spark, root, name).createOrReplaceTempView(name)
    return sqltool.sql_query(spark, text)


def sql_tool_query(spark, root):
    return _open(spark, root, _OPEN)


def sql_tool_sets(spark, root):
    return _open(spark, root, _SETS)


def slug_counts(spark, root):
    return table(spark, root, "sections").groupBy("slug").agg(F.count(F.lit(1)).alias("n"))


def filings_per_company_form(spark, root):
    return table(spark, root, "filings").groupBy("cik", "form").agg(F.count(F.lit(1)).alias("n"), F.min("filing_date").alias("first"), F.max("filing_date").alias("last"))


def filings_zip_explode(spark, root):
    """Parallel arrays, made of each company's filings, back to rows."""
    from ledgerloom.sources.filings import filings_of

    f = table(spark, root, "filings").filter(F.col("cik").rlike("^[0-9]{10}$")).distinct()
    item = F.struct("accession", "form", F.col("filing_date").cast("string").alias("d"), F.coalesce(F.col("report_date").cast("string"), F.lit("")).alias("r"), F.coalesce("items", F.lit("")).alias("i"), "primary_doc", "size_bytes", "fetched_at")
    per = f.groupBy("cik").agg(F.array_sort(F.collect_list(item)).alias("x"))
    names = {"accessionNumber": "accession", "form": "form", "filingDate": "d", "reportDate": "r", "items": "i", "primaryDocument": "primary_doc", "size": "size_bytes"}
    documents = per.select("cik", F.struct(F.struct(*[F.col("x")[c].alias(n) for n, c in names.items()]).alias("recent")).alias("filings"))
    return filings_of(documents, "https://filings.example", since="2016-01-01").drop("pos", "url")


def _r(x: str, p: int) -> str:
    return f"sign({x}) * floor(abs({x}) * {10**p}::DOUBLE + 0.5::DOUBLE) / {10**p}::DOUBLE"


_COST = """, llm AS (SELECT * FROM spans WHERE kind = 'llm' AND started_at > TIMESTAMP '2024-01-31 00:00:00' - INTERVAL 20 DAY),
costs AS (SELECT model, provider, count(*) AS calls, CAST(sum(CASE WHEN cached THEN 1 ELSE 0 END) AS BIGINT) AS cached, CAST(sum(tokens_in) AS BIGINT) AS tokens_in, CAST(sum(tokens_out) AS BIGINT) AS tokens_out,
  CAST(sum(CAST(cost_usd AS DECIMAL(20,8))) AS DOUBLE) AS c, CAST(sum(CAST(duration_ms AS DECIMAL(20,6))) AS DOUBLE) / count(duration_ms) AS a, quantile_cont(duration_ms, 0.95) AS p, CAST(sum(CASE WHEN status = 'error' THEN 1 ELSE 0 END) AS BIGINT) AS errors FROM llm GROUP BY ALL)"""

QUERIES = {
    f.__name__: f
    for f in (
        eval_summary, eval_summary_by_model, bakeoff, macro_f1, confusion, calibration, gate, recommend, failing_cases, served_models, cost_metrics, cost_totals, tracer_summary, cost_cap_prefix, daily_costs, confidence_clamp,
        upsert_merge, replace_children, cache_probe, cache_stats, sql_tool_query, sql_tool_sets, slug_counts, filings_per_company_form, filings_zip_explode,
    )
}
SQL = {
    "eval_summary": sql(
        f"""SELECT count(*) AS n, count(*) FILTER (valid) AS n_valid, {_r('avg(correct::INT)', 4)} AS accuracy, {_r('avg(correct::INT)', 4)} AS direction_accuracy, {_r('avg((NOT valid)::INT)', 4)} AS schema_violation_rate,
        {_r('avg((repair_attempts > 0)::INT)', 4)} AS repair_rate, {_r('avg(repair_attempts)', 4)} AS mean_repairs, {_r('avg(hallucinated::INT) FILTER (valid)', 4)} AS hallucination_rate, {_r('avg(grounded_ratio) FILTER (valid)', 4)} AS mean_grounded_ratio,
        {_r('quantile_cont(latency_ms, 0.5) FILTER (valid)', 4)} AS latency_p50, {_r('quantile_cont(latency_ms, 0.95) FILTER (valid)', 4)} AS latency_p95, {_r('CAST(sum(CAST(cost_usd AS DECIMAL(18,6))) AS DOUBLE)', 4)} AS cost_usd,
        {_r('(CAST(sum(CAST(cost_usd AS DECIMAL(18,6))) AS DOUBLE) / count(*) * 1000)', 4)} AS cost_per_1k, 0::BIGINT AS total_tokens FROM outcomes"""
    ),
    "eval_summary_by_model": sql(
        f""", l AS (SELECT DISTINCT model, want AS label FROM outcomes),
        p AS (SELECT model, label, count(*) FILTER (want = label AND got = label) AS tp, count(*) FILTER (got = label AND want <> label) AS fp, count(*) FILTER (want = label AND (got IS NULL OR got <> label)) AS fn FROM l JOIN outcomes USING (model) GROUP BY ALL),
        m AS (SELECT model, avg(CASE WHEN tp > 0 THEN 2.0::DOUBLE * tp / (2 * tp + fp + fn) ELSE 0.0 END) AS f FROM p GROUP BY model),
        pool AS (SELECT model, confidence, correct::INT::DOUBLE AS hit, least(CAST(floor(confidence * 10) AS INTEGER), 9) AS bin FROM outcomes WHERE valid AND confidence IS NOT NULL),
        b AS (SELECT model, bin, count(*) AS n, CAST(sum(CAST(confidence AS DECIMAL(18,9))) AS DOUBLE) AS conf, sum(hit) AS hits, CAST(sum(CAST(pow(confidence - hit, 2) AS DECIMAL(18,9))) AS DOUBLE) AS sq FROM pool GROUP BY ALL),
        t AS (SELECT model, sum(abs(conf - hits)) / sum(n) AS e, sum(sq) / sum(n) AS s, sum(conf) / sum(n) AS c, sum(hits) / sum(n) AS a FROM b GROUP BY model), u AS (SELECT *, {_r('c', 4)} AS mc FROM t),
        x AS (SELECT model, want, coalesce(got, 'INVALID') AS got, count(*) AS n FROM outcomes GROUP BY ALL),
        y AS (SELECT model, want, '"' || want || '":{{' || string_agg('"' || got || '":' || n, ',' ORDER BY got) || '}}' AS j FROM x GROUP BY model, want), z AS (SELECT model, '{{' || string_agg(j, ',' ORDER BY want) || '}}' AS confusion FROM y GROUP BY model)
        SELECT model, {_r(_r('f', 6), 4)} AS macro_f1, {_r(_r('e', 6), 4)} AS ece, {_r(_r('s', 6), 4)} AS brier, {_r('mc', 4)} AS mean_confidence, {_r(_r('(mc - a)', 6), 4)} AS overconfidence, confusion FROM m JOIN u USING (model) JOIN z USING (model)"""
    ),
    "bakeoff": sql(
        f"""SELECT model, n, {_r('a', 4)} AS accuracy, {_r('h', 4)} AS hallucination_rate, {_r('p', 4)} AS latency_p95, a = max(a) OVER () AS is_best
        FROM (SELECT model, count(*) AS n, avg(correct::INT) AS a, avg(hallucinated::INT) FILTER (valid) AS h, quantile_cont(latency_ms, 0.95) FILTER (valid) AS p FROM outcomes GROUP BY model)"""
    ),
    "macro_f1": sql(
        f""", l AS (SELECT DISTINCT want AS label FROM outcomes),
        p AS (SELECT label, count(*) FILTER (want = label AND got = label) AS tp, count(*) FILTER (got = label AND want <> label) AS fp, count(*) FILTER (want = label AND (got IS NULL OR got <> label)) AS fn FROM l, outcomes GROUP BY label),
        m AS (SELECT avg(CASE WHEN tp > 0 THEN 2.0::DOUBLE * tp / (2 * tp + fp + fn) ELSE 0.0 END) AS x FROM p) SELECT {_r('x', 6)} AS macro_f1 FROM m"""
    ),
    "confusion": sql("SELECT want AS expected, coalesce(got, 'INVALID') AS actual, count(*) AS n FROM outcomes GROUP BY 1, 2"),
    "calibration": sql(
        f""", pool AS (SELECT confidence, correct::INT::DOUBLE AS hit, least(CAST(floor(confidence * 10) AS INTEGER), 9) AS bin FROM outcomes WHERE valid AND confidence IS NOT NULL),
        b AS (SELECT bin, count(*) AS n, CAST(sum(CAST(confidence AS DECIMAL(18,9))) AS DOUBLE) AS conf, sum(hit) AS hits, CAST(sum(CAST(pow(confidence - hit, 2) AS DECIMAL(18,9))) AS DOUBLE) AS sq FROM pool GROUP BY bin),
        t AS (SELECT sum(abs(conf - hits)) / sum(n) AS e, sum(sq) / sum(n) AS s, sum(conf) / sum(n) AS c, sum(hits) / sum(n) AS a FROM b), u AS (SELECT *, {_r('c', 4)} AS mc FROM t)
        SELECT {_r('e', 6)} AS ece, {_r('s', 6)} AS brier, mc AS mean_confidence, {_r('(mc - a)', 6)} AS overconfidence FROM u"""
    ),
    "gate": sql(
        """, m AS (SELECT avg(correct::INT) AS a, avg(hallucinated::INT) FILTER (valid) AS h, avg((NOT valid)::INT) AS v FROM outcomes),
        r AS (SELECT 'accuracy' AS metric, a AS x, '>=' AS op, 0.4 AS t, a >= 0.4 AS passed FROM m UNION ALL SELECT 'hallucination_rate', h, '<=', 0.05, h <= 0.05 FROM m UNION ALL SELECT 'schema_violation_rate', v, '<=', 0.5, v <= 0.5 FROM m UNION ALL SELECT 'nothing', NULL, '<=', 1.0, FALSE FROM m)
        SELECT metric, passed, metric || '=' || coalesce(printf('%.3f', CAST(x AS DOUBLE)), 'absent') || ' ' || op || ' ' || printf('%.3f', CAST(t AS DOUBLE)) || ' -> ' || CASE WHEN passed THEN 'PASS' ELSE 'FAIL' END AS message FROM r"""
    ),
    "recommend": sql(
        """, s AS (SELECT model, avg(correct::INT) AS a, avg(hallucinated::INT) FILTER (valid) AS h, CAST(sum(CAST(cost_usd AS DECIMAL(18,6))) AS DOUBLE) AS c, quantile_cont(latency_ms, 0.95) FILTER (valid) AS p FROM outcomes GROUP BY model),
        k AS (SELECT *, CAST((a < 0.5)::INT + (coalesce(h, 0) > 0.9)::INT AS INTEGER) AS n_reasons FROM s), b AS (SELECT arg_min(model, (c, p, model)) AS best FROM k WHERE n_reasons = 0)
        SELECT model, n_reasons, coalesce(model = best, FALSE) AS chosen FROM k, b"""
    ),
    "failing_cases": sql("SELECT case_id, valid FROM outcomes WHERE NOT correct ORDER BY case_id LIMIT 8"),
    "served_models": sql("SELECT array_to_string(list_sort(list_distinct(list(model))), '+') AS models FROM outcomes"),
    "cost_metrics": sql(_COST + f" SELECT model, provider, calls, cached, tokens_in, tokens_out, {_r('c', 6)} AS cost_usd, {_r('a', 1)} AS avg_ms, {_r('p', 4)} AS p95_ms, errors FROM costs"),
    "cost_totals": sql(_COST + f", t AS (SELECT CAST(sum(CAST({_r('c', 6)} AS DECIMAL(20,8))) AS DOUBLE) AS c, CAST(sum(calls) AS BIGINT) AS calls, sum(cached) / sum(calls)::DOUBLE AS h FROM costs) SELECT {_r('c', 6)} AS total_cost, calls, {_r('h', 3)} AS hit_rate FROM t"),
    "tracer_summary": sql(
        f""", t AS (SELECT count(*) AS spans, count(*) FILTER (kind = 'llm') AS llm_calls, count(*) FILTER (kind = 'llm' AND cached) AS cache_hits, count(*) FILTER (status = 'error') AS errors, CAST(sum(tokens_in) + sum(tokens_out) AS BIGINT) AS tokens,
        CAST(sum(CAST(cost_usd AS DECIMAL(20,8))) AS DOUBLE) AS c, CAST(sum(CAST(duration_ms AS DECIMAL(20,6))) FILTER (parent_id IS NULL) AS DOUBLE) AS w FROM spans)
        SELECT spans, llm_calls, cache_hits, errors, tokens, {_r('c', 6)} AS cost_usd, {_r('w', 1)} AS wall_ms FROM t"""
    ),
    "cost_cap_prefix": sql("SELECT span_id FROM (SELECT span_id, sum(CAST(cost_usd AS DECIMAL(20,8))) OVER (PARTITION BY trace_id ORDER BY CAST(span_id AS BIGINT) ROWS UNBOUNDED PRECEDING) AS r FROM spans) WHERE r <= 7.5"),
    "daily_costs": sql(f", d AS (SELECT CAST(started_at AS DATE) AS day, model, count(*) AS calls, CAST(sum(CAST(cost_usd AS DECIMAL(20,8))) AS DOUBLE) AS c FROM spans GROUP BY 1, 2) SELECT day, model, calls, {_r('c', 6)} AS cost_usd FROM d"),
    "confidence_clamp": "WITH e AS (SELECT event_id, value - 1 AS v FROM events) SELECT event_id, CASE WHEN event_id % 11 <> 0 THEN greatest(0.0, least(1.0, CASE WHEN v > 1 AND v <= 100 THEN v / 100 ELSE v END)) END AS confidence FROM e",
    "upsert_merge": "SELECT coalesce(n.id, o.c_custkey) AS id, coalesce(n.name, o.c_name) AS name, o.c_mktsegment AS segment FROM customer o FULL JOIN (SELECT s_suppkey * 30 AS id, s_name AS name FROM supplier) n ON n.id = o.c_custkey",
    "replace_children": "SELECT DISTINCT l_orderkey AS accession, l_linenumber AS n, l_partkey AS v FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderkey % 3 = 0) UNION ALL SELECT o_orderkey, 1, -1 FROM orders WHERE o_orderkey % 3 = 0",
    "cache_probe": "WITH c AS (SELECT DISTINCT 'k' || (event_id % 400) AS key FROM events WHERE event_id % 6 = 0), r AS (SELECT DISTINCT 'k' || (event_id % 700) AS key FROM events) SELECT r.key, CASE WHEN c.key IS NULL THEN 'miss' ELSE 'hit' END AS what FROM r LEFT JOIN c USING (key)",
    "cache_stats": "WITH c AS (SELECT DISTINCT 'k' || (event_id % 400) AS key FROM events WHERE event_id % 6 = 0), h AS (SELECT count(*) AS n FROM events WHERE 'k' || (event_id % 700) IN (SELECT key FROM c)) SELECT (SELECT count(*) FROM c) AS entries, n AS hits FROM h",
    "sql_tool_query": _OPEN,
    "sql_tool_sets": _SETS,
    "slug_counts": "SELECT slug, count(*) AS n FROM sections GROUP BY slug",
    "filings_per_company_form": "SELECT cik, form, count(*) AS n, min(filing_date) AS first, max(filing_date) AS last FROM filings GROUP BY cik, form",
    "filings_zip_explode": "WITH f AS (SELECT DISTINCT * FROM filings WHERE regexp_matches(cik, '^[0-9]{10}$')) SELECT accession, cik, form, filing_date, report_date, nullif(items, '') AS items, primary_doc, size_bytes FROM f WHERE form IN ('10-K', '10-Q', '8-K') AND length(primary_doc) > 0 AND filing_date >= DATE '2016-01-01'",
}
