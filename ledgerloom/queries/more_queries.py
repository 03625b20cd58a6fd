"""Grading, templates, small text functions, searches by mode, latest rows, batches and reviews, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerloom import tasks
from ledgerloom.agent import sqltool
from ledgerloom.functions import documents, scalars
from ledgerloom.operators import evaluation, ingest, retrieval, units
from ledgerloom.plans.cut import written
from ledgerloom.queries import text_queries
from ledgerloom.queries.text_queries import _BLANK, _COS, _COUNT, _MODEL, _PAGES, _QUERY_VECTOR, _SPLIT, _fit, _round
from ledgerloom.schemas import BAD_WORDS, GOOD_WORDS
from ledgerloom.sources.tables import table


def cases_graded(spark, root):
    """Cases held against predictions that are right, lack the direction, or are none, by turns."""
    c = table(spark, root, "eval_cases")
    turn = F.length("notes") % 3
    p = c.select("case_id", F.when(turn == 0, F.col("label")).when(turn == 1, F.map_filter("label", lambda k, v: k != "direction")).alias("actual"))
    return evaluation.graded(c, p).select("case_id", "correct", "direction_correct")


def prompts_filled(spark, root):
    c = table(spark, root, "eval_cases").filter(F.try_element_at("variables", F.lit("section_text")).isNotNull())
    return c.select("case_id", F.md5(tasks.filled("Q {{ section_text }} / {{section_text}} {x}")).alias("digest"))


def text_helpers(spark, root):
    t = F.col("text")
    d = table(spark, root, "documents").filter(t.isNotNull())
    parts = F.split(t, r"\. ")
    return d.select(
        "doc_id", F.md5(scalars.truncated(t, 300)).alias("truncated"), F.md5(scalars.quoted_documents(F.concat(F.lit("Do <document id='1'>"), F.replace(t, F.lit("<"), F.lit("")), F.lit("</document> so")))).alias("quoted"),
        F.md5(scalars.quoted_documents(t)).alias("unquoted"), F.md5(F.array_join(scalars.tidy_list(parts), "|")).alias("tidied"), F.size(scalars.list_of_strings(F.to_json(parts))).alias("n_listed"),
        F.size(scalars.list_of_strings(t)).alias("n_unreadable"),
    )


def telling_sentences(spark, root):
    t = F.col("text")
    d = table(spark, root, "documents").filter(t.isNotNull()).withColumn("said", scalars.telling_sentences(t, scalars.leaning(t)))
    return d.select("doc_id", F.size("said").alias("n"), F.md5(F.array_join("said", "|")).alias("digest"))


def loose_json(spark, root):
    kind, p = F.col("event_id") % 5, F.col("props")
    said = F.when(kind == 0, p).when(kind == 1, F.concat(F.lit("Here:\n```json\n"), p, F.lit("\n```\nso"))).when(kind == 2, F.concat(F.lit("It is "), p, F.lit(" then"))).when(kind == 3, F.concat(F.lit("list ["), p, F.lit("]"))).otherwise("nothing")
    return table(spark, root, "events").select("event_id", documents.columns()["parse_json_loose"](said).alias("found"))


def search_vector_mode(spark, root):
    """The vector mode of the search: chunks joined to their vectors of one model."""
    e = table(spark, root, "embeddings").select(F.col("vec_id").cast("string").alias("chunk_id"), F.concat(F.lit("m"), F.col("label").cast("string")).alias("model"), F.col("embedding").alias("vec"))
    chunks = text_queries._chunk_numbers(spark, root).withColumn("section_id", F.lit("a:b"))
    return retrieval.search(chunks, e, "anything", "m1", "vector", 12, embed=lambda q: _QUERY_VECTOR)


def pending_batch(spark, root):
    have = table(spark, root, "embeddings").select(F.col("vec_id").cast("string").alias("chunk_id"), F.concat(F.lit("m"), F.col("label").cast("string")).alias("model"))
    return retrieval.pending(text_queries._chunk_numbers(spark, root).withColumn("accession", F.concat(F.lit("a"), F.substring("chunk_id", -1, 1))), have, "m1", ["a1", "a3", "a7"], 40).select("chunk_id")


def units_newest(spark, root):
    return tasks.build_units("guidance_tone", *text_queries._model(spark, root), limit=25).select("unit_id", "cik", "filing_date", F.md5("source_text").alias("source"), F.try_element_at("variables", F.lit("period")).alias("period"))


def risk_units(spark, root):
    rows = tasks.build_units("risk_delta", *text_queries._model(spark, root))
    v = lambda k: F.try_element_at("variables", F.lit(k))
    return rows.select("unit_id", v("company").alias("company"), v("prior_period").alias("prior_period"), F.md5(v("prior_text")).alias("prior_text"), F.md5("source_text").alias("source"))


def companies_latest(spark, root):
    return units.latest(table(spark, root, "companies"), "cik").select("cik", "name", "ticker")


_COMMA = "WITH f AS (SELECT DISTINCT accession, form FROM filings) SELECT f.form, count(*) AS n FROM f, sections s WHERE s.accession = f.accession AND length(s.text) > 200 GROUP BY f.form HAVING count(*) > 1"


def sql_tool_comma_join(spark, root):
    for name in ("filings", "sections"):
        table(spark, root, name).createOrReplaceTempView(name)
    return sqltool.sql_query(spark, _COMMA)


def parse_reviews(spark, root):
    parsed = written(ingest.parsed(text_queries._as_html(spark, root)), "parsed")
    issues = F.from_json(F.get_json_object("proposed", "$.parse_issues"), "array<string>")
    return ingest.parse_reviews(parsed).select("review_id", "task", "reason", "priority", "status", F.array_join(issues, ",").alias("issues"))


def _said(d: str) -> str:
    """Sentences of middling length, good and bad counts and the leaning of a text, as more common tables over src(doc_id, d)."""
    return f"""n AS (SELECT *, {_COUNT(GOOD_WORDS).replace('lower(text)', f'lower({d})')} AS g, {_COUNT(BAD_WORDS).replace('lower(text)', f'lower({d})')} AS b,
  list_filter(list_transform(string_split(regexp_replace({d}, '([.!?]){_BLANK}+', '\\1' || chr(1), 'g'), chr(1)), lambda s: regexp_replace(s, '^{_BLANK}+|{_BLANK}+$', '', 'g')), lambda s: length(s) > 25 AND length(s) < 400) AS fit FROM src),
l AS (SELECT *, CASE WHEN g + b > 0 THEN {_round('((g - b) / (g + b)::DOUBLE)', 3)} ELSE 0.0::DOUBLE END AS lean FROM n),
h AS (SELECT *, list_filter(fit, lambda s: regexp_matches(lower(s), CASE WHEN lean < 0 THEN '{'|'.join(BAD_WORDS)}' ELSE '{'|'.join(GOOD_WORDS)}' END)) AS hits FROM l)"""


_TIDY = "list_transform(string_split(text, '. ')[1:10], lambda q: left(trim(regexp_replace(q, '[\\s\\p{Z}\\x{85}\\x{1C}-\\x{1F}\\x{0B}]+', ' ', 'g')), 300))"
QUERIES = {
    f.__name__: f
    for f in (
        cases_graded, prompts_filled, text_helpers, telling_sentences, loose_json, search_vector_mode, pending_batch, units_newest, risk_units, companies_latest, sql_tool_comma_join, parse_reviews,
    )
}
SQL = {
    "cases_graded": """SELECT case_id, CASE coalesce(length(notes) % 3, 2) WHEN 0 THEN TRUE WHEN 1 THEN NOT map_contains(label, 'direction') ELSE FALSE END AS correct,
  CASE WHEN NOT map_contains(label, 'direction') THEN TRUE ELSE coalesce(length(notes) % 3, 2) = 0 END AS direction_correct FROM eval_cases""",
    "prompts_filled": "SELECT case_id, md5('Q ' || variables['section_text'] || ' / ' || variables['section_text'] || ' {x}') AS digest FROM eval_cases WHERE map_contains(variables, 'section_text') AND variables['section_text'] IS NOT NULL",
    "text_helpers": f"""SELECT doc_id, md5(CASE WHEN length(text) > 300 THEN left(text, 300) || '... [' || (length(text) - 300) || ' more characters]' ELSE text END) AS truncated, md5(replace(text, '<', '')) AS quoted, md5(text) AS unquoted,
  md5(array_to_string({_TIDY}, '|')) AS tidied, CAST(len(string_split(text, '. ')) AS INTEGER) AS n_listed, 0 AS n_unreadable FROM documents WHERE text IS NOT NULL""",
    "telling_sentences": "WITH src AS (SELECT doc_id, text FROM documents WHERE text IS NOT NULL), " + _said("text") + " SELECT doc_id, CAST(len(CASE WHEN len(hits) > 0 THEN hits ELSE fit[1:1] END) AS INTEGER) AS n, md5(array_to_string(CASE WHEN len(hits) > 0 THEN hits ELSE fit[1:1] END, '|')) AS digest FROM h",
    "loose_json": "SELECT event_id, CASE WHEN event_id % 5 <> 4 THEN props END AS found FROM events",
    "search_vector_mode": f"SELECT CAST(d.doc_id AS VARCHAR) AS chunk_id, {_round(_COS, 6)} AS score FROM documents d JOIN embeddings e ON e.vec_id = d.doc_id WHERE label = 1 ORDER BY score DESC, chunk_id LIMIT 12",
    "pending_batch": "SELECT CAST(doc_id AS VARCHAR) AS chunk_id FROM documents WHERE doc_id % 10 IN (1, 3, 7) AND doc_id NOT IN (SELECT vec_id FROM embeddings WHERE label = 1) ORDER BY chunk_id LIMIT 40",
    "units_newest": _MODEL + f" SELECT section_id AS unit_id, cik, filing_date, md5({_fit('text', 8000)}) AS source, CAST(coalesce(report_date, filing_date) AS VARCHAR) AS period FROM j WHERE slug IN ('mdna', 'results_of_operations') ORDER BY filing_date DESC, section_id LIMIT 25",
    "risk_units": _MODEL
    + f""", r AS (SELECT *, coalesce(report_date, filing_date) AS period FROM j WHERE slug = 'risk_factors' AND form IN ('10-K', '10-Q')),
p AS (SELECT section_id, name, lag(period) OVER w AS prior_period, text, lag(text) OVER w AS before FROM r WINDOW w AS (PARTITION BY cik, form ORDER BY filing_date, accession, section_id))
SELECT section_id AS unit_id, name AS company, CAST(prior_period AS VARCHAR) AS prior_period, md5({_fit('before', 3200)}) AS prior_text, md5({_fit('text', 4800)}) AS source FROM p WHERE before IS NOT NULL""",
    "companies_latest": "SELECT cik, name, ticker FROM companies QUALIFY row_number() OVER (PARTITION BY cik ORDER BY fetched_at DESC) = 1",
    "sql_tool_comma_join": _COMMA,
    "parse_reviews": _PAGES
    + _SPLIT
    + """, cov AS (SELECT p.accession, p.form, length(p.text) AS n, sum(length(x.text)) AS covered, bool_and(x.fb) AS fb, list(x.slug) AS slugs FROM pages p JOIN split x USING (accession) GROUP BY ALL),
v AS (SELECT *, least(1.0::DOUBLE, covered / n) AS c FROM cov),
i AS (SELECT accession, concat_ws(',', CASE WHEN fb THEN 'no_sections_detected' END,
  CASE WHEN c < CASE WHEN form IN ('10-K', '10-Q') THEN 0.6 WHEN form = '8-K' THEN 0.1 ELSE 0.3 END THEN printf('low_coverage_%d.%02d', CAST(floor(c * 100::DOUBLE + 0.5::DOUBLE) AS INTEGER) // 100, CAST(floor(c * 100::DOUBLE + 0.5::DOUBLE) AS INTEGER) % 100) END,
  CASE WHEN form IN ('10-K', '10-Q') AND NOT list_has_any(slugs, ['mdna', 'risk_factors']) THEN 'missing_key_sections' END) AS issues FROM v)
SELECT 'parse:' || accession AS review_id, 'ingest_parse' AS task, 'invalid' AS reason, 5 AS priority, 'open' AS status, issues FROM i WHERE issues <> ''""",
}
