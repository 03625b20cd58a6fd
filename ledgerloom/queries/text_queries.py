"""Units of text, sections, chunks, retrieval and scalar functions, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerloom import schemas, tasks
from ledgerloom.functions import documents, keys, scalars
from ledgerloom.operators import extraction, ingest, retrieval, units
from ledgerloom.plans.cut import written
from ledgerloom.queries import views
from ledgerloom.sources.tables import table

_ASKED = (("10-K", None), ("10-Q", "7"), ("8-K", "9.01"), ("8-K/A", "2.02"), ("8-k", "5.02"), ("8-K", None))
QUESTION = "how did currency swings and container volumes affect the order backlog"


def _model(spark, root):
    """(sections, filings, companies) with one row per clean key."""
    s = table(spark, root, "sections").withColumn("accession", F.substring_index("section_id", ":", 1)).withColumn("slug", F.substring_index("section_id", ":", -1))
    f = units.latest(table(spark, root, "filings"), "accession").withColumn("cik", F.lpad(keys.cik_number(F.col("cik")).cast("string"), 10, "0"))
    return s.distinct(), f, units.latest(table(spark, root, "companies"), "cik")


def guidance_units(spark, root):
    return units.guidance_units(*_model(spark, root)).drop("filing_date").withColumn("section_text", F.md5("section_text"))


def risk_delta_pairs(spark, root):
    return units.risk_pairs(*_model(spark, root)).drop("filing_date", "name").withColumn("current_text", F.md5("current_text")).withColumn("prior_text", F.md5("prior_text"))


def event_text_concat(spark, root):
    return units.event_units(*_model(spark, root)).withColumn("section_text", F.md5("section_text"))


def keep_longest_section(spark, root):
    return units.longest_per_name(table(spark, root, "sections").select("section_id", "accession", keys.slug(F.col("heading")).alias("slug"), "ordinal", "text").distinct()).select("section_id", "ordinal")


def parse_coverage(spark, root):
    s, f, _ = _model(spark, root)
    sizes = f.select("accession", "form", (F.length("url") * 40).alias("n_chars"))
    rows = units.coverage(s, sizes)
    return rows.select("accession", scalars.round_half_away(F.col("coverage"), 6).alias("coverage"), F.array_join("slugs", ",").alias("slugs"), F.array_join("issues", ",").alias("issues"))


def toc_prefix(spark, root):
    e = table(spark, root, "events").select(F.col("user_id").alias("document"), (F.unix_micros(F.col("ts").cast("timestamp")) / 1000000).cast("long").alias("start")).distinct()
    return units.before_gap(e, "document", 86400)


def keyword_search(spark, root):
    return retrieval.keyword_search(table(spark, root, "chunks"), QUESTION, 24)


def keyword_search_scoped(spark, root):
    c = retrieval.scoped(table(spark, root, "chunks"), slug="risk_factors")
    return retrieval.keyword_search(c, "cyber incident at a vendor", 10)


def _vectors(spark, root):
    return table(spark, root, "embeddings").select(F.col("vec_id").cast("string").alias("chunk_id"), F.col("embedding").alias("vec"))


_QUERY_VECTOR = [((i * 7) % 13 - 6) / 10.0 for i in range(64)]


def vector_search(spark, root):
    return retrieval.vector_search(_vectors(spark, root), _QUERY_VECTOR, 24)


def _chunk_numbers(spark, root):
    """Documents under the vectors' numbers, so that both lists of a fusion speak of the same keys."""
    return table(spark, root, "documents").select(F.col("doc_id").cast("string").alias("chunk_id"), "text")


def hybrid_rrf(spark, root):
    return retrieval.fused(retrieval.vector_search(_vectors(spark, root), _QUERY_VECTOR, 24), retrieval.keyword_search(_chunk_numbers(spark, root), QUESTION, 24), 8).withColumn("sources", F.array_join("sources", ","))


def vector_nearest(spark, root):
    e = table(spark, root, "embeddings")
    return retrieval.nearest(e.filter("vec_id % 20 = 0"), e, 5)


def pending_index_anti(spark, root):
    have = table(spark, root, "embeddings").select(F.col("vec_id").cast("string").alias("chunk_id"), F.concat(F.lit("m"), F.col("label").cast("string")).alias("model"))
    return retrieval.pending(_chunk_numbers(spark, root), have, "m1").select("chunk_id")


def index_stats(spark, root):
    have = table(spark, root, "embeddings").select(F.concat(F.lit("m"), F.col("label").cast("string")).alias("model"), F.size("embedding").alias("dim"))
    return retrieval.index_stats(table(spark, root, "chunks"), have)


def hash_embed(spark, root):
    return retrieval.embedded(table(spark, root, "chunks").select("chunk_id", "text").distinct(), "hash-64").select("chunk_id", F.transform("vec", lambda x: F.round(x.cast("double"), 5)).alias("vec"))


def chunks(spark, root):
    s = table(spark, root, "sections").select("section_id", "accession", "text").distinct()
    return ingest.chunks_of(s, s.select("accession", F.lit("0").alias("cik")).distinct()).select("chunk_id", "ordinal", "token_estimate", F.length("text").alias("n_chars"), F.md5("text").alias("digest"))


def _as_html(spark, root):
    s, f, _ = _model(spark, root)
    escaped = F.replace(F.replace(F.replace(F.col("text"), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    part = F.concat(F.lit("<p>Item "), (F.col("ordinal") + 1).cast("string"), F.lit(". <b>"), F.coalesce("heading", F.lit("x")), F.lit("</b></p><div>"), F.replace(escaped, F.lit("\n\n"), F.lit("</div><div>")), F.lit("</div><script>var a = '</p>';</script>"))
    pages = s.groupBy("accession").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "section_id", part.alias("h")))), lambda x: x["h"]), "").alias("html"))
    return pages.select("accession", F.concat(F.lit("<html><head><title>t</title><meta name=x><div>"), "html").alias("html")).join(f.select("accession", "cik", "form"), "accession")


def html_text(spark, root):
    t = _as_html(spark, root).select("accession", documents.columns()["html_to_text"](F.col("html")).alias("t"))
    return t.select("accession", F.length("t").alias("n_chars"), F.md5("t").alias("digest"))


def sections_split(spark, root):
    return ingest.sections_of(ingest.parsed(_as_html(spark, root))).select("section_id", "slug", "heading", "ordinal", "char_len", F.md5("text").alias("digest"))


def ingest_report(spark, root):
    p = written(ingest.parsed(_as_html(spark, root)), "parsed")
    s = ingest.sections_of(p)
    return ingest.report(p, s, ingest.chunks_of(s, p))


def grounding_exact_alnum(spark, root):
    c = table(spark, root, "chunks").select("chunk_id", keys.section_key(F.col("section_id")).alias("key"), F.substring("text", 20, 60).alias("quote")).distinct()
    s = table(spark, root, "sections").select(keys.section_key(F.col("section_id")).alias("key"), "text").distinct()
    return c.join(s, "key").select("chunk_id", extraction.contains_quote(F.col("quote"), F.col("text")).alias("method"))


def grounding_fuzzy(spark, root):
    c = table(spark, root, "chunks").select("chunk_id", keys.section_key(F.col("section_id")).alias("key"), F.array(F.regexp_replace(F.substring("text", 20, 90), " the ", " ")).alias("quotes")).distinct()
    s = table(spark, root, "sections").select(keys.section_key(F.col("section_id")).alias("key"), "text").distinct()
    g = extraction.grounded(c.join(s, "key"), "quotes", "text")
    return g.select("chunk_id", "grounding.total", "grounding.grounded", "grounding.ratio", F.array_join("grounding.methods", ",").alias("methods"))


def token_estimate(spark, root):
    return table(spark, root, "documents").select("doc_id", scalars.token_estimate(F.col("text")).alias("tokens"), scalars.approx_tokens(F.col("text")).alias("approx"))


def lexicon_counts(spark, root):
    t = F.col("text")
    return table(spark, root, "documents").filter(t.isNotNull()).select(
        "doc_id", scalars.occurrences(t, schemas.GOOD_WORDS).alias("good"), scalars.occurrences(t, schemas.BAD_WORDS).alias("bad"), scalars.leaning(t).alias("leaning")
    )


def fitted_texts(spark, root):
    t = scalars.fitted_text(F.col("text"), 1400)
    return table(spark, root, "sections").select("section_id", F.length(t).alias("n"), F.md5(t).alias("digest")).distinct()


def cik_normalise(spark, root):
    return table(spark, root, "filings").select("accession", scalars.cik_padded(F.col("cik")).alias("cik")).distinct()


def filing_url(spark, root):
    f = table(spark, root, "filings").filter(keys.cik_number(F.col("cik")).isNotNull())
    return f.select("accession", scalars.filing_url("https://filings.example/data", keys.cik_number(F.col("cik")), F.col("accession"), F.col("primary_doc")).alias("url")).distinct()


def slug_resolve(spark, root):
    """Each heading under its own form, and under current reports with four codes."""
    h = table(spark, root, "sections").filter(F.col("heading").isNotNull()).select("section_id", F.regexp_extract("heading", r"(?i)^\s*item\s+(\d{1,2}(?:\.\d{2})?[a-c]?)", 1).alias("own"), F.regexp_replace("heading", r"(?i)^\s*item\s+[0-9]+[a-c]?(\.[0-9]+)?\s*[.:—–-]?\s*", "").alias("title"))
    asked = F.array(*[F.struct(F.lit(f).alias("form"), (F.col("own") if c is None else F.lit(c)).alias("item")) for f, c in _ASKED])
    rows = h.select("section_id", "title", F.explode(asked).alias("a")).select("section_id", "a.form", "a.item", "title").distinct()
    return rows.withColumn("slug", documents.columns()["resolve_slug"](F.col("form"), F.col("item"), F.col("title")))


def event_slugs(spark, root):
    return table(spark, root, "companies").select(scalars.event_slug(F.col("name")).alias("slug")).distinct()


def evidence_tidy(spark, root):
    d = table(spark, root, "documents").filter(F.col("text").isNotNull())
    q = scalars.tidy_quotes(F.split("text", r"\. "), 40, 90, 4)
    return d.select("doc_id", F.array_join(F.transform(q, lambda x: F.md5(x)), ",").alias("quotes"))


#: A payload of the kind that event_id asks for; {v} is the event's value.
_PAYLOADS = (
    '{broken', None, '{"direction":null,"guidance_change":"none","confidence":0.5,"rationale":"r"}', '{"direction":"bullish","guidance_change":"none","confidence":"high","rationale":"r"}',
    '{"direction":"bullish","guidance_change":"none","confidence":1,"rationale":"r","evidence":"text"}', '{"direction":"up","guidance_change":"none","confidence":1,"rationale":null,"more":1}',
    '{"direction":"bearish","guidance_change":"lowered","confidence":{v},"rationale":"r","evidence":["too short","  a quote that   is long enough "]}', '{"direction":"neutral","confidence":null}', '[1]',
    '{"direction":"bearish","guidance_change":"raised","confidence":"0.25","rationale":"r","evidence":[]}',
)
_ERRORS = (
    "not a JSON object", "not a JSON object", "direction: null is not in the vocabulary", "confidence: not a number", "evidence: not a list of texts", "direction: up is not in the vocabulary;rationale: not a text;more: unknown field",
    "", "guidance_change: missing;confidence: not a number;rationale: missing", "not a JSON object", "",
)


def payload_validate(spark, root):
    e = table(spark, root, "events").select("event_id", "value")
    kind = F.col("event_id") % len(_PAYLOADS)
    text = lambda p: F.lit(p).cast("string") if p is None or "{v}" not in p else F.concat(F.lit(p.split("{v}")[0]), F.col("value").cast("string"), F.lit(p.split("{v}")[1]))
    payload = F.coalesce(*[F.when(kind == n, text(p)) for n, p in enumerate(_PAYLOADS)])
    rows = extraction.validated(e.withColumn("payload", payload), "payload", tasks.TASKS["guidance_tone"].schema)
    return rows.select(
        "event_id", "valid", F.array_join("errors", ";").alias("errors"), F.when(F.col("valid"), F.col("fields.direction")).alias("direction"),
        scalars.round_half_away(F.col("fields.confidence"), 9).alias("confidence"), F.array_join("fields.evidence", "|").alias("evidence"),
    )


_ACC = "split_part(section_id, ':', 1)"
_MODEL = f"""WITH s AS (SELECT DISTINCT section_id, {_ACC} AS accession, split_part(section_id, ':', 2) AS slug, heading, ordinal, text FROM sections),
f AS (SELECT accession, lpad(CAST(TRY_CAST(regexp_replace(cik, '[^0-9]', '', 'g') AS BIGINT) AS VARCHAR), 10, '0') AS cik, form, filing_date, report_date, items, url FROM filings QUALIFY row_number() OVER (PARTITION BY accession ORDER BY fetched_at DESC) = 1),
c AS (SELECT cik, ticker, name FROM companies QUALIFY row_number() OVER (PARTITION BY cik ORDER BY fetched_at DESC) = 1),
j AS (SELECT s.*, f.cik, f.form, f.filing_date, f.report_date, f.items, c.ticker, c.name FROM s JOIN f USING (accession) JOIN c ON c.cik = f.cik)"""


def _fit(expr: str, tokens: int) -> str:
    """The same cut, by the text after the last mark."""
    most = int(max(tokens - 1200, 500) * 3.6)
    trim = lambda x: rf"regexp_replace({x}, '^[\s\p{{Z}}\x0B]+|[\s\p{{Z}}\x0B]+$', '', 'g')"
    whole = trim(expr)
    head = f"left({whole}, {most})"

    def last(mark: str, n: int) -> str:
        m = {"p": "chr(10) || chr(10)", "s": "'. '", "l": "chr(10)"}[mark]
        at = f"length({head}) - length(list_extract(string_split({head}, {m}), -1)) - {n}"
        return f"CASE WHEN {at} > {0.75 * most} THEN {at} + {1 if mark == 's' else 0} END"

    cut = f"coalesce({last('p', 2)}, {last('s', 2)}, {last('l', 1)}, length({head}))"
    return f"CASE WHEN length({whole}) > {most} THEN {trim(f'left({head}, {cut})')} || chr(10) || chr(10) || '[truncated]' ELSE {whole} END"


def _terms(question: str) -> str:
    return " + ".join(f"CASE WHEN contains(lower(text), '{t}') THEN {w}::DOUBLE ELSE 0.0::DOUBLE END" for t, w in scalars.query_terms(question)) or "0.0"


def _round(x: str, p: int) -> str:
    return f"sign({x}) * floor(abs({x}) * {10**p}::DOUBLE + 0.5::DOUBLE) / {10**p}::DOUBLE"


_VEC = "[" + ", ".join(f"{x}::DOUBLE" for x in _QUERY_VECTOR) + "]"
_DOT = "list_sum(list_transform(list_zip({0}, {1}), lambda x: x[1]::DOUBLE * x[2]::DOUBLE))"
_COS = f"({_DOT.format('embedding', _VEC)} / (sqrt({_DOT.format('embedding', 'embedding')}) * sqrt({_DOT.format(_VEC, _VEC)})))"
_SEC = "regexp_replace(split_part({0}, ':', 1), '[^0-9]', '', 'g') || ':' || lower(trim(split_part({0}, ':', 2)))"
_COUNT = lambda words: " + ".join(f"CAST((length(lower(text)) - length(replace(lower(text), '{w}', ''))) / {len(w)} AS INTEGER)" for w in words)

_BLANK = r"[\s\p{Z}\x{85}\x{1C}-\x{1F}\x{0B}]"
_MOST, _BACK = int(512 * 3.6), int(64 * 3.6)


def _slug_sql(form: str, item: str, title: str) -> str:
    """The name of a section, as SQL."""
    unnamed = f"'item_' || replace(lower({item}), '.', '_')"
    current = " ".join(f"WHEN lower({item}) = '{k}' THEN '{v}'" for k, v in schemas.CURRENT_ITEMS.items())
    titles = " ".join(f"WHEN regexp_matches({title}, '{p}') THEN '{v}'" for p, v in schemas.TITLE_SLUGS)
    annual = " ".join(f"WHEN lower({item}) = '{k}' THEN '{v}'" for k, v in schemas.ANNUAL_ITEMS.items())
    return f"CASE WHEN starts_with(upper({form}), '8-K') THEN CASE {current} ELSE {unnamed} END {titles} {annual} ELSE {unnamed} END"


def _trimmed(x: str) -> str:
    return rf"regexp_replace({x}, '^{_BLANK}+|{_BLANK}+$', '', 'g')"


#: Chunks of src(section_id, text): units, their running lengths, and a window per step.
_CHUNKED = rf"""
ct AS (SELECT section_id, {_trimmed("text")} AS text FROM src WHERE text IS NOT NULL),
par AS (SELECT section_id, unnest(string_split(regexp_replace(text, '(\n{_BLANK}*\n)', '\1' || chr(1), 'g'), chr(1))) AS p, generate_subscripts(string_split(regexp_replace(text, '(\n{_BLANK}*\n)', '\1' || chr(1), 'g'), chr(1)), 1) AS pn FROM ct WHERE length(text) > 0),
sen AS (SELECT section_id, pn, unnest(x) AS s, generate_subscripts(x, 1) AS sn FROM (SELECT section_id, pn, CASE WHEN length(p) <= {_MOST} THEN [p] ELSE string_split(regexp_replace(p, '([.!?]{_BLANK}+)([A-Z0-9])', '\1' || chr(1) || '\2', 'g'), chr(1)) END AS x FROM par)),
uni AS (SELECT section_id, pn, sn, unnest(range(0, greatest(length(s), 1), {_MOST})) AS un, s FROM sen),
cut AS (SELECT section_id, pn, sn, un, substr(s, un + 1, {_MOST}) AS u FROM uni),
uns AS (SELECT section_id, list(u ORDER BY pn, sn, un) AS us FROM cut WHERE regexp_matches(u, '[^\s\p{{Z}}\x{{85}}\x{{1C}}-\x{{1F}}\x{{0B}}]') GROUP BY section_id),
ends AS (SELECT section_id, array_to_string(us, '') AS joined, list_concat([0], list_transform(range(1, len(us) + 1), lambda i: list_sum(list_transform(us[1:i], lambda x: length(x)))))::BIGINT[] AS e FROM uns),
win AS (
  SELECT section_id, joined, e, 0 AS n, 0::BIGINT AS a, greatest(1, len(list_filter(e, lambda x: x <= {_MOST})) - 1)::BIGINT AS b FROM ends
  UNION ALL
  SELECT section_id, joined, e, n + 1, f, greatest(b + 1, len(list_filter(e, lambda x: x <= e[f + 1] + {_MOST})) - 1)
  FROM (SELECT *, greatest(a + 1, len(list_filter(e, lambda x: x <= e[b + 1] - {_BACK})) - 1)::BIGINT AS f FROM win WHERE b < len(e) - 1)
),
raw_chunks AS (SELECT section_id, n, {_trimmed("substr(joined, e[a + 1] + 1, e[b + 1] - e[a + 1])")} AS t, max(n) OVER (PARTITION BY section_id) AS last FROM win),
chunked AS (
  SELECT c.section_id, c.n, CASE WHEN c.n = c.last - 1 AND x.small THEN c.t || ' ' || x.t ELSE c.t END AS text
  FROM raw_chunks c JOIN (SELECT section_id, t, last > 0 AND greatest(1, round_even(length(t) / 3.6::DOUBLE, 0)) < 32 AS small FROM raw_chunks WHERE n = last) x USING (section_id)
  WHERE NOT (c.n = c.last AND x.small)
)"""

#: Text of the pages that _as_html makes, without what is said again and again.
_PAGES = (
    _MODEL.replace("WITH s AS", "WITH RECURSIVE s AS")
    + rf""", pg AS (
  SELECT accession, chr(10) || string_agg(chr(10) || 'Item ' || (ordinal + 1) || '. ' || coalesce(heading, 'x') || chr(10) || replace(text, chr(10) || chr(10), chr(10)), '' ORDER BY ordinal, section_id) AS t FROM s JOIN f USING (accession) GROUP BY accession
), sq AS (SELECT accession, regexp_replace(regexp_replace(regexp_replace(replace(replace(replace(t, chr(160), ' '), chr(8203), ''), chr(13) || chr(10), chr(10)), '[ \t]+', ' ', 'g'), ' +\n', chr(10), 'g'), '\n +', chr(10), 'g') AS t FROM pg
), ln AS (SELECT accession, unnest(string_split(t, chr(10))) AS x, generate_subscripts(string_split(t, chr(10)), 1) AS n FROM sq
), fu AS (SELECT *, {_trimmed("x")} AS z FROM ln
), kp AS (SELECT *, length(z) BETWEEN 1 AND 40 AND count(*) OVER (PARTITION BY accession, z) >= 5 AND len(list_filter(regexp_split_to_array(regexp_replace(z, '^[ .:|]+|[ .:|]+$', '', 'g'), '{_BLANK}+'), lambda w: w <> '')) < 4 AS gone FROM fu
), pages AS (SELECT p.accession, f.cik, f.form, {_trimmed("regexp_replace(p.t, '" + chr(92) + "n{3,}', chr(10) || chr(10), 'g')")} AS text FROM (SELECT accession, coalesce(string_agg(x, chr(10) ORDER BY n) FILTER (NOT gone), '') AS t FROM kp GROUP BY accession) p JOIN f USING (accession))"""
)
_HEAD = r"(?i)^\s*item\s+(\d{1,2}(?:\.\d{2})?[a-c]?)\s*[.:—\-–]?\s*(.{0,120})$"
#: Named sections of pages(accession, form, text).
_SPLIT = rf""", hl AS (SELECT accession, form, unnest(string_split(text, chr(10))) AS x, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM pages
), hp AS (SELECT *, coalesce(lag(x) OVER (PARTITION BY accession ORDER BY n), 'x') AS up FROM hl
), hm AS (SELECT *, regexp_matches(x, '{_HEAD}') AND (NOT regexp_matches(up, '\S') AND n > 1 OR length({_trimmed("x")}) <= 140 AND NOT regexp_matches({_trimmed("x")}, '(,|;|and|or|in|of|to)$')) AS is_head FROM hp
), hg AS (SELECT *, sum(is_head::INT) OVER (PARTITION BY accession ORDER BY n ROWS UNBOUNDED PRECEDING) AS k FROM hm
), hb AS (SELECT accession, form, k, max(x) FILTER (is_head) AS head, coalesce(string_agg(x, chr(10) ORDER BY n) FILTER (NOT is_head), '') AS body FROM hg WHERE k > 0 GROUP BY accession, form, k
), hn AS (SELECT *, length(regexp_replace(body, '{_BLANK}+$', '')) + CASE WHEN regexp_matches(body, '\S') THEN 2 ELSE 1 END AS gap, max(k) OVER (PARTITION BY accession) AS m FROM hb
), hr AS (SELECT *, coalesce(min(CASE WHEN gap >= 200 AND k < m THEN k END) OVER (PARTITION BY accession), m) - 1 AS run FROM hn
), hk AS (SELECT accession, form, k, head, {_trimmed("body")} AS body FROM hr WHERE NOT (run >= 3 AND m - run >= 2 AND k <= run)
), hc AS (SELECT *, regexp_extract(head, '{_HEAD}', 1) AS code, regexp_replace(regexp_extract(head, '{_HEAD}', 2), '^[ .:–—-]+|[ .:–—-]+$', '', 'g') AS title FROM hk WHERE length(body) >= 200
), hs AS (SELECT *, {_slug_sql("form", "code", "lower(regexp_replace(title, '" + _BLANK + "+', ' ', 'g'))")} AS slug FROM hc
), hl2 AS (SELECT * FROM hs QUALIFY row_number() OVER (PARTITION BY accession, slug ORDER BY length(body) DESC, k) = 1
), named AS (SELECT accession, form, slug, 'Item ' || code || CASE WHEN title <> '' THEN '. ' || title ELSE '' END AS heading, row_number() OVER (PARTITION BY accession ORDER BY k) - 1 AS ordinal, body AS text, FALSE AS fb FROM hl2
), split AS (SELECT * FROM named UNION ALL SELECT accession, form, 'body', form, 0, text, TRUE FROM pages WHERE length(text) > 0 AND accession NOT IN (SELECT accession FROM named))"""
_NORM = rf"lower(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(replace(nfc_normalize(@), chr(8203), ''), '[‘’‚‛]', chr(39), 'g'), '[“”„]', chr(34), 'g'), '[–—−]', '-', 'g'), '…', '...', 'g'), '{_BLANK}+', ' ', 'g')))"

QUERIES = {
    f.__name__: f
    for f in (
        guidance_units, risk_delta_pairs, event_text_concat, keep_longest_section, parse_coverage, toc_prefix, keyword_search, keyword_search_scoped, vector_search, hybrid_rrf, vector_nearest,
        pending_index_anti, index_stats, hash_embed, chunks, html_text, sections_split, ingest_report, grounding_exact_alnum, grounding_fuzzy, token_estimate, lexicon_counts, fitted_texts,
        cik_normalise, filing_url, slug_resolve, event_slugs, evidence_tidy, payload_validate,
    )
}
SQL = {
    "guidance_units": _MODEL + f" SELECT section_id, accession, cik, ticker, name, form, coalesce(report_date, filing_date) AS period, md5({_fit('text', 8000)}) AS section_text FROM j WHERE slug IN ('mdna', 'results_of_operations')",
    "risk_delta_pairs": _MODEL
    + f""", r AS (SELECT *, coalesce(report_date, filing_date) AS period FROM j WHERE slug = 'risk_factors' AND form IN ('10-K', '10-Q')),
p AS (SELECT section_id, accession, cik, form, period AS current_period, lag(period) OVER w AS prior_period, text, lag(text) OVER w AS before FROM r WINDOW w AS (PARTITION BY cik, form ORDER BY filing_date, accession, section_id))
SELECT section_id, accession, cik, form, current_period, prior_period, md5({_fit('text', 4800)}) AS current_text, md5({_fit('before', 3200)}) AS prior_text FROM p WHERE before IS NOT NULL""",
    "event_text_concat": _MODEL
    + f""", t AS (SELECT accession, cik, name, coalesce(items, '(none reported)') AS items, filing_date, coalesce(string_agg(heading || chr(10) || text, chr(10) || chr(10) ORDER BY ordinal, section_id), '') AS body FROM j WHERE form = '8-K' GROUP BY ALL)
SELECT accession, cik, name, items, filing_date, md5({_fit('body', 6000)}) AS section_text FROM t""",
    "keep_longest_section": r"""WITH p AS (SELECT DISTINCT section_id, accession, lower(regexp_replace(heading, '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g')) AS slug, ordinal, text FROM sections),
k AS (SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY accession, slug ORDER BY length(text) DESC NULLS LAST, ordinal NULLS LAST) = 1)
SELECT section_id, CAST(row_number() OVER (PARTITION BY accession ORDER BY ordinal NULLS LAST, slug NULLS FIRST) - 1 AS INTEGER) AS ordinal FROM k""",
    "parse_coverage": _MODEL
    + f""", a AS (SELECT accession, sum(length(text)) AS covered, list_sort(list_distinct(list(slug))) AS slugs FROM s GROUP BY accession),
x AS (SELECT f.accession, f.form, coalesce(a.slugs, []) AS slugs, coalesce(least(1.0::DOUBLE, coalesce(covered, 0)::DOUBLE / greatest(length(url) * 40, 1)), 0.0) AS coverage FROM f LEFT JOIN a USING (accession))
SELECT accession, {_round('coverage', 6)} AS coverage, array_to_string(slugs, ',') AS slugs, concat_ws(',',
  CASE WHEN len(slugs) = 0 THEN 'no_sections_detected' END,
  CASE WHEN coverage < CASE WHEN form IN ('10-K', '10-Q') THEN 0.6 WHEN form = '8-K' THEN 0.1 ELSE 0.3 END THEN printf('low_coverage_%d.%02d', CAST(floor(coverage * 100::DOUBLE + 0.5::DOUBLE) AS INTEGER) // 100, CAST(floor(coverage * 100::DOUBLE + 0.5::DOUBLE) AS INTEGER) % 100) END,
  CASE WHEN form IN ('10-K', '10-Q') AND NOT list_has_any(slugs, ['mdna', 'risk_factors']) THEN 'missing_key_sections' END) AS issues FROM x""",
    "toc_prefix": """WITH e AS (SELECT DISTINCT user_id AS document, CAST(floor(epoch_us(ts) / 1000000) AS BIGINT) AS start FROM events),
g AS (SELECT *, CASE WHEN coalesce(lead(start) OVER (PARTITION BY document ORDER BY start) - start, 86400) >= 86400 THEN 1 ELSE 0 END AS far FROM e)
SELECT document, start FROM (SELECT *, sum(far) OVER (PARTITION BY document ORDER BY start ROWS UNBOUNDED PRECEDING) AS passed FROM g) WHERE passed = 0""",
    "keyword_search": f"SELECT DISTINCT chunk_id, {_round(f'({_terms(QUESTION)})', 4)} AS score, CAST(length(text) AS INTEGER) AS text_len FROM chunks WHERE ({_terms(QUESTION)}) > 0 ORDER BY score DESC, text_len, chunk_id LIMIT 24",
    "keyword_search_scoped": f"SELECT DISTINCT chunk_id, {_round('(' + _terms('cyber incident at a vendor') + ')', 4)} AS score, CAST(length(text) AS INTEGER) AS text_len FROM chunks WHERE section_id LIKE '%:risk_factors' AND ({_terms('cyber incident at a vendor')}) > 0 ORDER BY score DESC, text_len, chunk_id LIMIT 10",
    "vector_search": f"SELECT CAST(vec_id AS VARCHAR) AS chunk_id, {_round(_COS, 6)} AS score FROM embeddings ORDER BY score DESC, chunk_id LIMIT 24",
    "hybrid_rrf": f"""WITH v AS (SELECT *, row_number() OVER (ORDER BY score DESC, chunk_id) AS rn FROM (SELECT CAST(vec_id AS VARCHAR) AS chunk_id, {_round(_COS, 6)} AS score FROM embeddings ORDER BY score DESC, chunk_id LIMIT 24)),
k AS (SELECT *, row_number() OVER (ORDER BY score DESC, n, chunk_id) AS rn FROM (SELECT CAST(doc_id AS VARCHAR) AS chunk_id, {_round(f'({_terms(QUESTION)})', 4)} AS score, length(text) AS n FROM documents WHERE ({_terms(QUESTION)}) > 0 ORDER BY score DESC, n, chunk_id LIMIT 24)),
u AS (SELECT chunk_id, rn, 0 AS l FROM v UNION ALL SELECT chunk_id, rn, 1 FROM k),
g AS (SELECT chunk_id, sum(1.0::DOUBLE / (60 + rn)) AS rrf, array_to_string(list_sort(list(CASE l WHEN 0 THEN 'vector' ELSE 'keyword' END)), ',') AS sources, min(l * 1000 + rn) AS first FROM u GROUP BY chunk_id)
SELECT chunk_id, {_round('rrf', 6)} AS score, sources FROM g ORDER BY rrf DESC, first LIMIT 8""",
    "vector_nearest": f"""WITH p AS (SELECT q.vec_id AS query_id, v.vec_id, {_round(f"({_DOT.format('q.embedding', 'v.embedding')} / (sqrt({_DOT.format('q.embedding', 'q.embedding')}) * sqrt({_DOT.format('v.embedding', 'v.embedding')})))", 6)} AS score
FROM embeddings q JOIN embeddings v ON q.vec_id <> v.vec_id WHERE q.vec_id % 20 = 0)
SELECT query_id, vec_id, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM p QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 5""",
    "pending_index_anti": "SELECT CAST(doc_id AS VARCHAR) AS chunk_id FROM documents d LEFT JOIN (SELECT vec_id FROM embeddings WHERE label = 1) e ON e.vec_id = d.doc_id WHERE e.vec_id IS NULL",
    "index_stats": "SELECT 'm' || label AS model, count(*) AS n_vectors, CAST(min(len(embedding)) AS INTEGER) AS dim FROM embeddings GROUP BY label UNION ALL SELECT NULL, count(*), NULL FROM chunks",
    "grounding_exact_alnum": f"""WITH c AS (SELECT DISTINCT chunk_id, {_SEC.format('section_id')} AS k, substr(text, 20, 60) AS quote FROM chunks), s AS (SELECT DISTINCT {_SEC.format('section_id')} AS k, text FROM sections),
n AS (SELECT chunk_id, lower(trim(regexp_replace(quote, '{_BLANK}+', ' ', 'g'))) AS q, lower(trim(regexp_replace(text, '{_BLANK}+', ' ', 'g'))) AS t, regexp_replace(lower(quote), '[^a-z0-9]+', '', 'g') AS bq, regexp_replace(lower(text), '[^a-z0-9]+', '', 'g') AS bt FROM c JOIN s USING (k))
SELECT chunk_id, CASE WHEN length(q) > 0 AND contains(t, q) THEN 'exact' WHEN length(bq) > 0 AND contains(bt, bq) THEN 'normalised' ELSE 'none' END AS method FROM n""",
    "token_estimate": "SELECT doc_id, greatest(1, CAST(round_even(length(text) / 3.6::DOUBLE, 0) AS INTEGER)) AS tokens, greatest(1, CAST(floor(length(text) / 4) AS INTEGER)) AS approx FROM documents",
    "lexicon_counts": f"WITH n AS (SELECT doc_id, {_COUNT(schemas.GOOD_WORDS)} AS good, {_COUNT(schemas.BAD_WORDS)} AS bad FROM documents WHERE text IS NOT NULL) SELECT doc_id, good, bad, CASE WHEN good + bad > 0 THEN {_round('((good - bad) / (good + bad)::DOUBLE)', 3)} ELSE 0.0 END AS leaning FROM n",
    "fitted_texts": f"SELECT DISTINCT section_id, CAST(length({_fit('text', 1400)}) AS INTEGER) AS n, md5({_fit('text', 1400)}) AS digest FROM sections",
    "cik_normalise": "SELECT DISTINCT accession, lpad(regexp_replace(regexp_replace(cik, '[^0-9]', '', 'g'), '^0+', ''), 10, '0') AS cik FROM filings WHERE length(trim(cik)) > 0 UNION SELECT accession, NULL FROM filings WHERE cik IS NULL OR length(trim(cik)) = 0",
    "filing_url": "SELECT DISTINCT accession, 'https://filings.example/data/' || CAST(TRY_CAST(regexp_replace(cik, '[^0-9]', '', 'g') AS BIGINT) AS VARCHAR) || '/' || replace(accession, '-', '') || '/' || primary_doc AS url FROM filings WHERE TRY_CAST(regexp_replace(cik, '[^0-9]', '', 'g') AS BIGINT) IS NOT NULL",
    "slug_resolve": rf"""WITH h AS (SELECT DISTINCT section_id, regexp_extract(heading, '(?i)^\s*item\s+(\d{{1,2}}(?:\.\d{{2}})?[a-c]?)', 1) AS own, regexp_replace(heading, '(?i)^\s*item\s+[0-9]+[a-c]?(\.[0-9]+)?\s*[.:—–-]?\s*', '') AS title FROM sections WHERE heading IS NOT NULL),
a AS ({" UNION ALL ".join(f"SELECT section_id, '{f}' AS form, {'own' if c is None else repr(c)} AS item, title FROM h" for f, c in _ASKED)})
SELECT DISTINCT section_id, form, item, title, {_slug_sql("form", "item", "lower(trim(regexp_replace(title, '" + _BLANK + "+', ' ', 'g')))")} AS slug FROM a""",
    "event_slugs": "SELECT DISTINCT regexp_replace(left(regexp_replace(lower(trim(name)), '[^a-z0-9_]+', '_', 'g'), 60), '^_+|_+$', '', 'g') AS slug FROM companies",
    "evidence_tidy": "SELECT doc_id, array_to_string(list_transform(list_filter(list_transform(string_split(text, '. '), lambda x: trim(regexp_replace(x, '[\\s\\p{Z}\\x{85}\\x{1C}-\\x{1F}\\x{0B}]+', ' ', 'g'))), lambda x: length(x) >= 40)[1:4], lambda x: md5(left(x, 90))), ',') AS quotes FROM documents WHERE text IS NOT NULL",
    "payload_validate": f"""WITH k AS (SELECT event_id, event_id % {len(_PAYLOADS)} AS kind, value FROM events)
SELECT event_id, kind IN (6, 9) AS valid, list_extract({list(_ERRORS)!r}, CAST(kind + 1 AS INTEGER)) AS errors, CASE WHEN kind IN (6, 9) THEN 'bearish' END AS direction,
  CASE kind WHEN 2 THEN 0.5::DOUBLE WHEN 4 THEN 1.0::DOUBLE WHEN 5 THEN 1.0::DOUBLE WHEN 9 THEN 0.25::DOUBLE WHEN 6 THEN {_round("greatest(0.0::DOUBLE, least(1.0::DOUBLE, CASE WHEN value > 1 AND value <= 100 THEN value / 100 ELSE value END))", 9)} END AS confidence,
  CASE WHEN kind = 6 THEN 'a quote that is long enough' WHEN kind IN (0, 1, 2, 3, 4, 5, 7, 8, 9) THEN '' END AS evidence FROM k""",
    "chunks": "WITH RECURSIVE src AS (SELECT DISTINCT section_id, text FROM sections)," + _CHUNKED + " SELECT section_id || ':' || n AS chunk_id, n::INTEGER AS ordinal, CAST(greatest(1, round_even(length(text) / 3.6::DOUBLE, 0)) AS INTEGER) AS token_estimate, CAST(length(text) AS INTEGER) AS n_chars, md5(text) AS digest FROM chunked",
    "html_text": _PAGES + " SELECT accession, CAST(length(text) AS INTEGER) AS n_chars, md5(text) AS digest FROM pages",
    "sections_split": _PAGES + _SPLIT + " SELECT accession || ':' || slug AS section_id, slug, heading, CAST(ordinal AS INTEGER) AS ordinal, CAST(length(text) AS INTEGER) AS char_len, md5(text) AS digest FROM split",
    "ingest_report": _PAGES
    + _SPLIT
    + ", src AS (SELECT accession || ':' || slug AS section_id, text FROM split),"
    + _CHUNKED
    + """, cov AS (SELECT p.accession, p.form, length(p.text) AS n, sum(length(x.text)) AS covered, bool_and(x.fb) AS fb, list(x.slug) AS slugs FROM pages p JOIN split x USING (accession) GROUP BY ALL)
SELECT (SELECT count(DISTINCT cik) FROM pages) AS companies, (SELECT count(*) FROM pages) AS filings, (SELECT count(*) FROM pages WHERE length(text) = 0) AS skipped,
  (SELECT count(*) FROM cov WHERE fb OR least(1.0, covered / n) < CASE WHEN form IN ('10-K', '10-Q') THEN 0.6 WHEN form = '8-K' THEN 0.1 ELSE 0.3 END OR form IN ('10-K', '10-Q') AND NOT list_has_any(slugs, ['mdna', 'risk_factors'])) AS flagged,
  (SELECT count(*) FROM split) AS sections, (SELECT count(*) FROM chunked) AS chunks""",
    "grounding_fuzzy": f"""WITH c AS (SELECT DISTINCT chunk_id, {_SEC.format('section_id')} AS k, replace(substr(text, 20, 90), ' the ', ' ') AS quote FROM chunks), s AS (SELECT DISTINCT {_SEC.format('section_id')} AS k, text FROM sections),
n AS (SELECT chunk_id, {_NORM.replace('@', 'quote')} AS q, {_NORM.replace('@', 'text')} AS t FROM c JOIN s USING (k)),
w AS (SELECT *, regexp_replace(q, '[^a-z0-9]+', '', 'g') AS bq, regexp_replace(t, '[^a-z0-9]+', '', 'g') AS bt, string_split(q, ' ') AS qs, string_split(t, ' ') AS ts FROM n),
x AS (SELECT *, list_sort(list_transform(list_filter(list_distinct(qs), lambda v: list_contains(ts, v)), lambda v: {{'n': len(list_filter(ts, lambda y: y = v)), 'at': list_position(qs, v), 'v': v}})) AS here FROM w),
y AS (SELECT *, list_filter(range(0, len(ts)), lambda i: ts[i + 1] = here[1].v) AS places, len(list_distinct(qs)) AS want FROM x),
g AS (SELECT chunk_id, CASE WHEN q = '' THEN 'none' WHEN contains(t, q) THEN 'exact' WHEN length(bq) > 0 AND contains(bt, bq) THEN 'normalised'
  WHEN len(qs) >= 3 AND len(here) > 0 AND list_max(list_transform(places, lambda p: len(list_intersect(list_distinct(ts[greatest(0, p - len(qs)) + 1:greatest(0, p - len(qs)) + 2 * len(qs)]), list_distinct(qs))))) >= 0.85::DOUBLE * want THEN 'fuzzy' ELSE 'none' END AS methods FROM y)
SELECT chunk_id, 1 AS total, CAST(methods <> 'none' AS INTEGER) AS grounded, CASE WHEN methods <> 'none' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS ratio, methods FROM g""",
    "hash_embed": """WITH c AS (SELECT DISTINCT chunk_id, text FROM chunks), w AS (SELECT chunk_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS ws FROM c),
b AS (SELECT chunk_id, list_transform(ws, lambda x: ((strpos('0123456789abcdef', substr(md5(x), 7, 1)) - 1) * 16 + strpos('0123456789abcdef', substr(md5(x), 8, 1)) - 1) % 64) AS bs FROM w),
n AS (SELECT chunk_id, list_transform(range(0, 64), lambda i: len(list_filter(bs, lambda y: y = i))::DOUBLE) AS v FROM b),
m AS (SELECT chunk_id, v, sqrt(list_sum(list_transform(v, lambda x: x * x))) AS l FROM n)
SELECT chunk_id, list_transform(v, lambda x: round(CAST(x / CASE WHEN l > 0 THEN l ELSE 1 END AS FLOAT)::DOUBLE, 5)) AS vec FROM m""",
}
