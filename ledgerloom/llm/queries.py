"""The registered queries of this folder and the SQL of those that SQL can express over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm import bpe, langid, leaks, neardup, quality, sitelines, spans, splitting
from ledgerloom.sources.tables import table


def p1_found(spark: SparkSession, root: str) -> DataFrame:
    return quality.findings(table(spark, root, "sections"))


def p1_statistics(spark: SparkSession, root: str) -> DataFrame:
    return quality.statistics(table(spark, root, "sections"))


def p1_ratios(spark: SparkSession, root: str) -> DataFrame:
    """The counts and ratios of the statistics."""
    from ledgerloom.functions.scalars import round_half_away

    s = quality.statistics(table(spark, root, "sections"))
    return s.select("section_id", "n_chars", "n_solid", "n_words", "n_lines", *[round_half_away(F.col(c), 9).alias(c) for c in ("mean_word", "symbol_ratio", "ended_lines")])


def p2_found(spark: SparkSession, root: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, root, "sections"))


def p2_groups(spark: SparkSession, root: str) -> DataFrame:
    return neardup.groups(table(spark, root, "sections"))


def p3_found(spark: SparkSession, root: str) -> DataFrame:
    return sitelines.recurring_line_places(table(spark, root, "sections"), table(spark, root, "filings"))


def p3_cleaned(spark: SparkSession, root: str) -> DataFrame:
    out = sitelines.without_recurring_lines(table(spark, root, "sections"), table(spark, root, "filings"))
    return out.select("section_id", F.length("text").cast("bigint").alias("n_chars"), F.col("n_removed").cast("bigint").alias("n_removed"))


def p4_found(spark: SparkSession, root: str) -> DataFrame:
    return spans.shared_pairs(table(spark, root, "sections"))


def p4_shares(spark: SparkSession, root: str) -> DataFrame:
    return spans.shared_amounts(table(spark, root, "sections"))


def p5_found(spark: SparkSession, root: str) -> DataFrame:
    return splitting.audit(table(spark, root, "chunks"), table(spark, root, "sections"))


def p5_pieces(spark: SparkSession, root: str) -> DataFrame:
    return splitting.split_sections(table(spark, root, "sections"))


def p7_ids(spark: SparkSession, root: str) -> DataFrame:
    return bpe.encode_documents(table(spark, root, "documents"))


def p8_found(spark: SparkSession, root: str) -> DataFrame:
    return leaks.leaks(table(spark, root, "documents"), table(spark, root, "eval_cases")).select("doc_id", "case_id").distinct()


def p8_runs(spark: SparkSession, root: str) -> DataFrame:
    runs = leaks.leaks(table(spark, root, "documents"), table(spark, root, "eval_cases"))
    return runs.groupBy("case_id").agg(
        F.countDistinct("doc_id").alias("n_documents"), F.max("n_words").cast("bigint").alias("longest_run")
    )


def p9_found(spark: SparkSession, root: str) -> DataFrame:
    return langid.mislabelled(langid.document_languages(table(spark, root, "documents"))).select("doc_id", "lang").distinct()


def p9_segments(spark: SparkSession, root: str) -> DataFrame:
    return langid.segments(table(spark, root, "documents")).drop("lang_label")


_ACC = "TRY_CAST(regexp_replace(accession, '[^0-9]', '', 'g') AS BIGINT)"
_LINES = rf"""
WITH sites AS (
  SELECT DISTINCT {_ACC} AS acc, TRY_CAST(regexp_replace(cik, '[^0-9]', '', 'g') AS BIGINT) AS cik FROM filings
), sited AS (
  SELECT s.section_id, s.text, s.acc, f.cik FROM (SELECT DISTINCT section_id, text, {_ACC} AS acc FROM sections) s
  JOIN sites f ON f.acc = s.acc WHERE f.cik IS NOT NULL
), parts AS (
  SELECT cik, acc, section_id, unnest(string_split(text, chr(10))) AS raw, unnest(range(len(string_split(text, chr(10))))) AS line_no FROM sited
), lines AS (
  SELECT cik, acc, section_id, CAST(line_no AS INTEGER) AS line_no, regexp_replace(lower(raw), '[^\p{{L}}]', '', 'g') AS letters FROM parts
), marks AS (
  SELECT l.cik, l.letters FROM lines l JOIN (SELECT cik, count(DISTINCT acc) AS n FROM sited GROUP BY cik) t USING (cik)
  WHERE length(l.letters) >= 20 GROUP BY l.cik, l.letters, t.n
  HAVING count(DISTINCT l.acc) >= 5 AND count(DISTINCT l.acc) >= 0.4 * t.n
), places AS (SELECT DISTINCT section_id, line_no FROM lines JOIN marks USING (cik, letters))
"""

QUERIES = {
    f.__name__: f
    for f in (p1_found, p1_statistics, p1_ratios, p2_found, p2_groups, p3_found, p3_cleaned, p4_found, p4_shares, p5_found, p5_pieces, p7_ids, p8_found, p8_runs, p9_found, p9_segments)
}
SQL = {
    "p2_found": r"""
WITH s AS (SELECT DISTINCT section_id, lower(trim(slug)) AS slug, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM sections WHERE text IS NOT NULL),
t AS (SELECT DISTINCT section_id, slug, unnest(list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' '))) AS g FROM s WHERE len(w) >= 100),
n AS (SELECT section_id, count(*) AS n FROM t GROUP BY section_id),
c AS (SELECT a.section_id AS a, b.section_id AS b, count(*) AS k FROM t a JOIN t b ON a.g = b.g AND a.slug = b.slug AND a.section_id < b.section_id GROUP BY 1, 2)
SELECT c.a AS section_a, c.b AS section_b FROM c JOIN n x ON x.section_id = c.a JOIN n y ON y.section_id = c.b WHERE k >= 0.6 * (x.n + y.n - k)""",
    "p3_found": _LINES + "SELECT section_id, line_no FROM places",
    "p3_cleaned": _LINES
    + """, drops AS (SELECT section_id, list(line_no) AS gone FROM places GROUP BY section_id), texts AS (SELECT DISTINCT section_id, text FROM sections)
SELECT t.section_id, CAST(length(CASE WHEN d.gone IS NULL THEN t.text ELSE array_to_string(list_filter(string_split(t.text, chr(10)), lambda x, i: NOT list_contains(d.gone, i - 1)), chr(10)) END) AS BIGINT) AS n_chars,
       CAST(coalesce(len(d.gone), 0) AS BIGINT) AS n_removed
FROM texts t LEFT JOIN drops d USING (section_id)""",
    "p4_found": r"""
WITH s AS (SELECT DISTINCT section_id, regexp_replace(accession, '[^0-9]', '', 'g') AS acc, text FROM sections WHERE length(text) >= 300),
w AS (SELECT section_id, acc, md5_number(substr(text, i, 300)) AS h FROM (SELECT section_id, acc, text, unnest(range(1, length(text) - 298)) AS i FROM s)),
r AS (SELECT h FROM w GROUP BY h HAVING min(acc) <> max(acc)),
k AS (SELECT DISTINCT w.* FROM w JOIN r USING (h))
SELECT DISTINCT a.section_id AS section_a, b.section_id AS section_b FROM k a JOIN k b ON a.h = b.h AND a.acc <> b.acc AND a.section_id < b.section_id""",
    "p5_found": r"""
WITH c AS (
  SELECT DISTINCT chunk_id, ordinal, text,
         regexp_replace(split_part(section_id, ':', 1), '[^0-9]', '', 'g') || ':' || lower(trim(split_part(section_id, ':', 2))) AS k FROM chunks
), s AS (
  SELECT DISTINCT text, regexp_replace(split_part(section_id, ':', 1), '[^0-9]', '', 'g') || ':' || lower(trim(split_part(section_id, ':', 2))) AS k FROM sections
), pairs AS (
  SELECT c.chunk_id, c.text, p.text AS before FROM c JOIN c p ON p.k = c.k AND p.ordinal + 1 = c.ordinal
), placed AS (
  SELECT c.chunk_id, s.text AS t, strpos(s.text, c.text) AS a, strpos(s.text, c.text) + length(c.text) AS b FROM c JOIN s USING (k) WHERE strpos(s.text, c.text) > 0
), cut AS (
  SELECT chunk_id,
    CASE WHEN a > 1 AND regexp_matches(substr(t, a - 1, 2), '^[^\s\p{Z}\x{85}\x{1C}-\x{1F}]{2}$')
         AND length(regexp_extract(substr(t, 1, a - 1), '[^\s\p{Z}\x{85}\x{1C}-\x{1F}]*$')) + length(regexp_extract(substr(t, a), '^[^\s\p{Z}\x{85}\x{1C}-\x{1F}]*')) <= 1843 THEN TRUE ELSE FALSE END AS begins,
    CASE WHEN b <= length(t) AND regexp_matches(substr(t, b - 1, 2), '^[^\s\p{Z}\x{85}\x{1C}-\x{1F}]{2}$')
         AND length(regexp_extract(substr(t, 1, b - 1), '[^\s\p{Z}\x{85}\x{1C}-\x{1F}]*$')) + length(regexp_extract(substr(t, b), '^[^\s\p{Z}\x{85}\x{1C}-\x{1F}]*')) <= 1843 THEN TRUE ELSE FALSE END AS ends
  FROM placed
)
SELECT DISTINCT chunk_id, 'oversize' AS defect FROM c WHERE length(text) > 1843
UNION SELECT chunk_id, 'no_overlap' FROM pairs
  WHERE NOT len(list_filter(range(40, least(length(text), length(before)) + 1), lambda n: right(before, n) = left(text, n))) > 0
UNION SELECT chunk_id, 'cut_word' FROM cut WHERE begins OR ends""",
    "p8_found": r"""
WITH cases AS (
  SELECT DISTINCT case_id, unnest([variables['section_text'], variables['current_text'], variables['prior_text']]) AS passage FROM eval_cases
), cw AS (SELECT case_id, regexp_extract_all(lower(passage), '[\p{L}\p{N}]+') AS w FROM cases WHERE passage IS NOT NULL),
cg AS (SELECT DISTINCT case_id, unnest(list_transform(range(1, len(w) - 11), lambda i: array_to_string(w[i:i + 12], ' '))) AS g FROM cw WHERE len(w) >= 13),
dw AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM documents WHERE text IS NOT NULL),
dg AS (SELECT doc_id, unnest(list_transform(range(1, len(w) - 11), lambda i: array_to_string(w[i:i + 12], ' '))) AS g FROM dw WHERE len(w) >= 13)
SELECT DISTINCT doc_id, case_id FROM dg JOIN cg USING (g)""",
}

_SHINGLED = SQL["p2_found"].rpartition("SELECT c.a AS")[0]
_BLANK = r"\s\p{Z}\x{85}\x{1C}-\x{1F}\x{0B}"
SQL |= {
    "p1_ratios": rf"""
WITH w AS (SELECT section_id, text, length(regexp_replace(text, '[{_BLANK}]+', '', 'g')) AS solid, regexp_extract_all(text, '[\p{{L}}\p{{N}}]+') AS ws,
  list_filter(list_transform(string_split(text, chr(10)), lambda x: regexp_replace(x, '[{_BLANK}]+$', '')), lambda x: x <> '') AS ls FROM sections),
r AS (SELECT *, list_sum(list_transform(ws, lambda x: length(x)))::DOUBLE AS l, len(list_filter(ls, lambda x: regexp_matches(x, '[.!?。！？:;]$'))) AS e FROM w)
SELECT section_id, length(text)::BIGINT AS n_chars, CASE WHEN text IS NOT NULL THEN solid END::BIGINT AS n_solid, len(ws)::BIGINT AS n_words, len(ls)::BIGINT AS n_lines,
  CASE WHEN len(ws) > 0 THEN floor(l / len(ws) * 1e9::DOUBLE + 0.5::DOUBLE) / 1e9::DOUBLE END AS mean_word,
  CASE WHEN solid > 0 THEN floor((solid - coalesce(l, 0)) / solid * 1e9::DOUBLE + 0.5::DOUBLE) / 1e9::DOUBLE END AS symbol_ratio,
  CASE WHEN solid > 0 THEN floor(e / len(ls) * 1e9::DOUBLE + 0.5::DOUBLE) / 1e9::DOUBLE END AS ended_lines FROM r""",
    "p2_groups": _SHINGLED.replace("WITH s AS", "WITH RECURSIVE s AS", 1)
    + """, e AS (SELECT c.a, c.b FROM c JOIN n x ON x.section_id = c.a JOIN n y ON y.section_id = c.b WHERE k >= 0.6 * (x.n + y.n - k)),
both_ways AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
reach AS (SELECT a, b FROM both_ways UNION SELECT r.a, w.b FROM reach r JOIN both_ways w ON w.a = r.b),
kind AS (SELECT section_id, md5(array_to_string(list_sort(list(g)), chr(1))) AS k FROM t GROUP BY section_id),
links AS (SELECT w.a, count(DISTINCT y.k) AS n FROM both_ways w JOIN kind x ON x.section_id = w.a JOIN kind y ON y.section_id = w.b WHERE x.k <> y.k GROUP BY w.a)
SELECT n.section_id, least(n.section_id, min(r.b)) AS group_id, coalesce(max(l.n), 0)::BIGINT AS n_links FROM n LEFT JOIN reach r ON r.a = n.section_id LEFT JOIN links l ON l.a = n.section_id GROUP BY n.section_id""",
    "p4_shares": r"""
WITH s AS (SELECT DISTINCT section_id, regexp_replace(accession, '[^0-9]', '', 'g') AS acc, text FROM sections WHERE length(text) >= 300),
w AS (SELECT section_id, acc, i, md5_number(substr(text, i, 300)) AS h FROM (SELECT section_id, acc, text, unnest(range(1, length(text) - 298)) AS i FROM s)),
r AS (SELECT h FROM w GROUP BY h HAVING min(acc) <> max(acc)),
k AS (SELECT section_id, i, lead(i) OVER (PARTITION BY section_id ORDER BY i) AS after FROM w JOIN r USING (h)),
c AS (SELECT section_id, sum(least(300, coalesce(after - i, 300)))::BIGINT AS n FROM k GROUP BY section_id)
SELECT section_id, max(coalesce(length(text), 0))::BIGINT AS n_chars, coalesce(max(n), 0)::BIGINT AS n_shared FROM sections LEFT JOIN c USING (section_id) WHERE section_id IS NOT NULL GROUP BY section_id""",
    "p5_pieces": rf"""
WITH RECURSIVE s AS (SELECT DISTINCT section_id, text FROM sections WHERE regexp_matches(text, '[^{_BLANK}]')),
tok AS (SELECT section_id, text, regexp_extract_all(text, '[^{_BLANK}]+|[{_BLANK}]+') AS ts FROM s),
pos AS (SELECT section_id, unnest(ts) AS x, generate_subscripts(ts, 1) AS n FROM tok),
run AS (SELECT section_id, x, n, sum(length(x)) OVER (PARTITION BY section_id ORDER BY n) AS b, lag(x) OVER (PARTITION BY section_id ORDER BY n) AS before FROM pos),
gap AS (SELECT section_id, list({{'e': b - length(x), 's': b, 'k': CASE WHEN length(x) - length(replace(x, chr(10), '')) >= 2 THEN 4 WHEN contains(x, chr(10)) THEN 3 WHEN regexp_matches(before, '[.!?。！？]$') THEN 2 ELSE 1 END}} ORDER BY n) AS gs FROM run WHERE regexp_matches(x, '^[{_BLANK}]') GROUP BY section_id),
own AS (SELECT s.section_id, s.text, coalesce(gs, []) AS gs, length(text) - length(regexp_replace(text, '^[{_BLANK}]+', '')) AS first, length(regexp_replace(text, '[{_BLANK}]+$', '')) AS last FROM s LEFT JOIN gap USING (section_id)),
step AS (
  SELECT section_id, text, gs, last, 0 AS n, first::BIGINT AS a, CASE WHEN last - first <= 1843 THEN last ELSE coalesce(list_last(list_sort(list_transform(list_filter(gs, lambda g: g.e >= first + 921 AND g.e <= first + 1843), lambda g: [g.k, g.e])))[2], first + 1843) END::BIGINT AS b FROM own
  UNION ALL
  SELECT section_id, text, gs, last, n + 1, nx, CASE WHEN last - nx <= 1843 THEN last ELSE coalesce(list_last(list_sort(list_transform(list_filter(gs, lambda g: g.e >= nx + 921 AND g.e <= nx + 1843), lambda g: [g.k, g.e])))[2], nx + 1843) END::BIGINT
  FROM (SELECT *, coalesce(list_last(list_sort(list_transform(list_filter(gs, lambda g: g.s >= b - 230 AND g.s <= b - 40), lambda g: [g.k, g.s])))[2], b - 230)::BIGINT AS nx FROM step WHERE b < last)
)
SELECT section_id, n::INTEGER AS ordinal, a::INTEGER AS start, substr(text, a + 1, b - a) AS text, CAST(greatest(1, round_even((b - a) / 3.6::DOUBLE, 0)) AS INTEGER) AS token_estimate FROM step""",
    "p8_runs": r"""
WITH cases AS (SELECT DISTINCT case_id, unnest([variables['section_text'], variables['current_text'], variables['prior_text']]) AS passage FROM eval_cases),
cw AS (SELECT case_id, hash(passage) AS p, regexp_extract_all(lower(passage), '[\p{L}\p{N}]+') AS w FROM cases WHERE passage IS NOT NULL),
cg AS (SELECT case_id, p, unnest(range(1, len(w) - 11)) AS i, unnest(list_transform(range(1, len(w) - 11), lambda i: array_to_string(w[i:i + 12], ' '))) AS g FROM cw WHERE len(w) >= 13),
dw AS (SELECT DISTINCT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM documents WHERE text IS NOT NULL),
dg AS (SELECT doc_id, unnest(range(1, len(w) - 11)) AS i, unnest(list_transform(range(1, len(w) - 11), lambda i: array_to_string(w[i:i + 12], ' '))) AS g FROM dw WHERE len(w) >= 13),
m AS (SELECT doc_id, case_id, p, dg.i - cg.i AS diagonal, dg.i FROM dg JOIN cg USING (g)),
r AS (SELECT *, i - row_number() OVER (PARTITION BY doc_id, case_id, p, diagonal ORDER BY i) AS island FROM m),
n AS (SELECT doc_id, case_id, count(*) + 12 AS n FROM r GROUP BY doc_id, case_id, p, diagonal, island)
SELECT case_id, count(DISTINCT doc_id) AS n_documents, max(n)::BIGINT AS longest_run FROM n GROUP BY case_id""",
}


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
