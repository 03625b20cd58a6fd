"""The warehouse's tables as Spark schemas, their keys, and the vocabularies and constants that results depend on."""

from __future__ import annotations

from pyspark.sql import types as T

_KINDS = {"s": T.StringType(), "i": T.IntegerType(), "l": T.LongType(), "d": T.DoubleType(), "b": T.BooleanType(), "D": T.DateType(), "t": T.TimestampType(), "v": T.ArrayType(T.FloatType())}


def _schema(text: str) -> T.StructType:
    """name:kind pairs; a '!' marks a field that may not be null."""
    fields = []
    for part in text.split():
        name, kind = part.split(":")
        fields.append(T.StructField(name, _KINDS[kind[0]], not kind.endswith("!")))
    return T.StructType(fields)


TABLES: dict[str, T.StructType] = {
    "companies": _schema("cik:s! ticker:s name:s! sic:s sic_description:s exchange:s fetched_at:t"),
    "filings": _schema("accession:s! cik:s! form:s! filing_date:D! report_date:D items:s primary_doc:s url:s size_bytes:l fetched_at:t"),
    "sections": _schema("section_id:s! accession:s! slug:s! heading:s ordinal:i char_len:i text:s!"),
    "chunks": _schema("chunk_id:s! section_id:s! accession:s! cik:s! ordinal:i! token_estimate:i text:s!"),
    "embeddings": _schema("chunk_id:s! model:s! dim:i! vec:v! created_at:t"),
    "extractions": _schema(
        "extraction_id:s! task:s! accession:s! cik:s! section_id:s prompt_name:s! prompt_version:s! prompt_hash:s! model:s! provider:s! config_hash:s "
        "payload:s! valid:b! repair_attempts:i grounded_ratio:d tokens_in:l tokens_out:l cost_usd:d latency_ms:d cached:b error:s created_at:t"
    ),
    "signals": _schema(
        "signal_id:s! name:s! cik:s! ticker:s accession:s! as_of:D! score:d! confidence:d direction:s rationale:s evidence:s extraction_ids:s pipeline_version:s created_at:t"
    ),
    "alerts": _schema("alert_id:s! signal_id:s! rule:s! severity:s! headline:s! detail:s created_at:t"),
    "traces": _schema(
        "span_id:s! trace_id:s! parent_id:s name:s! kind:s status:s started_at:t duration_ms:d model:s provider:s tokens_in:l tokens_out:l cost_usd:d cached:b attrs:s error:s"
    ),
    "eval_runs": _schema(
        "run_id:s! suite:s! task:s! model:s! provider:s! prompt_name:s prompt_version:s prompt_hash:s n_cases:i metrics:s! git_sha:s started_at:t duration_s:d total_cost_usd:d notes:s"
    ),
    "eval_results": _schema("result_id:s! run_id:s! case_id:s! expected:s actual:s correct:b scores:s latency_ms:d cost_usd:d error:s"),
    "review_queue": _schema("review_id:s! extraction_id:s! task:s! reason:s! priority:i status:s proposed:s verdict:s reviewer:s created_at:t resolved_at:t"),
    "llm_cache": _schema("key:s! provider:s model:s response:s created_at:t hits:l"),
}

KEYS: dict[str, tuple[str, ...]] = {
    "companies": ("cik",), "filings": ("accession",), "sections": ("section_id",), "chunks": ("chunk_id",), "embeddings": ("chunk_id", "model"),
    "extractions": ("extraction_id",), "signals": ("signal_id",), "alerts": ("alert_id",), "traces": ("span_id",), "eval_runs": ("run_id",),
    "eval_results": ("result_id",), "review_queue": ("review_id",), "llm_cache": ("key",),
}

#: Tables that ad-hoc SQL may read.
READABLE = ("companies", "filings", "sections", "chunks", "extractions", "signals", "alerts", "traces", "eval_runs", "eval_results")

# Characters per token, chunk and overlap sizes in tokens.
CHARS_PER_TOKEN = 3.6
CHUNK_TOKENS, CHUNK_OVERLAP, CHUNK_LEAST = 512, 64, 32

# Words that a keyword query leaves out.
STOP_WORDS = frozenset(
    "a an and are as at be by for from has have in is it its of on or that the to was were will with what which how why when do does did about".split()
)

# Section names by heading, tried in this order.
TITLE_SLUGS = (
    (r"risk factors", "risk_factors"),
    (r"unresolved staff comments", "unresolved_staff_comments"),
    (r"management.s discussion and analysis", "mdna"),
    (r"quantitative and qualitative disclosures? about market risk", "market_risk"),
    (r"controls and procedures", "controls_and_procedures"),
    (r"legal proceedings", "legal_proceedings"),
    (r"financial statements and supplementary data", "financial_statements"),
    (r"financial statements", "financial_statements"),
    (r"market for (the )?registrant", "market_for_equity"),
    (r"^business$", "business"),
    (r"^properties$", "properties"),
    (r"other information", "other_information"),
    (r"^exhibits", "exhibits"),
    (r"mine safety", "mine_safety"),
)
# Section names by item number of annual and quarterly reports.
ANNUAL_ITEMS = {
    "1": "business", "1a": "risk_factors", "1b": "unresolved_staff_comments", "2": "properties", "3": "legal_proceedings", "5": "market_for_equity",
    "7": "mdna", "7a": "market_risk", "8": "financial_statements", "9a": "controls_and_procedures",
}
# Section names by item code of current reports.
CURRENT_ITEMS = {
    "1.01": "material_agreement", "1.03": "bankruptcy", "2.01": "completed_acquisition", "2.02": "results_of_operations", "2.05": "exit_or_disposal_costs",
    "2.06": "material_impairment", "3.01": "delisting_notice", "4.01": "auditor_change", "4.02": "non_reliance_on_financials",
    "5.02": "director_officer_change", "7.01": "reg_fd_disclosure", "8.01": "other_events",
}
# Tags that begin a new line.
BLOCK_TAGS = frozenset(
    "p div br hr table tr td th tbody thead h1 h2 h3 h4 h5 h6 li ul ol dl dt dd section article header footer blockquote pre body".split()
)
# Share of a filing's text that its sections must cover, by form; others need the last one.
LEAST_COVERAGE = {"10-K": 0.60, "10-Q": 0.60, "8-K": 0.10}
OTHER_COVERAGE = 0.30
KEY_SECTIONS = ("mdna", "risk_factors")

# Words that the heuristic reader counts as good or bad news.
GOOD_WORDS = (
    "growth", "grew", "increase", "increased", "record", "raised", "raising", "beat", "exceeded", "expansion", "accelerat", "margin improvement", "tailwind",
    "strong demand", "upgrade", "buyback", "dividend increase",
)
BAD_WORDS = (
    "decline", "declined", "decrease", "withdrew", "withdrawn", "impairment", "material weakness", "going concern", "restructuring", "layoff", "shortfall", "miss",
    "headwind", "litigation", "investigation", "downgrade", "delay", "weaker", "lowered", "cut", "loss", "adverse",
)
# Labels that a heuristic reader takes for bad, good and middling news, in this order.
BAD_LABELS = ("bearish", "negative", "deteriorating", "lowered", "high", "down")
GOOD_LABELS = ("bullish", "positive", "improving", "raised", "low", "up")
MIDDLING_LABELS = ("neutral", "unchanged", "stable", "medium", "flat")
