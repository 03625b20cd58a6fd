"""Raw filings to sections and chunks, each filing for itself: a failure marks its own filing only."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions import documents, scalars
from ledgerloom.operators import units

_PARSED = "struct<text_length:int,error:string,sections:array<struct<slug:string,heading:string,ordinal:int,text:string,is_fallback:boolean>>>"


def _parse(html: str | None, form: str | None) -> dict:
    try:
        text = documents.html_to_text(html) or ""
        if not text:
            raise ValueError("the document has no text")
        return {"text_length": len(text), "error": None, "sections": [vars(s) for s in documents.split_sections(text, form)]}
    except Exception as e:
        return {"text_length": 0, "error": f"{type(e).__name__}: {e}"[:500], "sections": []}


def parsed(raw: DataFrame) -> DataFrame:
    """raw (accession, cik, form, html) with `parsed`: text length, error and sections, and coverage and issues of each.

    HTML is parsed once per row of the result: persist or write what is used more than once.
    """
    from pyspark.sql.pandas.types import to_arrow_type
    from pyspark.sql.types import _parse_datatype_string

    kind = to_arrow_type(_parse_datatype_string(_PARSED))

    def parse(html: pa.Array, form: pa.Array) -> pa.Array:
        return pa.array([_parse(*x) for x in zip(html.to_pylist(), form.to_pylist())], kind)

    rows = raw.withColumn("parsed", F.arrow_udf(parse, _PARSED)("html", "form")).drop("html")
    found = F.col("parsed.sections")
    covered = F.aggregate(found, F.lit(0), lambda n, s: n + F.length(s["text"]))
    coverage, issues = units.assessment(F.col("form"), F.col("parsed.text_length"), covered, F.transform(found, lambda s: s["slug"]), F.forall(found, lambda s: s["is_fallback"]))
    return rows.withColumn("parsed", F.col("parsed").withField("coverage", coverage).withField("issues", issues))


def sections_of(filings: DataFrame) -> DataFrame:
    """(section_id, accession, slug, heading, ordinal, char_len, text)"""
    rows = filings.filter(F.col("parsed.error").isNull()).select("accession", F.explode("parsed.sections").alias("s"))
    return rows.select(
        F.concat_ws(":", "accession", "s.slug").alias("section_id"), "accession", "s.slug", "s.heading", "s.ordinal", F.length("s.text").alias("char_len"), "s.text"
    )


def chunks_of(sections: DataFrame, filings: DataFrame) -> DataFrame:
    """(chunk_id, section_id, accession, cik, ordinal, token_estimate, text)"""
    rows = sections.join(filings.select("accession", "cik"), "accession").select(
        "section_id", "accession", "cik", F.explode(documents.columns()["chunk_text"](F.col("text"), F.lit(512), F.lit(64), F.lit(32))).alias("c")
    )
    return rows.select(
        F.concat_ws(":", "section_id", F.col("c.ordinal").cast("string")).alias("chunk_id"), "section_id", "accession", "cik", F.col("c.ordinal").alias("ordinal"),
        scalars.token_estimate(F.col("c.text")).alias("token_estimate"), F.col("c.text").alias("text"),
    )


def skipped(filings: DataFrame) -> DataFrame:
    return filings.filter(F.col("parsed.error").isNotNull()).select("accession", F.col("parsed.error").alias("reason"))


def flagged(filings: DataFrame) -> DataFrame:
    """Filings whose parsing raises an issue; those that could not be parsed at all are skipped ones."""
    return filings.filter(F.col("parsed.error").isNull() & (F.size("parsed.issues") > 0)).select("accession", "form", F.array_join("parsed.issues", ";").alias("reason"), "parsed.coverage")


def parse_reviews(filings: DataFrame) -> DataFrame:
    """Rows of the review queue, one per flagged filing; what was found stands in `proposed` as JSON."""
    held = flagged(filings)
    proposed = F.to_json(F.struct("accession", "form", scalars.round_half_away(F.col("coverage"), 3).alias("section_coverage"), F.split("reason", ";").alias("parse_issues")))
    return held.select(
        F.concat(F.lit("parse:"), "accession").alias("review_id"), F.lit("").alias("extraction_id"), F.lit("ingest_parse").alias("task"), F.lit("invalid").alias("reason"),
        F.lit(5).alias("priority"), F.lit("open").alias("status"), proposed.alias("proposed"),
    )


def report(filings: DataFrame, sections: DataFrame, chunks: DataFrame) -> DataFrame:
    """One row of counts over an ingest."""
    return (
        filings.agg(F.countDistinct("cik").alias("companies"), F.count(F.lit(1)).alias("filings"), F.count("parsed.error").alias("skipped"), F.count_if(F.col("parsed.error").isNull() & (F.size("parsed.issues") > 0)).alias("flagged"))
        .crossJoin(sections.agg(F.count(F.lit(1)).alias("sections")))
        .crossJoin(chunks.agg(F.count(F.lit(1)).alias("chunks")))
    )
