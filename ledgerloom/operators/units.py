"""Units of text for extraction: sections with their filing and company, compared with their predecessors, or joined."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom import schemas
from ledgerloom.functions import scalars


def period() -> Column:
    """The day a filing reports on, or else the day it was filed."""
    return F.coalesce("report_date", "filing_date")


def with_filings(sections: DataFrame, filings: DataFrame, companies: DataFrame) -> DataFrame:
    """sections joined to their filing and company by equal keys; sections without either are left out.

    filings and companies must have one row per key (see latest()).
    """
    f = filings.select("accession", "cik", "form", "filing_date", "report_date", "items")
    c = companies.select("cik", "ticker", "name")
    return sections.select("section_id", "accession", "slug", "heading", "ordinal", "text").join(f, "accession").join(c, "cik")


def latest(rows: DataFrame, key: str, at: str = "fetched_at") -> DataFrame:
    """One row per key, the last fetched one; of equal times the greatest row by all its columns."""
    rest = [c for c in rows.columns if c != key]
    order = F.struct(F.coalesce(F.col(at).cast("string"), F.lit("")), F.to_json(F.struct(*rest)))
    return rows.groupBy(key).agg(F.max_by(F.struct(*rest), order).alias("r")).select(key, "r.*").select(*rows.columns)


def guidance_units(sections: DataFrame, filings: DataFrame, companies: DataFrame, slugs=("mdna", "results_of_operations"), tokens: int = 8000) -> DataFrame:
    """(section_id, accession, cik, ticker, name, form, period, section_text, filing_date): sections that may hold guidance."""
    rows = with_filings(sections.filter(F.col("slug").isin(*slugs)), filings, companies)
    return rows.select(
        "section_id", "accession", "cik", "ticker", "name", "form", period().alias("period"), scalars.fitted_text(F.col("text"), tokens).alias("section_text"), "filing_date"
    )


def risk_pairs(sections: DataFrame, filings: DataFrame, companies: DataFrame, slug: str = "risk_factors", forms=("10-K", "10-Q"), tokens: int = 8000) -> DataFrame:
    """Each section of one kind beside the one before it of the same company and form.

    (section_id, accession, cik, name, form, current_period, prior_period, current_text, prior_text, filing_date); the first of each has no
    row. Filings of one day are ordered by accession.
    """
    rows = with_filings(sections.filter(F.col("slug") == slug), filings.filter(F.col("form").isin(*forms)), companies)
    # texts are cut to their budgets before they are shuffled to the window
    current, prior = (scalars.fitted_text(F.col("text"), int(tokens * part)) for part in (0.6, 0.4))
    rows = rows.select("section_id", "accession", "cik", "name", "form", "filing_date", period().alias("current_period"), current.alias("current_text"), prior.alias("as_prior"))
    w = Window.partitionBy("cik", "form").orderBy(F.col("filing_date").asc_nulls_last(), "accession", "section_id")
    pairs = rows.withColumn("prior_text", F.lag("as_prior").over(w)).withColumn("prior_period", F.lag("current_period").over(w))
    return pairs.filter(F.col("prior_text").isNotNull()).select(
        "section_id", "accession", "cik", "name", "form", "current_period", "prior_period", "current_text", "prior_text", "filing_date"
    )


def event_units(sections: DataFrame, filings: DataFrame, companies: DataFrame, form: str = "8-K", tokens: int = 6000) -> DataFrame:
    """(accession, cik, name, items, filing_date, section_text): the sections of each current report, in order, as one text.

    A section without a heading is left out, as its part is null.
    """
    rows = with_filings(sections, filings.filter(F.col("form") == form), companies)
    part = F.concat(F.col("heading"), F.lit("\n"), F.col("text"))
    joined = rows.groupBy("accession", "cik", "name", "items", "filing_date").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.when(part.isNotNull(), F.struct("ordinal", "section_id", part.alias("part"))))), lambda x: x["part"]), "\n\n").alias("all")
    )
    return joined.select("accession", "cik", "name", F.coalesce("items", F.lit("(none reported)")).alias("items"), "filing_date", scalars.fitted_text(F.col("all"), tokens).alias("section_text"))


def longest_per_name(parts: DataFrame, document: str = "accession") -> DataFrame:
    """Of the sections of one name in a document the longest, the first of equals; ordinals are counted anew."""
    best = Window.partitionBy(document, "slug").orderBy(F.length("text").desc_nulls_last(), F.col("ordinal").asc_nulls_last())
    again = Window.partitionBy(document).orderBy(F.col("ordinal").asc_nulls_last(), "slug")
    kept = parts.withColumn("best", F.row_number().over(best)).filter("best = 1").drop("best")
    return kept.withColumn("ordinal", F.row_number().over(again) - 1)


def assessment(form: Column, n_chars: Column, covered: Column, slugs: Column, fallback: Column) -> tuple[Column, Column]:
    """(coverage, issues) of a filing whose sections cover so much of its text. fallback: there is no named section."""
    share = F.coalesce(F.least(F.lit(1.0), F.coalesce(covered, F.lit(0)) / F.greatest(n_chars, F.lit(1))), F.lit(0.0))
    name = F.upper(form)
    least = F.coalesce(*[F.when(name == f, F.lit(v)) for f, v in schemas.LEAST_COVERAGE.items()], F.lit(schemas.OTHER_COVERAGE))
    hundredths = F.floor(share * 100 + 0.5).cast("int")
    low = F.concat(F.lit("low_coverage_"), (hundredths / 100).cast("int"), F.lit("."), F.lpad((hundredths % 100).cast("string"), 2, "0"))
    key = F.arrays_overlap(slugs, F.array(*map(F.lit, schemas.KEY_SECTIONS)))
    issues = F.array_compact(
        F.array(F.when(fallback, "no_sections_detected"), F.when(share < least, low), F.when(name.isin("10-K", "10-Q") & ~F.coalesce(key, F.lit(False)), "missing_key_sections"))
    )
    return share, issues


def coverage(sections: DataFrame, sizes: DataFrame) -> DataFrame:
    """(accession, coverage, slugs, issues) of each filing. sizes: (accession, form, n_chars). Without sections nothing is covered."""
    per = sections.groupBy("accession").agg(F.sum(F.length("text")).alias("covered"), F.array_sort(F.collect_set("slug")).alias("slugs"))
    slugs = F.coalesce("slugs", F.array().cast("array<string>"))
    share, issues = assessment(F.col("form"), F.col("n_chars"), F.col("covered"), slugs, F.size(slugs) == 0)
    return sizes.join(per, "accession", "left").select("accession", share.alias("coverage"), slugs.alias("slugs"), issues.alias("issues"))


def before_gap(matches: DataFrame, document: str, gap: int) -> DataFrame:
    """The leading matches of each document that follow each other within a gap. matches: (document, start)."""
    w = Window.partitionBy(document).orderBy("start")
    far = F.when(F.coalesce(F.lead("start").over(w) - F.col("start"), F.lit(gap)) >= gap, 1).otherwise(0)
    return matches.withColumn("far", far).withColumn("passed", F.sum("far").over(w.rowsBetween(Window.unboundedPreceding, 0))).filter("passed = 0").drop("far", "passed")
