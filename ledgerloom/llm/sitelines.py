"""Lines that come back in filing after filing of one company.

A line's documents are a compressed bitmap per site: an accession's eighteen digits are its bit number, cut into 64-bit
words of which only the filled ones are kept (filings of one agent and year lie side by side). Raw lines whose letters
are the same are variants of one line; their words are united with bit_or, and the set bits of a line are its exact
count of filings, held against the site's own bitmap. Marking and deleting look lines up in what passed.

A line's words are combined on the map side, so that neither a hot site nor a hot line gathers rows in one task.

Nulls: a section without text has no lines but counts its filing for the site. Sections whose accession has not
eighteen digits, or whose filing is missing or without a cik number, belong to no site. Repeated rows change nothing.
If a filing was fetched with two ciks it belongs to both sites. Extra columns are ignored; empty tables give no lines.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions import keys
from ledgerloom.plans.cut import written
from ledgerloom.plans.once import once

MIN_LETTERS = 20
MIN_FILINGS = 5
MIN_SHARE = 0.4


def letters(line: Column) -> Column:
    """What two lines are compared by: their letters, lower-cased."""
    return F.regexp_replace(F.lower(line), r"[^\p{L}]+", "")


def sites(filings: DataFrame) -> DataFrame:
    """(acc, cik): the site of each filing."""
    rows = filings.select(keys.accession_number(F.col("accession")).alias("acc"), keys.cik_number(F.col("cik")).alias("cik"))
    return rows.filter(F.col("acc").isNotNull() & F.col("cik").isNotNull()).distinct()


def hashed_lines(sections: DataFrame, min_letters: int = MIN_LETTERS) -> DataFrame:
    """(acc, section_id, line_no, line): one row per line that is long enough, line being a hash of its letters."""
    own = sections.select("section_id", "text", keys.accession_number(F.col("accession")).alias("acc")).filter(F.col("acc").isNotNull())
    lines = own.select("acc", "section_id", F.posexplode(F.split("text", "\n")).alias("line_no", "raw"))
    said = lines.filter(F.length("raw") >= min_letters).withColumn("letters", letters(F.col("raw")))
    return said.filter(F.length("letters") >= min_letters).select("acc", "section_id", "line_no", F.xxhash64("letters").alias("line"))


def _word() -> Column:
    return F.shiftright(F.col("acc"), 6)


def _bits() -> Column:
    return F.bit_or(F.expr("shiftleft(1L, cast(acc & 63 as int))"))


def recurring(lines: DataFrame, sections: DataFrame, filings: DataFrame, min_filings: int = MIN_FILINGS, min_share: float = MIN_SHARE) -> DataFrame:
    """(cik, line, n_filings, n_site): the lines of each site that stand in enough of its filings. lines: hashed_lines().

    Hashes of lines are joined to their sites, not texts.
    """
    own = sites(filings)
    words = lines.select("acc", "line").join(own, "acc").groupBy("cik", "line", _word().alias("word")).agg(_bits().alias("bits"))
    counts = words.groupBy("cik", "line").agg(F.sum(F.bit_count("bits")).alias("n_filings")).filter(F.col("n_filings") >= min_filings)
    held = sections.select(keys.accession_number(F.col("accession")).alias("acc")).distinct().join(own, "acc").groupBy("cik", _word().alias("word")).agg(_bits().alias("bits"))
    totals = held.groupBy("cik").agg(F.sum(F.bit_count("bits")).alias("n_site"))
    return counts.join(totals, "cik").filter(F.col("n_filings") >= F.lit(min_share) * F.col("n_site"))


def recurring_line_places(sections: DataFrame, filings: DataFrame, min_letters: int = MIN_LETTERS, **limits) -> DataFrame:
    """(section_id, line_no): every place of every recurring line, each once; line_no counts from 0."""
    # texts are cut into lines and hashed once; both tables are written, so that their sizes are known to the joins
    lines = written(hashed_lines(sections, min_letters), "site-line-hashes")
    marks = written(recurring(lines, sections, filings, **limits).select("cik", "line"), "site-lines")
    return lines.join(sites(filings), "acc").join(marks, ["cik", "line"], "left_semi").select("section_id", "line_no").distinct()


def without_recurring_lines(sections: DataFrame, filings: DataFrame, **limits) -> DataFrame:
    """(section_id, text, n_removed): each section's text without its recurring lines; a null text stays null.

    Rows repeated with one section_id give one row.
    """
    places = recurring_line_places(sections, filings, **limits).groupBy("section_id").agg(F.collect_set("line_no").alias("drop"))  # of one text
    kept = F.expr("array_join(filter(split(text, '\n'), (x, i) -> not array_contains(drop, i)), '\n')")
    return once(sections.select("section_id", "text")).join(places, "section_id", "left").select(
        "section_id",
        F.when(F.col("drop").isNull(), F.col("text")).otherwise(kept).alias("text"),
        F.when(F.col("drop").isNull(), 0).otherwise(F.size("drop")).alias("n_removed"),
    )
