"""Key columns compared by meaning: ciks by number, accessions by digits, sections by accession and slug."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What counts as white space, as a class of Java's patterns: all that Unicode does.
BLANK = r"[\s\p{Z}\x85\x1c-\x1f]"


def stripped(col: Column) -> Column:
    """The text without outer blanks of any kind; null stays null."""
    return F.regexp_replace(col, rf"^{BLANK}+|{BLANK}+$", "")


def given(col: Column) -> Column:
    """True where a reference says anything at all: neither null nor blank."""
    return F.coalesce(F.length(stripped(col)) > 0, F.lit(False))


def digits(col: Column) -> Column:
    return F.regexp_replace(col, "[^0-9]", "")


def cik_number(col: Column) -> Column:
    """The cik's number as a long; null if the text holds no digits or too many."""
    return digits(col).try_cast("bigint")


def accession_number(col: Column) -> Column:
    """The eighteen digits of an accession as a long; null if there are not exactly eighteen."""
    d = digits(col)
    return F.when(F.length(d) == 18, d.try_cast("bigint"))


def slug(col: Column) -> Column:
    return F.lower(stripped(col))


def cik_key(col: Column) -> Column:
    """A comparable cik: its number, or the text itself where no number can be read."""
    return F.coalesce(cik_number(col).cast("string"), F.concat(F.lit("?"), stripped(col)))


def accession_key(col: Column) -> Column:
    d = digits(col)
    return F.when(F.length(d) == 18, d).otherwise(F.concat(F.lit("?"), stripped(col)))


def section_key(col: Column) -> Column:
    """accession digits, a colon, and the slug without case and outer blanks."""
    return F.concat(accession_key(F.substring_index(col, ":", 1)), F.lit(":"), slug(F.substring_index(col, ":", -1)))
