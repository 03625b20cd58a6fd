"""Scalar functions as Column expressions: all of them stay inside the JVM."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgerloom import schemas
from ledgerloom.functions.keys import BLANK, stripped


def round_half_away(x: Column, places: int) -> Column:
    """Rounded half away from zero in binary arithmetic, as other SQL engines do; null stays null."""
    p = 10.0**places
    return F.signum(x) * F.floor(F.abs(x) * p + 0.5) / p


def token_estimate(text: Column) -> Column:
    """max(1, round half even (characters / 3.6))."""
    return F.greatest(F.lit(1), F.rint(F.length(text) / schemas.CHARS_PER_TOKEN).cast("int"))


def approx_tokens(text: Column) -> Column:
    """A fourth of the characters, at least one."""
    return F.greatest(F.lit(1), F.floor(F.length(text) / 4).cast("int"))


def cik_padded(text: Column) -> Column:
    """Ten digits: of digits alone, after the letters CIK, or of a run of six and more; else null. Longer ones stay whole."""
    t = F.trim(text)
    found = F.coalesce(F.nullif(F.regexp_extract(t, r"^(?i:cik)?\s*(\d+)$", 1), F.lit("")), F.nullif(F.regexp_extract(t, r"(\d{6,})", 1), F.lit("")))
    bare = F.regexp_replace(found, r"^0+(?=\d)", "")
    return F.when(F.length(bare) >= 10, bare).otherwise(F.lpad(bare, 10, "0"))


def iso_date(text: Column) -> Column:
    """A date of the form yyyy-MM-dd, null if empty or invalid."""
    return F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_timestamp(text, F.lit("yyyy-MM-dd")).cast("date"))


def slug_of(section_id: Column) -> Column:
    return F.substring_index(section_id, ":", -1)


def filing_url(base: str, cik: Column, accession: Column, document: Column) -> Column:
    """base/cik without leading zeros/accession without dashes/document; null if one of them is."""
    parts = (F.lit(base.rstrip("/")), cik.cast("bigint").cast("string"), F.regexp_replace(accession, "-", ""), document)
    return F.when(document.isNotNull() & cik.isNotNull() & accession.isNotNull(), F.concat_ws("/", *parts))


def stable_id(*parts: Column) -> Column:
    """The first 24 hex digits of the SHA-256 of the parts joined by bars; a null part counts as empty."""
    return F.substring(F.sha2(F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]), 256), 1, 24)


def single_spaced(text: Column) -> Column:
    """With outer white space gone and inner runs of it one blank."""
    return F.trim(F.regexp_replace(text, f"{BLANK}+", " "))


def squeezed(text: Column) -> Column:
    """Lower-cased, with outer blanks gone and inner ones single."""
    return F.lower(single_spaced(text))


def alphanumeric(text: Column) -> Column:
    return F.regexp_replace(F.lower(text), "[^a-z0-9]+", "")


def event_slug(text: Column) -> Column:
    """A type name as a slug of at most 60 characters."""
    cut = F.substring(F.regexp_replace(F.lower(F.trim(text)), "[^a-z0-9_]+", "_"), 1, 60)
    return F.regexp_replace(cut, "^_+|_+$", "")


def clamped_confidence(x: Column) -> Column:
    """Into [0, 1]; values up to 100 are taken as per cent. Null stays null."""
    return F.when(x.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.when((x > 1) & (x <= 100), x / 100).otherwise(x))))


def tidy_quotes(quotes: Column, least: int = 15, longest: int = 500, most: int = 5) -> Column:
    """Quotes with single blanks, without short ones, cut and capped."""
    clean = F.transform(quotes, single_spaced)
    return F.slice(F.transform(F.filter(clean, lambda q: F.length(q) >= least), lambda q: F.substring(q, 1, longest)), 1, most)


def tidy_list(items: Column, longest: int = 300, most: int = 10) -> Column:
    return F.slice(F.transform(items, lambda q: F.substring(single_spaced(q), 1, longest)), 1, most)


def truncated(text: Column, most: int = 4000) -> Column:
    """The text, or its beginning with a note of how many characters are left out."""
    rest = F.length(text) - most
    return F.when(rest > 0, F.concat(F.substring(text, 1, most), F.format_string("... [%d more characters]", rest))).otherwise(text)


def list_of_strings(json: Column) -> Column:
    """A JSON array of strings; an empty one where it can't be read."""
    return F.coalesce(F.from_json(json, "array<string>"), F.array().cast("array<string>"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity in double precision; null for a null, a zero vector or vectors of unlike size."""
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when((F.size(a) == F.size(b)) & (norm > 0), dot(a, b) / norm)


def query_terms(query: str, most: int = 12) -> list[tuple[str, float]]:
    """A query's distinct words of three letters and more but stop words, heaviest first, with weight 1 + ln(length)."""
    import re

    words = dict.fromkeys(w for w in re.findall(r"[a-z][a-z0-9'-]{2,}", query.lower()) if w not in schemas.STOP_WORDS)
    ranked = sorted(((w, round(1 + math.log(len(w)), 4)) for w in words), key=lambda x: -x[1])
    return ranked[:most]


def keyword_score(text: Column, terms: list[tuple[str, float]]) -> Column:
    """Sum of the weights of the terms that occur in the text, as substrings and without case."""
    low = F.lower(text)
    total = F.lit(0.0)
    for term, weight in terms:
        total = total + F.when(low.contains(term), F.lit(weight)).otherwise(F.lit(0.0))
    return total


def occurrences(text: Column, words: tuple[str, ...]) -> Column:
    """How often the words occur, as substrings that don't overlap, case left aside."""
    low = F.lower(text)
    total = F.lit(0)
    for w in words:
        total = total + ((F.length(low) - F.length(F.replace(low, F.lit(w), F.lit("")))) / len(w)).cast("int")
    return total


def leaning(text: Column, good: tuple[str, ...] = schemas.GOOD_WORDS, bad: tuple[str, ...] = schemas.BAD_WORDS) -> Column:
    """(good - bad) / (good + bad) of the word counts, in [-1, 1], rounded to 3 places; 0 without any."""
    g, b = occurrences(text, good), occurrences(text, bad)
    return F.when(g + b > 0, round_half_away((g - b) / (g + b), 3)).otherwise(F.lit(0.0))


def quoted_documents(prompt: Column) -> Column:
    """The contents of the prompt's <document> tags joined by line ends, or the whole prompt without any."""
    inner = F.regexp_extract_all(prompt, F.lit(r"(?is)<document[^>]*>(.*?)</document>"), F.lit(1))
    return F.when(F.size(inner) > 0, F.array_join(inner, "\n")).otherwise(prompt)


def telling_sentences(text: Column, leaning: Column, most: int | None = None) -> Column:
    """Sentences of middling length that hold a word of the text's leaning (a bad one below 0, else a good one), or else the
    first of middling length."""
    fit = F.filter(F.transform(F.split(text, rf"(?<=[.!?]){BLANK}+"), lambda s: stripped(s)), lambda s: (F.length(s) > 25) & (F.length(s) < 400))
    bad, good = ("|".join(words) for words in (schemas.BAD_WORDS, schemas.GOOD_WORDS))
    hit = F.when(leaning < 0, F.filter(fit, lambda s: F.lower(s).rlike(bad))).otherwise(F.filter(fit, lambda s: F.lower(s).rlike(good)))
    return F.when(F.size(hit) > 0, hit if most is None else F.slice(hit, 1, most)).otherwise(F.slice(fit, 1, 1))


def fitted_text(text: Column, tokens: int, reserve: int = 1200, least: int = 500) -> Column:
    """The text without outer blanks, or as much of its beginning as a budget of tokens allows, cut at the last paragraph,
    sentence or line end beyond three quarters of it, with a note."""
    most = int(max(tokens - reserve, least) * schemas.CHARS_PER_TOKEN)
    text = stripped(text)
    head = F.substring(text, 1, most)
    cut = F.lit(0)
    for mark in ("\n", ". ", "\n\n"):
        before = F.length(head) - F.length(F.substring_index(head, mark, -1)) - len(mark)
        cut = F.when(before > 0.75 * most, before + (1 if mark == ". " else 0)).otherwise(cut)
    kept = F.when(cut > 0, F.substring(head, F.lit(1), cut)).otherwise(head)
    return F.when(F.length(text) > most, F.concat(stripped(kept), F.lit("\n\n[truncated]"))).otherwise(text)
