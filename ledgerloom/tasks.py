"""The extraction tasks: what each reads, what its payload must be, and how a payload counts.

The vocabularies, weights and rules are what results depend on.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.operators import units
from ledgerloom.operators.extraction import PayloadSchema
from ledgerloom.operators.signals import Rule, lookup

# The words of each field, the sign of a direction, and the weight of each word.
DIRECTIONS = ("bullish", "bearish", "neutral")
CHANGES = ("raised", "lowered", "withdrawn", "reaffirmed", "none")
LEVELS = ("low", "medium", "high")
SIGN = {"bullish": 1.0, "bearish": -1.0, "neutral": 0.0}
CHANGE = {"raised": 1.0, "lowered": -1.0, "withdrawn": -0.85, "reaffirmed": 0.15}
TONE = 0.6
SEVERITY = {"low": 0.3, "medium": 0.65, "high": 1.0}
MATERIALITY = {"low": 0.25, "medium": 0.6, "high": 1.0}
WEIGHTS = {"event_class": 0.45, "guidance_tone": 0.35, "risk_delta": 0.2}
PRIORITIES = {"invalid": 9, "ungrounded": 7, "low_confidence": 3}
RULES = (
    Rule("guidance_withdrawn_or_cut", "name = 'guidance_tone' AND score <= -0.5 AND confidence >= 0.6", "'critical'", "concat(label, ': forward guidance deteriorated')"),
    Rule("material_risk_escalation", "name = 'risk_delta' AND score <= -0.55 AND confidence >= 0.55", "'warn'", "concat(label, ': risk disclosure escalated materially')"),
    Rule("high_materiality_event", "name = 'event_class' AND abs(score) >= 0.6", "CASE WHEN score < 0 THEN 'critical' ELSE 'warn' END", "concat(label, ': material ', CASE WHEN score > 0 THEN 'positive' ELSE 'negative' END, ' 8-K event')"),
    Rule("confident_positive", "score >= 0.65 AND confidence >= 0.6", "'info'", "concat(label, ': positive disclosure signal (', name, ')')"),
)


@dataclass(frozen=True)
class Task:
    """units(sections, filings, companies) gives (unit_id, accession, cik, section_id, filing_date, source_text, variables)."""

    schema: PayloadSchema
    units: Callable[[DataFrame, DataFrame, DataFrame], DataFrame]
    polarity: Callable[[Column], Column]


def _named(rows: DataFrame, unit: str, section: Column, source: str, **variables: str) -> DataFrame:
    """Evidence is looked for in the source alone; variables may hold other texts."""
    named = F.create_map(*[x for name, column in variables.items() for x in (F.lit(name), F.coalesce(F.col(column).cast("string"), F.lit("")))])
    return rows.select(F.col(unit).alias("unit_id"), "accession", "cik", section.cast("string").alias("section_id"), "filing_date", F.col(source).alias("source_text"), named.alias("variables"))


def guidance_units(sections: DataFrame, filings: DataFrame, companies: DataFrame) -> DataFrame:
    rows = units.guidance_units(sections, filings, companies)
    return _named(rows, "section_id", F.col("section_id"), "section_text", company="name", form="form", period="period", section_text="section_text")


def risk_units(sections: DataFrame, filings: DataFrame, companies: DataFrame) -> DataFrame:
    rows = units.risk_pairs(sections, filings, companies)
    return _named(rows, "section_id", F.col("section_id"), "current_text", company="name", current_period="current_period", prior_period="prior_period", current_text="current_text", prior_text="prior_text")


def event_units(sections: DataFrame, filings: DataFrame, companies: DataFrame) -> DataFrame:
    """One unit per current report, not per item; a report without any text has none."""
    rows = units.event_units(sections, filings, companies)
    return _named(rows, "accession", F.lit(None), "section_text", company="name", items="items", filing_date="filing_date", section_text="section_text")


TASKS: dict[str, Task] = {
    "guidance_tone": Task(
        PayloadSchema("guidance_tone", {"direction": DIRECTIONS, "guidance_change": CHANGES}),
        guidance_units,
        # a change that was announced outweighs the tone
        lambda f: F.coalesce(lookup(CHANGE, f["guidance_change"]), lookup(SIGN, f["direction"]) * TONE),
    ),
    "risk_delta": Task(
        PayloadSchema("risk_delta", {"direction": DIRECTIONS, "severity": LEVELS}, lists=("new_risks", "removed_risks", "escalated_risks", "evidence")),
        risk_units,
        lambda f: lookup(SIGN, f["direction"]) * lookup(SEVERITY, f["severity"]),
    ),
    "event_class": Task(
        PayloadSchema("event_class", {"direction": DIRECTIONS, "materiality": LEVELS}, slugs=("event_type",)),
        event_units,
        lambda f: lookup(SIGN, f["direction"]) * lookup(MATERIALITY, f["materiality"]),
    ),
}
SCORING = {name: (t.schema, t.polarity) for name, t in TASKS.items()}


def build_units(task: str, sections: DataFrame, filings: DataFrame, companies: DataFrame, cik: str | None = None, limit: int | None = None) -> DataFrame:
    """A task's units, newest filings first, of one company if asked for, and so many at most. KeyError for an unknown task.

    The company is chosen before any text is read. Pairs are made before the limit.
    """
    if task not in TASKS:
        raise KeyError(f"no task {task!r}; there are {', '.join(sorted(TASKS))}")
    if cik is not None:
        filings = filings.filter(F.col("cik") == cik)
    rows = TASKS[task].units(sections, filings, companies).orderBy(F.col("filing_date").desc_nulls_last(), "unit_id")
    return rows if limit is None else rows.limit(limit)


def filled(template: str) -> Column:
    """The template as a Column over `variables`, each filled in once; a variable that a row lacks is an error there."""
    parts = re.split(r"\{\{\s*(\w+)\s*\}\}", template)
    said = [
        F.lit(x) if n % 2 == 0 else F.coalesce(F.try_element_at("variables", F.lit(x)), F.raise_error(F.lit(f"the template names {x}, which a unit lacks")).cast("string"))
        for n, x in enumerate(parts)
        if n % 2 or x
    ]
    return F.concat(*said) if said else F.lit("")


def prompted(units_: DataFrame, template: str) -> DataFrame:
    """Units with their prompt."""
    return units_.withColumn("prompt", filled(template))
