"""From stored extractions to signed signals, composites and alerts. Tables of values and rules are parameters."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions import scalars


def lookup(values: dict[str, float], key: Column, default: float | None = None) -> Column:
    """A column's value in a small fixed table."""
    table = F.create_map(*[F.lit(x) for kv in values.items() for x in kv])
    found = F.try_element_at(table, key)
    return found if default is None else F.coalesce(found, F.lit(default))


def score(polarity: Column, confidence: Column, floor: float = 0.25, places: int = 4) -> Column:
    """polarity, weighed by confidence, in [-1, 1]."""
    weighed = polarity * (F.lit(floor) + F.lit(1 - floor) * F.coalesce(confidence, F.lit(0.0)))
    return scalars.round_half_away(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), weighed)), places)


def direction(score: Column, band: float = 0.1) -> Column:
    return F.when(score > band, "bullish").when(score < -band, "bearish").otherwise("neutral")


def scored(extractions: DataFrame, filings: DataFrame, companies: DataFrame, polarity: Column, version: str = "v1", least_grounded: float = 0.5) -> DataFrame:
    """(signal_id, name, cik, ticker, accession, as_of, score, confidence, direction) of the valid, grounded extractions, and of
    the columns rationale, evidence and extraction_id those that there are, the last as a list of one.

    A null grounded ratio is not enough. A company that is missing leaves the ticker null; as_of is the day of report, or of
    filing, or today.
    """
    rows = (
        extractions.filter(F.col("valid") & (F.col("grounded_ratio") >= least_grounded))
        .join(filings.select("accession", "filing_date", "report_date"), "accession")
        .join(companies.select("cik", "ticker"), "cik", "left")
    )
    s = score(polarity, F.col("confidence"))
    more = [c for c in ("rationale", "evidence") if c in extractions.columns] + ([F.array("extraction_id").alias("extraction_ids")] if "rationale" in extractions.columns else [])
    return rows.select(
        scalars.stable_id(F.col("task"), F.col("cik"), F.col("accession"), F.lit(version)).alias("signal_id"),
        F.col("task").alias("name"), "cik", "ticker", "accession", F.coalesce("report_date", "filing_date", F.current_date()).alias("as_of"),
        s.alias("score"), "confidence", direction(s).alias("direction"), *more,
    )


def score_stored(extractions: DataFrame, filings: DataFrame, companies: DataFrame, tasks: dict, task: str | None = None, cik: str | None = None, version: str = "score-v1") -> DataFrame:
    """Signals of stored extractions, by today's schemas and polarities: scoring can be changed without asking a model again.

    tasks: name -> (PayloadSchema, polarity of its fields). A stored payload that is no longer valid has no signal; one pass
    reads every task's.
    """
    from ledgerloom.operators.extraction import judged

    rows = extractions.filter(F.col("task").isin(*tasks) & F.col("valid"))
    for column, value in (("task", task), ("cik", cik)):
        if value is not None:
            rows = rows.filter(F.col(column) == value)
    read = F.lit(None)
    for name, (schema, polarity) in tasks.items():
        fields, errors = judged(F.col("payload"), schema)
        one = F.struct(F.size(errors).alias("wrong"), polarity(fields).alias("polarity"), *[fields[c].alias(c) for c in ("confidence", "rationale", "evidence")])
        read = F.when(F.col("task") == name, one).otherwise(read)
    rows = rows.withColumn("read", read).filter("read.wrong = 0")
    rows = rows.select("extraction_id", "task", "cik", "accession", "valid", "grounded_ratio", "read.polarity", "read.confidence", "read.rationale", "read.evidence")
    return scored(rows, filings, companies, F.col("polarity"), version).withColumn("pipeline_version", F.lit(version))


def composite(signals: DataFrame, weights: dict[str, float], other_weight: float = 0.1) -> DataFrame:
    """(cik, score, coverage, n_names) of each company: its latest signal of each name, weighed.

    Scores are summed as decimals, so that the order of addition cannot show. coverage counts known names only. Of signals
    of one day and accession the one with the greatest id counts.
    """
    last = signals.groupBy("cik", "name").agg(F.max_by("score", F.struct("as_of", "accession", "signal_id")).alias("score"))
    weight = lookup(weights, F.col("name"))
    rows = last.withColumn("known", F.coalesce(weight, F.lit(0.0)).cast("decimal(6,3)")).withColumn("weight", F.coalesce(weight, F.lit(other_weight)).cast("decimal(6,3)"))
    sums = rows.groupBy("cik").agg(
        F.sum(F.col("score").cast("decimal(12,6)") * F.col("weight")).cast("double").alias("s"), F.sum("weight").cast("double").alias("w"),
        F.sum("known").cast("double").alias("known"), F.count(F.lit(1)).alias("n_names"),
    )
    return sums.select("cik", scalars.round_half_away(F.col("s") / F.col("w"), 4).alias("score"), scalars.round_half_away(F.col("known"), 3).alias("coverage"), "n_names")


@dataclass(frozen=True)
class Rule:
    """An alert rule: rows that meet the condition get the rule's name, its severity and a headline. All three are SQL over a
    signal's columns; in a headline `label` is the ticker or else the cik."""

    name: str
    condition: str
    severity: str
    headline: str = "label"


def alerts(signals: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """(alert_id, signal_id, rule, severity, headline, detail, score): every rule is held against every signal in one pass; none
    to all may fire. detail is the signal's rationale, null where signals have none."""
    rows = signals.withColumn("label", F.coalesce("ticker", "cik")) if "ticker" in signals.columns else signals.withColumn("label", F.col("signal_id"))
    rows = rows if "rationale" in signals.columns else rows.withColumn("rationale", F.lit(None).cast("string"))
    fired = [F.when(F.expr(r.condition), F.struct(F.lit(r.name).alias("rule"), F.expr(r.severity).alias("severity"), F.expr(r.headline).alias("headline"))) for r in rules]
    rows = rows.select("signal_id", "score", "rationale", F.explode(F.array_compact(F.array(*fired))).alias("a"))
    return rows.select(scalars.stable_id(F.col("a.rule"), F.col("signal_id")).alias("alert_id"), "signal_id", "a.rule", "a.severity", "a.headline", F.col("rationale").alias("detail"), "score")


def severity_rank(severity: Column) -> Column:
    return F.when(severity == "critical", 0).when(severity == "warn", 1).when(severity == "info", 2).otherwise(3)


def listed(signals: DataFrame, companies: DataFrame, least: float = 0.0, ticker: str | None = None, cik: str | None = None, name: str | None = None, direction: str | None = None, limit: int = 50) -> DataFrame:
    """Signals with their company's ticker where they have none, by day and strength, the first limit ones."""
    c = companies.select("cik", F.col("ticker").alias("company_ticker"), F.col("name").alias("company"))
    rows = signals.join(c, "cik", "left").withColumn("ticker", F.coalesce("ticker", "company_ticker")).drop("company_ticker")
    rows = rows.filter(F.abs("score") >= least)
    if ticker:
        rows = rows.filter(F.upper("ticker") == ticker.upper())
    for column, value in (("cik", cik), ("name", name), ("direction", direction)):
        if value is not None:
            rows = rows.filter(F.col(column) == value)
    return rows.orderBy(F.col("as_of").desc_nulls_last(), F.abs("score").desc(), "signal_id").limit(limit)


def companies_overview(companies: DataFrame, filings: DataFrame, limit: int = 200) -> DataFrame:
    """(cik, name, ticker, n_filings, last_filing), most filings first; companies without filings are kept."""
    f = filings.groupBy("cik").agg(F.count("accession").alias("n_filings"), F.max("filing_date").alias("last_filing"))
    rows = companies.select("cik", "name", "ticker").join(f, "cik", "left").withColumn("n_filings", F.coalesce("n_filings", F.lit(0)))
    return rows.orderBy(F.col("n_filings").desc(), "cik").limit(limit)
