"""Extraction over units of text: dispatch with repairs, validation of payloads, grounding, review, response cache."""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions import documents, scalars


@dataclass(frozen=True)
class PayloadSchema:
    """What a task's JSON payload must be: an object with these fields and no others.

    vocabularies: fields with one of some words; numbers, clamped into [0, 1]; texts; lists of texts, which may lack; slugs:
    texts that are made slugs of.
    """

    task: str
    vocabularies: dict[str, tuple[str, ...]] = field(default_factory=dict)
    numbers: tuple[str, ...] = ("confidence",)
    texts: tuple[str, ...] = ("rationale",)
    lists: tuple[str, ...] = ("evidence",)
    slugs: tuple[str, ...] = ()

    @property
    def fields(self) -> tuple[str, ...]:
        return (*self.slugs, *self.vocabularies, *self.numbers, *self.texts, *self.lists)

    def check(self, value: object) -> list[str]:
        """What is wrong with a parsed value; the same as judged() says of its JSON."""
        if not isinstance(value, dict):
            return ["not a JSON object"]
        out = []
        for f in self.fields:
            if f not in value:
                out += [] if f in self.lists else [f"{f}: missing"]
            elif f in self.vocabularies:
                if not isinstance(value[f], str) or value[f] not in self.vocabularies[f]:
                    out.append(f"{f}: {_shown(value[f])} is not in the vocabulary")
            elif f in self.numbers:
                try:
                    float(value[f])
                except (TypeError, ValueError):
                    out.append(f"{f}: not a number")
            elif f in self.lists:
                if not isinstance(value[f], list) or not all(isinstance(x, str) for x in value[f]):
                    out.append(f"{f}: not a list of texts")
            elif not isinstance(value[f], str):
                out.append(f"{f}: not a text")
        return out + [f"{f}: unknown field" for f in value if f not in self.fields]


def _shown(value: object) -> str:
    return value if isinstance(value, str) else json.dumps(value, separators=(",", ":"))


def judged(payload: Column, schema: PayloadSchema) -> tuple[Column, Column]:
    """(fields, errors): the payload's fields as a struct, tidied (confidence clamped, quotes and lists cut, slugs made), and
    what is wrong with it, an empty array if nothing. A value of a wrong JSON type is an error, null too; it has no field."""
    names = F.json_object_keys(payload)
    whole = F.try_parse_json(payload)
    errors, fields = [], []
    for f in schema.fields:
        one = F.try_variant_get(whole, f"$.{f}", "variant")
        kind = F.schema_of_variant(one)
        value = F.try_variant_get(whole, f"$.{f}", "array<string>" if f in schema.lists else "double" if f in schema.numbers else "string")
        there = F.array_contains(names, f)
        if f in schema.vocabularies:
            value = F.when(kind == "STRING", value)
            bad = F.when(~F.coalesce(value.isin(*schema.vocabularies[f]), F.lit(False)), F.concat(F.lit(f"{f}: "), F.coalesce(value, F.get_json_object(payload, f"$.{f}"), F.lit("null")), F.lit(" is not in the vocabulary")))
            fields.append(value.alias(f))
        elif f in schema.numbers:
            bad = F.when(value.isNull(), F.lit(f"{f}: not a number"))
            fields.append(scalars.clamped_confidence(value).alias(f))
        elif f in schema.lists:
            good = (kind == "ARRAY<STRING>") & ~F.exists(value, lambda x: x.isNull()) | (kind == "ARRAY<VOID>") & (F.size(value) == 0)
            bad = F.when(~F.coalesce(good, F.lit(False)), F.lit(f"{f}: not a list of texts"))
            texts = F.coalesce(F.when(good, value), F.array().cast("array<string>"))
            fields.append((scalars.tidy_quotes(texts) if f == "evidence" else scalars.tidy_list(texts)).alias(f))
        else:
            value = F.when(kind == "STRING", value)
            bad = F.when(value.isNull(), F.lit(f"{f}: not a text"))
            fields.append((scalars.event_slug(value) if f in schema.slugs else value).alias(f))
        errors.append(F.when(there, bad) if f in schema.lists else F.when(~there, F.lit(f"{f}: missing")).otherwise(bad))
    known = F.array(*map(F.lit, schema.fields))
    unknown = F.transform(F.array_except(names, known), lambda f: F.concat(f, F.lit(": unknown field")))
    wrong = F.concat(F.array_compact(F.array(*errors)), unknown)
    return F.struct(*fields), F.when(names.isNull() | whole.isNull(), F.array(F.lit("not a JSON object"))).otherwise(wrong)


def validated(rows: DataFrame, payload: str, schema: PayloadSchema) -> DataFrame:
    """rows with `fields`, `errors` and `valid` by judged()."""
    fields, errors = judged(F.col(payload), schema)
    return rows.withColumn("fields", fields).withColumn("errors", errors).withColumn("valid", F.size("errors") == 0)


_PLAIN = r"^[\x00-\x1b\x20-\x7f]*$"


def with_grounding(rows: DataFrame, name: str, quotes: Column, source: Column) -> DataFrame:
    """rows with (total, grounded, ratio, methods) of quotes in their source, as a struct.

    Where quotes and source are plain ASCII the first two stages mean the same inside the JVM and are settled there; only rows
    with a quote left open go to Python, with their source. A null quote is not grounded; the ratio is 1 without quotes.
    """
    held = rows.withColumn("_quotes", F.coalesce(quotes, F.array().cast("array<string>"))).withColumn("_source", F.coalesce(source, F.lit("")))
    held = held.withColumn("_squeezed", scalars.squeezed(F.col("_source"))).withColumn("_bare", scalars.alphanumeric(F.col("_source")))

    def settled(q: Column) -> Column:
        own, letters = scalars.squeezed(q), scalars.alphanumeric(q)
        found = F.when((F.length(own) > 0) & F.col("_squeezed").contains(own), "exact").when((F.length(letters) > 0) & F.col("_bare").contains(letters), "normalised")
        return F.when(q.rlike(_PLAIN), found)

    held = held.withColumn("_first", F.when(F.col("_source").rlike(_PLAIN), F.transform("_quotes", settled)))
    held = held.withColumn("_open", F.col("_first").isNull() | F.exists("_first", lambda m: m.isNull()))
    said = documents.columns()["ground_quotes"](F.when(F.col("_open"), F.col("_quotes")), F.when(F.col("_open"), F.col("_source")))
    held = held.withColumn("_said", said).withColumn("_methods", F.when(F.col("_open"), F.col("_said.methods")).otherwise(F.col("_first")))
    total, good = F.size("_methods"), F.size(F.filter("_methods", lambda m: m != "none"))
    out = F.struct(total.alias("total"), good.alias("grounded"), F.when(total == 0, F.lit(1.0)).otherwise(good / total).alias("ratio"), F.col("_methods").alias("methods"))
    return held.withColumn(name, out).drop("_quotes", "_source", "_squeezed", "_bare", "_first", "_open", "_said", "_methods")


def grounded(rows: DataFrame, quotes: str, source: str) -> DataFrame:
    """rows with `grounding` (total, grounded, ratio, methods) and `hallucinated`: some quote is not grounded."""
    out = with_grounding(rows, "grounding", F.col(quotes), F.col(source))
    return out.withColumn("hallucinated", F.col("grounding.grounded") < F.col("grounding.total"))


def contains_quote(quote: Column, source: Column) -> Column:
    """The first two stages of grounding inside the JVM, for ASCII text: 'exact', 'normalised' or 'none'."""
    q, s = scalars.squeezed(quote), scalars.squeezed(source)
    bare = scalars.alphanumeric(quote)
    return F.when((F.length(q) > 0) & s.contains(q), "exact").when((F.length(bare) > 0) & scalars.alphanumeric(source).contains(bare), "normalised").otherwise("none")


def review_reason(valid: Column, ratio: Column, confidence: Column, least_ratio: float = 1.0, least_confidence: float = 0.45) -> Column:
    """Why a person should look, the gravest reason first: invalid, some quote not grounded, low confidence; null if nobody need."""
    return F.when(~valid, "invalid").when(F.coalesce(ratio, F.lit(0.0)) < least_ratio, "ungrounded").when(confidence < least_confidence, "low_confidence")


def review_queue(extractions: DataFrame, priorities: dict[str, int]) -> DataFrame:
    """(review_id, extraction_id, task, reason, priority, status) of the extractions to look at."""
    reason = review_reason(F.col("valid"), F.col("grounded_ratio"), F.col("confidence"))
    rows = extractions.withColumn("reason", reason).filter(F.col("reason").isNotNull())
    rank = F.create_map(*[F.lit(x) for kv in priorities.items() for x in kv])
    return rows.select(
        F.concat_ws(":", "task", "extraction_id").alias("review_id"), "extraction_id", "task", "reason", F.coalesce(F.try_element_at(rank, F.col("reason")), F.lit(0)).alias("priority"), F.lit("open").alias("status")
    )


# --- Response cache -----------------------------------------------------------------------------------------------


def request_key(request: dict) -> str:
    """The SHA-256 of a request's canonical JSON."""
    import hashlib

    return hashlib.sha256(json.dumps(request, sort_keys=True, separators=(",", ":"), ensure_ascii=False).encode()).hexdigest()


def cache_probe(requests: DataFrame, cache: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(hits, misses) of requests by key. A hit replays at no cost and no latency. Copies of a request are one miss."""
    hits = requests.join(cache.select("key", "response"), "key").withColumn("cached", F.lit(True)).withColumn("cost_usd", F.lit(0.0)).withColumn("latency_ms", F.lit(0.0))
    return hits, requests.join(cache, "key", "left_anti").dropDuplicates(["key"])


def cache_after(cache: DataFrame, hits: DataFrame, fresh: DataFrame) -> DataFrame:
    """The cache with its hit counters moved on and fresh responses added."""
    n = hits.groupBy("key").agg(F.count(F.lit(1)).alias("more"))
    moved = cache.join(n, "key", "left").withColumn("hits", F.col("hits") + F.coalesce("more", F.lit(0))).drop("more")
    return moved.unionByName(fresh.select(*cache.columns))


def cache_stats(cache: DataFrame) -> DataFrame:
    return cache.agg(F.count(F.lit(1)).alias("entries"), F.coalesce(F.sum("hits"), F.lit(0)).alias("hits"))


# --- Dispatch -----------------------------------------------------------------------------------------------------

ANSWERED = (
    "payload string, valid boolean, repair_attempts int, calls int, tokens_in long, tokens_out long, cost_usd double, latency_ms double, cached boolean, model string, provider string, error string, raw string"
)


@dataclass
class Answer:
    """What a model said, and what it took. A complete() may also return the text alone."""

    text: str
    model: str = ""
    tokens_in: int | None = None
    tokens_out: int | None = None
    cost_usd: float = 0.0
    latency_ms: float | None = None
    cached: bool = False
    provider: str = ""


def extract(units: DataFrame, complete: Callable[[str, str | None], str | Answer], check: Callable[[dict], list[str]], repairs: int = 2) -> DataFrame:
    """The units (prompt, and whatever else they have) with ANSWERED in place of the prompt.

    complete(prompt, complaint) is asked once, and again with a complaint after each answer that is no valid JSON object,
    at most `repairs` times. A failing call ends its own unit only. Tokens, cost and time add up over the attempts. Calls
    are made whenever the result is evaluated: write it before it is used more than once.
    """
    kept = [c for c in units.columns if c != "prompt"]
    names = [f.split()[0] for f in ANSWERED.split(", ")]
    types = (pa.string(), pa.bool_(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.bool_(), pa.string(), pa.string(), pa.string(), pa.string())

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            rows = [_attempts(prompt or "", complete, check, repairs) for prompt in batch.column(len(kept)).to_pylist()]
            columns = list(zip(*rows)) if rows else [()] * len(types)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], *(pa.array(c, t) for c, t in zip(columns, types))], names=[*kept, *names])

    ordered = units.select(*kept, "prompt")
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in ordered.schema.fields[:-1]), ANSWERED])
    return ordered.mapInArrow(run, schema)


def _attempts(prompt: str, complete, check, repairs: int) -> tuple:
    calls, tokens_in, tokens_out, cost, took, last, complaint = 0, 0, 0, 0.0, 0.0, Answer(""), None
    found, valid, error = None, False, None
    while calls <= repairs:
        began = time.perf_counter()
        try:
            said = complete(prompt, complaint)
        except Exception as e:  # the unit's own failure
            error = f"{type(e).__name__}: {e}"[:500]
            break
        last = said if isinstance(said, Answer) else Answer(said)
        calls += 1
        took += (time.perf_counter() - began) * 1000 if last.latency_ms is None else last.latency_ms
        cost += last.cost_usd
        tokens_in += max(1, (len(prompt) + len(complaint or "")) // 4) if last.tokens_in is None else last.tokens_in
        tokens_out += max(1, len(last.text) // 4) if last.tokens_out is None else last.tokens_out
        found = documents.parse_json_loose(last.text)
        errors = check(json.loads(found)) if found is not None else ["not a JSON object"]
        valid, error = not errors, "; ".join(errors) or None
        if valid:
            break
        complaint = error
    return found if valid else "{}", valid, max(0, calls - 1), calls, tokens_in, tokens_out, cost, took, last.cached, last.model, last.provider, error, last.text


def records(answers: DataFrame, schema: PayloadSchema, prompt: dict) -> DataFrame:
    """Rows of the extractions table, with confidence, hallucinated, ungrounded and raw beside them, of answered units
    (accession, cik, section_id, source_text, ANSWERED). prompt: its name, version and hash.

    The id digests task, filing, section, prompt and model, so that running the same again replaces the row.
    """
    rows = validated(answers.withColumnRenamed("valid", "answered"), "payload", schema)
    rows = rows.withColumn("valid", F.col("answered") & F.col("valid"))
    rows = grounded(rows.withColumn("evidence", F.when(F.col("valid"), F.col("fields.evidence"))), "evidence", "source_text")
    key = f"{prompt['name']}@{prompt['version']}"
    ratio = F.when(F.col("valid"), F.col("grounding.ratio")).otherwise(0.0)
    missing = F.filter(F.transform(F.arrays_zip("evidence", "grounding.methods"), lambda x: F.when(x["methods"] == "none", x["evidence"])), lambda q: q.isNotNull())
    return rows.select(
        scalars.stable_id(F.lit(schema.task), F.col("accession"), F.col("section_id"), F.lit(key), F.lit(prompt["hash"]), F.col("model")).alias("extraction_id"),
        F.lit(schema.task).alias("task"), "accession", "cik", "section_id", F.lit(prompt["name"]).alias("prompt_name"), F.lit(str(prompt["version"])).alias("prompt_version"),
        F.lit(prompt["hash"]).alias("prompt_hash"), "model", "provider", F.lit(prompt["hash"]).alias("config_hash"),
        F.when(F.col("valid"), F.to_json("fields")).otherwise("{}").alias("payload"), "valid", "repair_attempts", ratio.alias("grounded_ratio"), "tokens_in", "tokens_out", "cost_usd", "latency_ms", "cached", "error",
        F.when(F.col("valid"), F.col("fields.confidence")).alias("confidence"), (F.col("valid") & F.col("hallucinated")).alias("hallucinated"), missing.alias("ungrounded"), "raw",
    )


def reviews(records: DataFrame, priorities: dict[str, int], raw_chars: int = 2000) -> DataFrame:
    """Rows of the review queue for records() that are weak; what was found stands in `proposed` as JSON."""
    queued = review_queue(records, priorities)
    proposed = F.to_json(F.struct("payload", "model", F.concat("prompt_name", F.lit("@"), "prompt_version").alias("prompt"), "error", F.when(~F.col("valid"), F.substring("raw", 1, raw_chars)).alias("raw"), F.col("ungrounded").alias("ungrounded_quotes")))
    return queued.join(records.select("extraction_id", proposed.alias("proposed")), "extraction_id")
