"""Documents and metadata from files: ticker maps, submission lists, raw filings, labelled cases, registries."""

from __future__ import annotations

import hashlib
import json
import random
import re
import threading
import time
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.functions import scalars


def ticker_map(spark: SparkSession, path: str) -> DataFrame:
    """(ticker, cik, title) from a JSON object of numbered entries."""
    raw = spark.read.text(path, wholetext=True)
    entry = "struct<cik_str:bigint,ticker:string,title:string>"
    return raw.select(F.explode(F.from_json("value", f"map<string,{entry}>")).alias("n", "e")).select(
        F.upper("e.ticker").alias("ticker"), F.lpad(F.col("e.cik_str").cast("string"), 10, "0").alias("cik"), "e.title", F.col("n").cast("int").alias("n")
    )


def resolve_ticker(tickers: DataFrame, ticker: str) -> DataFrame:
    """The first entry of a ticker, without regard to case."""
    return tickers.filter(F.col("ticker") == ticker.upper()).orderBy("n").limit(1).select("cik", "ticker", "title")


_RECENT = ("accessionNumber", "form", "filingDate", "reportDate", "items", "primaryDocument", "size")
SUBMISSION = (
    "cik string, name string, sic string, sicDescription string, tickers array<string>, exchanges array<string>, filings struct<recent: struct<"
    + ", ".join(f"{n}: array<{'bigint' if n == 'size' else 'string'}>" for n in _RECENT)
    + ">>"
)


def submissions(spark: SparkSession, path: str) -> DataFrame:
    """Submission documents, one JSON object per file."""
    return spark.read.schema(SUBMISSION).json(path, multiLine=True)


def companies_of(documents: DataFrame) -> DataFrame:
    return documents.select(
        F.lpad("cik", 10, "0").alias("cik"), F.try_element_at("tickers", F.lit(1)).alias("ticker"), "name", "sic",
        F.col("sicDescription").alias("sic_description"), F.try_element_at("exchanges", F.lit(1)).alias("exchange"),
    )


def filings_of(documents: DataFrame, base: str, forms: tuple[str, ...] = ("10-K", "10-Q", "8-K"), since: str | None = None, limit: int | None = None) -> DataFrame:
    """Filings from parallel arrays, in their order: of a wanted form, with a document and a valid date.

    Required arrays are cut to the shortest of them; optional ones may lack or be shorter.
    """
    r = F.col("filings.recent")
    n = F.least(*[F.size(r[c]) for c in ("accessionNumber", "form", "filingDate", "primaryDocument")])
    present = [F.coalesce(r[c], F.array().cast("array<bigint>" if c == "size" else "array<string>")).alias(c) for c in _RECENT]
    rows = documents.select(F.lpad("cik", 10, "0").alias("cik"), F.posexplode(F.arrays_zip(*present)).alias("pos", "f"), n.alias("n"))
    rows = rows.filter(F.col("pos") < F.col("n")).select("cik", "pos", *[F.col("f")[c].alias(c) for c in _RECENT])
    rows = rows.withColumn("filing_date", scalars.iso_date(F.col("filingDate"))).filter(
        F.col("form").isin(*forms) & (F.length("primaryDocument") > 0) & F.col("filing_date").isNotNull() & F.col("accessionNumber").isNotNull()
    )
    if since is not None:
        rows = rows.filter(F.col("filing_date") >= F.lit(since).cast("date"))
    if limit is not None:
        from pyspark.sql import Window

        rows = rows.withColumn("k", F.row_number().over(Window.partitionBy("cik").orderBy("pos"))).filter(F.col("k") <= limit)
    return rows.select(
        F.col("accessionNumber").alias("accession"), "cik", "form", "filing_date", scalars.iso_date(F.col("reportDate")).alias("report_date"),
        F.nullif("items", F.lit("")).alias("items"), F.col("primaryDocument").alias("primary_doc"),
        scalars.filing_url(base, F.col("cik"), F.col("accessionNumber"), F.col("primaryDocument")).alias("url"), F.col("size").alias("size_bytes"), "pos",
    )


def raw_documents(spark: SparkSession, path: str) -> DataFrame:
    """(path, html): files as UTF-8, broken bytes replaced."""
    files = spark.read.format("binaryFile").load(path)
    return files.select("path", F.make_valid_utf8(F.col("content").cast("string")).alias("html"))


def with_documents(filings: DataFrame, documents: DataFrame, key: str = "accession") -> tuple[DataFrame, DataFrame]:
    """(filings with their document, filings without: the skipped ones)."""
    return filings.join(documents, key), filings.join(documents, key, "left_anti").withColumn("reason", F.lit("no document"))


CASE = "case_id string, task string, label map<string,string>, notes string, variables map<string,string>"


def load_cases(spark: SparkSession, path: str, task: str | None = None) -> DataFrame:
    """Labelled cases from JSON lines; blank lines and // lines are skipped. A broken line, or none at all, is an error."""
    lines = spark.read.text(path).filter(~F.col("value").rlike(r"^\s*(//.*)?$"))
    rows = lines.select("value", F.from_json("value", CASE + ", _corrupt_record string", {"columnNameOfCorruptRecord": "_corrupt_record"}).alias("c"))
    bad = rows.filter(F.col("c._corrupt_record").isNotNull() | F.col("c.case_id").isNull()).limit(1).collect()
    if bad:
        # only now lines are numbered: of the file as a whole
        whole = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", "\r?\n")).alias("n", "value")).filter(F.col("value") == bad[0].value)
        raise ValueError(f"{path}:{(whole.agg(F.min('n')).first()[0] or 0) + 1}: not a case: {bad[0].value[:200]}")
    cases = rows.select("c.case_id", "c.task", "c.label", "c.notes", "c.variables")
    if task is not None:
        cases = cases.filter(F.col("task") == task)
    if cases.isEmpty():
        raise ValueError(f"{path}: no cases")
    return cases


class RateLimiter:
    """Keeps calls of one driver at least an interval apart, without bursts."""

    def __init__(self, per_second: float, clock: Callable[[], float] = time.monotonic, sleep: Callable[[float], None] = time.sleep):
        self.interval, self.clock, self.sleep = 1.0 / per_second, clock, sleep
        self.lock, self.free_at = threading.Lock(), 0.0

    def wait(self) -> None:
        with self.lock:
            now = self.clock()
            if now < self.free_at:
                self.sleep(self.free_at - now)
                now = self.free_at
            self.free_at = now + self.interval


class PermanentError(Exception):
    """A failure that trying again won't mend."""


class CachedFetcher:
    """Gets documents through a given transport, once each: from a cache folder, else fetched with retries."""

    def __init__(self, transport: Callable[[str], bytes], folder: str, limiter: RateLimiter | None = None, tries: int = 3, sleep: Callable[[float], None] = time.sleep):
        self.transport, self.folder, self.limiter, self.tries, self.sleep = transport, Path(folder), limiter, tries, sleep

    def get(self, url: str) -> bytes:
        at = self.folder / hashlib.sha256(url.encode()).hexdigest()[:24]
        if at.exists():
            return at.read_bytes()
        for n in range(self.tries):
            if self.limiter:
                self.limiter.wait()
            try:
                data = self.transport(url)
                break
            except PermanentError:
                raise
            except Exception:
                if n + 1 == self.tries:
                    raise
                self.sleep(2**n + random.random() / 10)
        self.folder.mkdir(parents=True, exist_ok=True)
        at.write_bytes(data)
        return data


def read_settings(path: str) -> dict:
    """A YAML or JSON file of models, chains and embeddings, as plain values; models and embeddings by name.

    Either may be a mapping by name or a list of entries with a name; embeddings may stand under `models` beside a `default`.
    """
    text = Path(path).read_text()
    try:
        read = json.loads(text)
    except ValueError:
        import yaml

        read = yaml.safe_load(text) or {}
    named = lambda x: {e["name"]: e for e in x} if isinstance(x, list) else dict(x or {})
    vectors = read.get("embeddings") or {}
    inner = vectors.get("models", vectors) if isinstance(vectors, dict) else vectors
    rest = {k: v for k, v in read.items() if k not in ("chains", "embeddings")}
    return {
        "models": named(read["models"] if "models" in read else rest), "chains": read.get("chains") or {},
        "embeddings": {k: v for k, v in named(inner).items() if k != "default"}, "default_embedding": vectors.get("default") if isinstance(vectors, dict) else None,
    }


def load_registry(spark: SparkSession, path: str) -> DataFrame:
    """(name, provider, model, price_in, price_out) of a file of model settings."""
    entries = read_settings(path)["models"]
    rows = [(n, e.get("provider"), e.get("model") or e.get("model_id"), *(float(e.get(k) or 0) for k in ("price_in", "price_out"))) for n, e in entries.items()]
    return spark.createDataFrame(rows, "name string, provider string, model string, price_in double, price_out double")


_FRONT = re.compile(r"\A---\n(.*?)\n---\n(.*)\Z", re.S)


class Prompts:
    """Prompt files: a front matter of name, version, task and variables, then the template."""

    def __init__(self, folder: str, skip: tuple[str, ...] = ("skills",)):
        import yaml

        self.entries: dict[tuple[str, str], dict] = {}
        for f in sorted(Path(folder).rglob("*.md")):
            if any(p in skip for p in f.relative_to(folder).parts[:-1]):
                continue
            m = _FRONT.match(f.read_text())
            if not m:
                raise ValueError(f"{f}: no front matter")
            head, body = yaml.safe_load(m.group(1)), m.group(2).strip()
            used, declared = set(re.findall(r"\{\{\s*(\w+)\s*\}\}", body)), set(head.get("variables") or [])
            if used != declared:
                raise ValueError(f"{f}: not declared {sorted(used - declared)}, not used {sorted(declared - used)}")
            key = head["name"], str(head["version"])
            if key in self.entries:
                raise ValueError(f"{f}: {key} exists twice")
            self.entries[key] = head | {"body": body, "hash": hashlib.sha256(body.encode()).hexdigest()[:16]}

    def manifest(self) -> list[dict]:
        """Name, version, task and hash of every prompt."""
        return [{k: e.get(k) for k in ("name", "version", "task", "hash")} for e in self.entries.values()]

    def versions(self, name: str) -> list[str]:
        return [v for n, v in self.entries if n == name]

    def get(self, name: str, version: str | None = None) -> dict:
        """A prompt by version, or its highest version (v10 after v9)."""
        if version is None:
            own = [v for n, v in self.entries if n == name]
            if not own:
                raise KeyError(name)
            version = max(own, key=lambda v: (int((re.match(r"v?(\d+)", v) or [0, -1])[1]), v))
        return self.entries[name, version]


def load_skills(folder: str) -> str:
    """The bodies of all skill files, in order, between rules."""
    bodies = []
    for f in sorted(Path(folder).glob("*.md")):
        text = f.read_text()
        m = _FRONT.match(text)
        bodies.append((m.group(2) if m else text).strip())
    return "\n\n---\n\n".join(bodies)
