import json
from datetime import date, datetime

import pytest

from ledgerloom import warehouse
from ledgerloom.operators import extraction, ingest, retrieval
from ledgerloom.operators.tracing import Tracer
from ledgerloom.service import Service
from ledgerloom.streaming import landing

BODY = "The company sells coatings to many customers in several districts. " * 8


@pytest.fixture
def own(spark, tmp_path):
    return warehouse.Warehouse.open(spark, f"file://{tmp_path}/w")


def test_open_makes_tables_and_read_only_refuses(spark, own, tmp_path):
    assert all(own.table(n).count() == 0 for n in ("companies", "llm_cache"))
    locked = warehouse.Warehouse.open(spark, own.path, read_only=True)
    with pytest.raises(PermissionError):
        locked.upsert("companies", spark.createDataFrame([("1", "x")], "cik string, name string"))
    with pytest.raises(KeyError):
        own.table("nothing")


def test_upsert(spark, own):
    own.upsert("companies", spark.createDataFrame([("1", "A", "AA"), ("2", "B", "BB")], "cik string, name string, ticker string"))
    own.upsert("companies", spark.createDataFrame([("2", "B2"), ("3", "C"), ("3", "C")], "cik string, name string"))
    assert sorted((r.cik, r.name, r.ticker) for r in own.table("companies").collect()) == [("1", "A", "AA"), ("2", "B2", "BB"), ("3", "C", None)]
    own.upsert("companies", spark.createDataFrame([("2", "B3", None)], "cik string, name string, ticker string"))
    assert own.table("companies").filter("cik = '2'").first().ticker is None
    assert own.vacuum("companies") >= 2 and own.table("companies").count() == 3
    with pytest.raises(ValueError):
        own.upsert("companies", spark.createDataFrame([("2", 1)], "cik string, unknown int"))
    with pytest.raises(Exception, match="null"):
        own.upsert("companies", spark.createDataFrame([("2", None)], "cik string, name string"))


def files(own, name):
    return {b: f for b, f in own.manifest()["tables"].get(name, {}).items()}


def test_only_touched_buckets_are_written(spark, own):
    own.upsert("companies", spark.range(200).selectExpr("CAST(id AS STRING) AS cik", "'n' AS name"))
    before = files(own, "companies")
    assert len(before) == 32
    own.upsert("companies", spark.createDataFrame([("7", "seven")], "cik string, name string"))
    after = files(own, "companies")
    assert sum(before[b] != after[b] for b in before) == 1 and own.table("companies").count() == 200 and own.table("companies").filter("cik = '7'").first().name == "seven"
    parents = spark.createDataFrame([("a-1",), ("a-2",)], "accession string")
    rows = spark.range(60).selectExpr("concat('a-', id, ':mdna') AS section_id", "concat('a-', id) AS accession", "'mdna' AS slug", "'t' AS text")
    own.upsert("sections", rows)
    before = files(own, "sections")
    own.replace_children("sections", rows.filter("accession = 'a-2'"), parents)
    assert sum(before[b] != files(own, "sections").get(b) for b in before) <= 2
    assert own.table("sections").count() == 59 and own.table("sections").filter("accession = 'a-1'").count() == 0


def test_one_state_for_all_tables_of_a_write(spark, own, monkeypatch):
    r = raw(spark)
    p = ingest.parsed(r)
    s = ingest.sections_of(p)
    seen = own.manifest()["version"]
    own.ingest_filing_rows(r.select("accession", "cik", "form", "filing_date"), s, ingest.chunks_of(s, r), ingest.parse_reviews(p))
    assert own.manifest()["version"] == seen + 1 and own.table("review_queue").filter("priority = 5").count() == 1
    state = own.manifest()
    own.upsert("companies", spark.createDataFrame([("1", "A")], "cik string, name string"))
    with pytest.raises(warehouse.Conflict):  # begun from a state that is no longer current
        own._commit(state["version"], {})
    monkeypatch.setattr(own, "_commit", lambda *a: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        own.upsert("companies", spark.createDataFrame([("2", "B")], "cik string, name string"))
    assert own.table("companies").count() == 1  # what is only staged is not seen


def raw(spark):
    html = f"<p>Item 1A. Risk Factors</p><p>{BODY}</p><p>Item 7. Management's Discussion and Analysis</p><p>{BODY * 9}</p>"
    rows = [("a-1", "1", "10-K", date(2020, 1, 1), html), ("a-2", "1", "10-K", date(2021, 1, 1), None), ("a-3", "2", "8-K", date(2021, 1, 1), "<p>short</p>")]
    return spark.createDataFrame(rows, "accession string, cik string, form string, filing_date date, html string")


def test_ingest_again_changes_nothing(spark, own):
    r = raw(spark)
    for _ in range(2):
        p = ingest.parsed(r)
        s = ingest.sections_of(p)
        own.ingest_filing_rows(r.select("accession", "cik", "form", "filing_date"), s, ingest.chunks_of(s, r))
    assert {x.section_id for x in own.table("sections").collect()} == {"a-1:risk_factors", "a-1:mdna", "a-3:body"}
    n = own.table("chunks").count()
    assert n >= 4 and own.table("chunks").select("chunk_id").distinct().count() == n
    report = ingest.report(p, s, own.table("chunks")).first()
    assert (report.filings, report.skipped, report.sections, report.chunks) == (3, 1, 3, n)
    own.replace_children("chunks", own.table("chunks").limit(0), r.filter("accession = 'a-1'"))
    assert own.table("chunks").filter("accession = 'a-1'").count() == 0 and own.table("chunks").count() > 0


def test_index_and_search(spark, own):
    texts = ["road salt demand fell in the north", "the board appointed a new auditor", "salt prices rose and salt stocks fell", "nothing else to say"]
    rows = [(f"f:risk_factors:{n}" if n % 2 else f"f:mdna:{n}", f"f:{'risk_factors' if n % 2 else 'mdna'}", "f", "1", n, t) for n, t in enumerate(texts)]
    own.upsert("chunks", spark.createDataFrame(rows, "chunk_id string, section_id string, accession string, cik string, ordinal int, text string"))
    new = retrieval.embedded(retrieval.pending(own.table("chunks"), own.table("embeddings"), "hash-64"), "hash-64")
    own.upsert("embeddings", new)
    assert retrieval.pending(own.table("chunks"), own.table("embeddings"), "hash-64").count() == 0 and retrieval.pending(own.table("chunks"), own.table("embeddings"), "other").count() == 4
    s = Service(own)
    assert s.search("salt prices", "keyword").first().chunk_id == "f:mdna:2"
    assert s.search("the board appointed a new auditor", "vector", 1).first().chunk_id == "f:risk_factors:1"
    hybrid = s.search("salt prices rose and salt stocks fell", "hybrid", 2).collect()
    assert hybrid[0].chunk_id == "f:mdna:2" and hybrid[0].sources == ["keyword", "vector"]
    assert s.search("salt", "keyword", slug="risk_factors").count() == 0 and s.search("the of and", "keyword").count() == 0
    with pytest.raises(ValueError):
        s.search("x", "sideways")
    with pytest.raises(ValueError):
        s.search("x", k=0)


def test_service_lists(spark, own):
    own.upsert("companies", spark.createDataFrame([("1", "A", "aa")], "cik string, name string, ticker string"))
    sig = [("s1", "guidance", "1", "a-1", date(2021, 1, 1), -0.7, 0.9, "bearish"), ("s2", "risk", "1", "a-1", date(2021, 1, 2), 0.05, 0.5, "neutral"), ("s0", "risk", "1", "a-0", date(2020, 1, 2), 0.9, 0.5, "bullish")]
    own.upsert("signals", spark.createDataFrame(sig, "signal_id string, name string, cik string, accession string, as_of date, score double, confidence double, direction string"))
    own.upsert("alerts", spark.createDataFrame([("x1", "s1", "r", "critical", "h"), ("x2", "s2", "r", "info", "h")], "alert_id string, signal_id string, rule string, severity string, headline string"))
    s = Service(own, {"guidance": 0.5, "risk": 0.5})
    assert [r.signal_id for r in s.list_signals().collect()] == ["s2", "s1", "s0"] and s.list_signals(least=0.5, ticker="AA", direction="bearish").count() == 1
    c = s.company_composite("AA").first()
    assert (c.score, c.coverage, c.n_names) == (-0.325, 1.0, 2)
    assert [r.alert_id for r in s.list_alerts().collect()] == ["x1", "x2"] and s.list_alerts("info").first().ticker == "aa"
    assert {r.table_name: r.n_rows for r in s.health().collect()}["signals"] == 3
    assert s.sql("SELECT name, count(*) AS n FROM signals GROUP BY name").count() == 2
    tools = {t.name: t for t in s.tools()}
    assert "(1 rows)" in tools["list_companies"].run() and "cik:string" in tools["describe_schema"].run() and "42" in tools["run_python"].run(code="print(6 * 7)")
    assert s.review().count() == s.eval_runs().count() == s.costs().count() == 0


def test_tracing(spark, own):
    t = Tracer()
    with t.span("outer"):
        with pytest.raises(ZeroDivisionError):
            with t.span("inner", "llm", model="m", tokens_in=3, cost_usd=0.5):
                1 / 0
    assert len(json.loads(t.to_json())) == 2
    assert t.flush(spark, lambda df: own.upsert("traces", df)) == 2 and t.flush(spark, None) == 0
    rows = {r.name: r for r in own.table("traces").collect()}
    assert rows["inner"].parent_id == rows["outer"].span_id and rows["inner"].status == "error" and rows["inner"].tokens_in == 3 and rows["outer"].parent_id is None


def test_streaming_ingest(spark, own, tmp_path):
    folder = tmp_path / "landing"
    folder.mkdir()
    for n in range(2):
        (folder / f"{n}.json").write_text(json.dumps({"accession": f"a-{n}", "cik": "1", "form": "10-K", "filing_date": "2020-01-01", "html": f"<p>Item 1A. Risk Factors</p><p>{BODY}</p>"}))
    for _ in range(2):
        landing.ingest_into(own, landing.raw_filings(spark, str(folder)), str(tmp_path / "checkpoint")).awaitTermination()
    assert own.table("filings").count() == 2 and own.table("sections").count() == 2


def test_streaming_costs(spark, tmp_path):
    spans = spark.createDataFrame([(datetime(2024, 1, d, h), "m", 0.25) for d in (1, 2, 3) for h in (1, 2)], "started_at timestamp, model string, cost_usd double")
    spans.coalesce(1).write.parquet(str(tmp_path / "spans"))
    stream = spark.readStream.schema(spans.schema).parquet(str(tmp_path / "spans"))
    landing.daily_costs_to(stream, str(tmp_path / "out"), str(tmp_path / "c")).awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out")).collect()
    assert {r.day.day: (r.calls, r.cost_usd) for r in got}[1] == (2, 0.5)


def test_extraction_with_repairs(spark):
    units = spark.createDataFrame([("good", "a"), ("mended", "b"), ("bad", "c"), ("broken", "d"), ("none", None)], "unit_id string, prompt string")

    def complete(prompt, complaint):
        if prompt == "d":
            raise RuntimeError("no answer")
        if prompt == "b":
            return '{"x": 1}' if complaint else "words"
        return "never" if prompt == "c" else '{"x": 2}'

    out = {r.unit_id: r for r in extraction.extract(units, complete, lambda v: [] if "x" in v else ["x is missing"]).collect()}
    assert out["good"].valid and out["good"].repair_attempts == 0 and out["mended"].valid and out["mended"].repair_attempts == 1 and out["mended"].calls == 2
    assert not out["bad"].valid and out["bad"].calls == 3 and out["bad"].payload == "{}" and out["broken"].error == "RuntimeError: no answer" and out["bad"].latency_ms > 0 and out["none"].valid
