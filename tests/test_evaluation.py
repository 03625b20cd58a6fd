import json

import pytest
from pyspark.sql import functions as F

from ledgerloom import api
from ledgerloom.agent.router import Model, Registry, heuristic, resolve_chain
from ledgerloom.functions import jsonschema
from ledgerloom.operators import evaluation, extraction, observability, signals
from ledgerloom.service import Service
from ledgerloom.sources import filings
from ledgerloom.warehouse import Warehouse

WORDS = {"direction": ("bullish", "neutral", "bearish")}


def cases(spark):
    rows = [
        ("a", "t", {"direction": "bearish"}, None, {"section_text": "Sales fell and a loss is likely this year. We saw weak demand in every market we serve."}),
        ("b", "t", {"direction": "bullish"}, None, {"section_text": "Strong growth will improve profit in the coming year. Record orders came in from all the regions."}),
        ("c", "t", {}, "nothing labelled", {"section_text": "The board met in the usual place and time."}),
    ]
    return spark.createDataFrame(rows, "case_id string, task string, label map<string,string>, notes string, variables map<string,string>")


def test_run_and_compare(spark):
    def good(prompt, complaint):
        return heuristic(prompt, extraction.PayloadSchema("t", WORDS))

    def bad(prompt, complaint):
        return "no JSON at all"

    out = evaluation.run(cases(spark), F.col("variables")["section_text"], {"good": good, "bad": bad}, lambda v: [] if v.get("direction") in WORDS["direction"] else ["direction"])
    s = {r.model: r for r in evaluation.summary(out, ("model",)).collect()}
    assert s["good"].accuracy == 1.0 and s["good"].hallucination_rate == 0.0 and s["bad"].n_valid == 0 and s["bad"].hallucination_rate is None and s["bad"].latency_p95 == 0.0
    r = {r.model: r for r in evaluation.recommended(evaluation.summary(out, ("model",)), {"accuracy": (">=", 0.75), "hallucination_rate": ("<=", 0.05)}, ("cost_usd", "latency_p95")).collect()}
    assert r["good"].chosen and not r["bad"].chosen and len(r["bad"].reasons) == 1


def test_grading(spark):
    p = spark.createDataFrame([("a", {"direction": "bearish", "more": "x"}), ("b", None)], "case_id string, actual map<string,string>")
    g = {r.case_id: (r.correct, r.direction_correct) for r in evaluation.graded(cases(spark), p).collect()}
    assert g == {"a": (True, True), "b": (False, False), "c": (False, True)}


def test_empty_outcomes(spark):
    schema = "case_id string, expected map<string,string>, actual map<string,string>, confidence double, grounded_ratio double, hallucinated boolean, valid boolean, repair_attempts int, latency_ms double, cost_usd double, correct boolean, direction_correct boolean, model string"
    none = spark.createDataFrame([], schema)
    assert evaluation.summary(none).first().n == 0 and evaluation.macro_f1(none, "direction").first().macro_f1 == 0.0 and evaluation.confusion(none, "x").count() == 0
    c = evaluation.calibration(none).first()
    assert c.ece is None and c.brier is None


def test_overconfidence_looks_at_one_population(spark):
    rows = [("1", {"d": "x"}, {"d": "x"}, 0.9, True, True), ("2", {"d": "x"}, {"d": "y"}, 0.7, True, False), ("3", {"d": "x"}, None, None, False, False)]
    df = spark.createDataFrame(rows, "case_id string, expected map<string,string>, actual map<string,string>, confidence double, valid boolean, correct boolean")
    c = evaluation.calibration(df).first()
    assert (c.mean_confidence, c.overconfidence) == (0.8, 0.3)


def test_gate_needs_every_metric(spark):
    m = spark.createDataFrame([("t", "a", 0.0), ("t", "b", None)], "task string, metric string, value double")
    limits = spark.createDataFrame([("t", "a", "<=", 0.0), ("t", "b", "<=", 1.0), ("t", "c", ">=", 0.0)], "task string, metric string, op string, threshold double")
    assert {r.metric: r.passed for r in evaluation.gate(m, limits).collect()} == {"a": True, "b": False, "c": False}


def test_payloads(spark):
    schema = extraction.PayloadSchema("t", {"direction": ("bullish", "bearish")}, lists=("evidence",))
    full = {"direction": "bullish", "confidence": 85, "rationale": "r", "evidence": ["short", "a quote  that is long enough"]}
    rows = [(1, json.dumps(full)), (2, json.dumps(full | {"direction": "up"})), (3, json.dumps(full | {"x": 1})), (4, '{"direction": "bullish"}'), (5, "prose"), (6, None), (7, "[1]")]
    out = {r.n: r for r in extraction.validated(spark.createDataFrame(rows, "n int, payload string"), "payload", schema).collect()}
    assert [n for n, r in out.items() if r.valid] == [1] and out[1].fields.confidence == 0.85 and out[1].fields.evidence == ["a quote that is long enough"]
    assert "vocabulary" in out[2].errors[0] and out[3].errors == ["x: unknown field"] and out[4].errors == ["confidence: missing", "rationale: missing"] and out[6].errors == ["not a JSON object"]


def test_signals(spark):
    rows = [("1", 1.0, 1.0), ("2", -1.0, 0.0), ("3", 0.0, 0.9), ("4", 1.0, None)]
    df = spark.createDataFrame(rows, "id string, p double, c double").withColumn("s", signals.score(F.col("p"), F.col("c")))
    assert [r.s for r in df.orderBy("id").collect()] == [1.0, -0.25, 0.0, 0.25]
    assert [r.d for r in spark.createDataFrame([(0.1,), (0.11,), (-0.2,)], "s double").select(signals.direction(F.col("s")).alias("d")).collect()] == ["neutral", "bullish", "bearish"]
    with pytest.raises(ValueError):
        observability.cost_metrics(df, F.current_timestamp(), 0)


def test_sources(spark, tmp_path):
    (tmp_path / "tickers.json").write_text('{"0": {"cik_str": 7, "ticker": "ab", "title": "A"}, "1": {"cik_str": 8, "ticker": "AB", "title": "B"}}')
    t = filings.ticker_map(spark, str(tmp_path / "tickers.json"))
    assert filings.resolve_ticker(t, "aB").first().cik == "0000000007" and filings.resolve_ticker(t, "zz").count() == 0
    recent = {"accessionNumber": ["a-1", "a-2", "a-3", "a-4", "a-5"], "form": ["10-K", "4", "8-K", "10-Q", "10-K"], "filingDate": ["2021-01-01", "2021-01-01", "bad", "2020-01-01", "2019-01-01"], "primaryDocument": ["x.htm", "y", "z", "w.htm"], "items": [""]}
    (tmp_path / "s.json").write_text(json.dumps({"cik": "7", "name": "A", "tickers": [], "exchanges": ["N"], "filings": {"recent": recent}}))
    d = filings.submissions(spark, str(tmp_path / "s.json"))
    assert filings.companies_of(d).first().exchange == "N" and filings.companies_of(d).first().ticker is None
    f = filings.filings_of(d, "https://x.example")
    assert [(r.accession, r.url, r.items) for r in f.orderBy("pos").collect()] == [("a-1", "https://x.example/7/a1/x.htm", None), ("a-4", "https://x.example/7/a4/w.htm", None)]
    assert filings.filings_of(d, "https://x.example", since="2020-06-01").count() == filings.filings_of(d, "https://x.example", limit=1).count() == 1
    (tmp_path / "raw.htm").write_bytes(b"caf\xc3\xa9 \xff")
    assert filings.raw_documents(spark, str(tmp_path / "raw.htm")).first().html == "café �"
    (tmp_path / "cases.jsonl").write_text('// note\n\n{"case_id": "a", "task": "t", "label": {"d": "x"}, "variables": {"v": "y"}}\n')
    assert filings.load_cases(spark, str(tmp_path / "cases.jsonl")).first().label == {"d": "x"}
    with pytest.raises(ValueError, match="no cases"):
        filings.load_cases(spark, str(tmp_path / "cases.jsonl"), "other")
    (tmp_path / "broken.jsonl").write_text('// note\n{"case_id": "a", "task": "t", "label": {"d": "x"}, "variables": {"v": "y"}}\n{"case_id": \n')
    with pytest.raises(ValueError, match="broken.jsonl:3: not a case"):
        filings.load_cases(spark, str(tmp_path / "broken.jsonl"))


def test_fetching(tmp_path):
    calls, waits = [], []

    def transport(url):
        calls.append(url)
        if "gone" in url:
            raise filings.PermanentError("404")
        if len(calls) < 3:
            raise OSError("busy")
        return b"page"

    f = filings.CachedFetcher(transport, str(tmp_path), sleep=waits.append)
    assert f.get("u") == f.get("u") == b"page" and len(calls) == 3 and len(waits) == 2
    with pytest.raises(filings.PermanentError):
        f.get("gone")
    assert len(calls) == 4
    now = [0.0]
    limiter = filings.RateLimiter(2.0, clock=lambda: now[0], sleep=lambda s: now.__setitem__(0, now[0] + s))
    for _ in range(5):
        limiter.wait()
    assert now[0] == 2.0


def test_prompts_and_registries(spark, tmp_path):
    pytest.importorskip("yaml")
    (tmp_path / "skills").mkdir()
    (tmp_path / "skills" / "a.md").write_text("---\nname: s\n---\nbody a\n")
    for v in ("v9", "v10"):
        (tmp_path / f"{v}.md").write_text(f"---\nname: p\nversion: {v}\nvariables: [x]\n---\nsay {{{{ x }}}} {v}\n")
    p = filings.Prompts(str(tmp_path))
    assert p.get("p")["version"] == "v10" and len(p.get("p", "v9")["hash"]) == 16 and filings.load_skills(str(tmp_path / "skills")) == "body a"
    (tmp_path / "bad.md").write_text("---\nname: q\nversion: v1\nvariables: [x]\n---\nno variable\n")
    with pytest.raises(ValueError, match="not used"):
        filings.Prompts(str(tmp_path))
    (tmp_path / "models.yaml").write_text("models:\n  m1: {provider: p, model: x, price_in: 1}\n")
    assert filings.load_registry(spark, str(tmp_path / "models.yaml")).first().price_in == 1.0
    known = {"m1": Model("m1", "p"), "m2": Model("m2", "p")}
    assert [m.name for m in resolve_chain(known, {"default": ["m1", "m2"]}, env={})] == ["m1", "m2"] and resolve_chain(known, {}, "m2")[0].name == "m2"
    with pytest.raises(KeyError):
        resolve_chain(known, {}, "zz")


def test_json_schemas():
    s = {"type": "object", "properties": {"a": {"$ref": "#/$defs/A"}, "title": {"type": "string", "maxLength": 5}}, "$defs": {"A": {"type": "object", "properties": {"n": {"type": "integer", "minimum": 1}}}}}
    flat = jsonschema.flattened(s)
    assert flat["properties"]["a"]["properties"]["n"]["minimum"] == 1 and "$defs" not in flat
    plain = jsonschema.strict(flat)
    assert plain["required"] == ["a", "title"] and plain["properties"]["title"] == {"type": "string"} and plain["properties"]["a"]["additionalProperties"] is False
    with pytest.raises(ValueError):
        jsonschema.flattened({"$ref": "#/$defs/A", "$defs": {"A": {"items": {"$ref": "#/$defs/A"}}}})


def test_api(spark, tmp_path):
    s = Service(Warehouse.open(spark, f"file://{tmp_path}/w"))
    assert api.answer(s, "/health")[0] == 200 and api.answer(s, "/signals?limit=5")[1] == []
    assert api.answer(s, "/signals?limit=9999")[0] == api.answer(s, "/metrics/cost?days=0")[0] == api.answer(s, "/search?query=x&k=a")[0] == api.answer(s, "/review?x=1")[0] == 422
    assert api.answer(s, "/nowhere")[0] == 404 and api.answer(s, "/companies/zz/composite")[0] == 404 and "/alerts" in api.answer(s, "/paths")[1]["paths"]
    assert api.answer(s, "/config")[1]["tasks"] == ["event_class", "guidance_tone", "risk_delta"] and "/signals" in api.answer(s, "/openapi.json")[1]["paths"]


def test_settings_with_chains_and_embeddings(tmp_path):
    (tmp_path / "m.json").write_text(json.dumps({"models": [{"name": "a", "provider": "p", "price_in": 1}, {"name": "b", "provider": "q"}], "chains": {"default": ["b", "a"]}, "embeddings": {"default": "e", "models": [{"name": "e", "provider": "p", "dim": 8}, {"name": "f", "dim": 9}]}}))
    r = Registry.read(str(tmp_path / "m.json"))
    assert [m.name for m in r.chain(env={})] == ["b", "a"] and [m.name for m in r.chain(["a"])] == ["a"] and r.models["a"].price_in == 1.0
    assert r.embedding(env={})["dim"] == 8 and r.embedding(env={"LEDGERLOOM_EMBEDDING": "f"})["name"] == "f"
    with pytest.raises(KeyError):
        r.embedding("zz")


def test_index_in_batches(spark):
    from ledgerloom.operators import retrieval

    chunks = spark.createDataFrame([(f"c{n}", "a-1", "words here") for n in range(5)], "chunk_id string, accession string, text string")
    have = retrieval.embedded(chunks.filter("chunk_id = 'c0'"), "m")
    assert [r.chunk_id for r in retrieval.pending(chunks, have, "m", limit=2).collect()] == ["c1", "c2"] and retrieval.pending(chunks, have, "m", ["zz"]).count() == 0
    with pytest.raises(Exception, match="not 32"):
        retrieval.embedded(chunks, "m", 32).collect()


def test_commands(spark, tmp_path, capsys, monkeypatch):
    from ledgerloom import cli

    monkeypatch.setattr(cli, "_spark", lambda: spark)
    at = ["--warehouse", f"file://{tmp_path}/w"]
    body = "Orders declined in the northern district, and a loss is expected. We withdrew our outlook for the year. " * 4
    page = {"accession": "k-1", "cik": "1", "form": "10-K", "filing_date": "2020-01-01", "html": f"<p>Item 7. Management's Discussion and Analysis</p><p>{body}</p>"}
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text(json.dumps(page))
    (tmp_path / "cases.jsonl").write_text(json.dumps({"case_id": "a", "task": "guidance_tone", "label": {"direction": "bearish"}, "variables": {"section_text": body}}) + "\n")
    assert cli.main([*at, "init-db"]) == 0 and cli.main([*at, "ingest", str(tmp_path / "in")]) == 0
    Warehouse.open(spark, at[1]).upsert("companies", spark.createDataFrame([("1", "A", "AA")], "cik string, name string, ticker string"))
    for command in (["extract", "guidance_tone"], ["score"], ["signals"], ["alerts"], ["index"], ["search", "northern orders"], ["review"], ["doctor"], ["eval", "run", "guidance_tone", str(tmp_path / "cases.jsonl")], ["runs"]):
        assert cli.main([*at, *command]) == 0, command
    said = capsys.readouterr().out
    assert "forward guidance deteriorated" in said and "k-1:mdna" in said
    assert cli.main([*at, "eval", "gate", "guidance_tone", str(tmp_path / "cases.jsonl")]) == 0 and cli.main([*at, "agent", "why"]) == 2
    assert cli.main(["prompts"]) == 0 and cli.main(["models"]) == 0
