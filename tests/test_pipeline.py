import json
from datetime import date

import pytest
from pyspark.sql import functions as F

from ledgerloom import tasks
from ledgerloom.agent.router import Model, Router, asking, offline
from ledgerloom.operators import extraction, signals
from ledgerloom.pipeline import Pipeline, plain_prompt
from ledgerloom.warehouse import Warehouse

FALL = "Orders declined in the northern district, and a loss is expected for the year. We withdrew our outlook for the coming quarter. "
RISE = "Demand grew in every district, and we raised our outlook for the year. A record number of orders came in over the summer. "


@pytest.fixture
def stocked(spark, tmp_path):
    w = Warehouse.open(spark, f"file://{tmp_path}/w")
    w.upsert("companies", spark.createDataFrame([("1", "A", "AA"), ("2", "B", None)], "cik string, name string, ticker string"))
    filings = [("k-1", "1", "10-K", date(2020, 3, 1), None), ("k-2", "1", "10-K", date(2021, 3, 1), date(2020, 12, 31)), ("e-1", "2", "8-K", date(2021, 5, 1), None), ("q-1", "2", "10-Q", date(2021, 6, 1), None)]
    w.upsert("filings", spark.createDataFrame(filings, "accession string, cik string, form string, filing_date date, report_date date"))
    sections = [
        ("k-1:mdna", "k-1", "mdna", "H", 0, RISE * 3), ("k-2:mdna", "k-2", "mdna", "H", 0, FALL * 3), ("k-1:risk_factors", "k-1", "risk_factors", "H", 1, RISE), ("k-2:risk_factors", "k-2", "risk_factors", "H", 1, FALL),
        ("e-1:auditor_change", "e-1", "auditor_change", "Item 4.01", 0, FALL), ("e-1:other_events", "e-1", "other_events", "Item 8.01", 1, FALL), ("q-1:results_of_operations", "q-1", "results_of_operations", "H", 0, RISE),
    ]
    w.upsert("sections", spark.createDataFrame(sections, "section_id string, accession string, slug string, heading string, ordinal int, text string"))
    return Pipeline(w)


def test_from_filings_to_alerts(stocked):
    w = stocked.warehouse
    for name, task in tasks.TASKS.items():
        stocked.extract(name, offline(task.schema))
    rows = {(r.task, r.accession): r for r in w.table("extractions").collect()}
    assert set(rows) == {("guidance_tone", "k-1"), ("guidance_tone", "k-2"), ("guidance_tone", "q-1"), ("risk_delta", "k-2"), ("event_class", "e-1")}
    assert all(r.valid and r.grounded_ratio == 1.0 and r.model == "heuristic" and r.latency_ms > 0 and r.created_at is not None for r in rows.values())
    assert json.loads(rows["guidance_tone", "k-2"].payload)["direction"] == "bearish" and rows["event_class", "e-1"].section_id is None
    found, raised = stocked.score()
    stored = {(r.name, r.accession): r for r in w.table("signals").collect()}
    assert stored["guidance_tone", "k-2"].score < -0.5 and stored["guidance_tone", "k-2"].as_of == date(2020, 12, 31) and stored["guidance_tone", "k-2"].ticker == "AA"
    assert json.loads(stored["risk_delta", "k-2"].evidence) and json.loads(stored["risk_delta", "k-2"].extraction_ids) == [rows["risk_delta", "k-2"].extraction_id]
    assert stored["event_class", "e-1"].direction == "bearish" and stored["guidance_tone", "k-1"].score > 0
    alerts = {(a.rule, a.severity, a.headline) for a in w.table("alerts").collect()}
    assert ("guidance_withdrawn_or_cut", "critical", "AA: forward guidance deteriorated") in alerts and ("high_materiality_event", "critical", "2: material negative 8-K event") in alerts
    assert all(a.detail for a in raised.collect())
    n = {t: w.table(t).count() for t in ("extractions", "signals", "alerts", "review_queue")}
    stocked.extract("guidance_tone", offline(tasks.TASKS["guidance_tone"].schema))
    stocked.score()
    assert n == {t: w.table(t).count() for t in n}  # again changes nothing


def test_weak_extractions_are_queued(stocked):
    full = {"direction": "bearish", "guidance_change": "none", "confidence": 0.9, "rationale": "r", "evidence": ["Orders declined in the northern district"]}
    answers = {"k-1": json.dumps(full | {"evidence": ["a sentence that stands nowhere at all"]}), "k-2": json.dumps(full | {"confidence": 30, "evidence": []}), "q-1": "prose"}

    def complete(prompt, complaint):
        return answers["q-1" if "10-Q" in prompt else "k-1" if "Demand grew" in prompt else "k-2"]

    stocked.extract("guidance_tone", complete, plain_prompt("guidance_tone") | {"body": "{{ form }} {{ section_text }}"})
    queue = {r.reason: r for r in stocked.warehouse.table("review_queue").collect()}
    assert {k: r.priority for k, r in queue.items()} == {"ungrounded": 7, "low_confidence": 3, "invalid": 9} and all(r.status == "open" for r in queue.values())
    assert json.loads(queue["ungrounded"].proposed)["ungrounded_quotes"] == ["a sentence that stands nowhere at all"] and json.loads(queue["invalid"].proposed)["raw"] == "prose"
    bad = stocked.warehouse.table("extractions").filter("NOT valid").first()
    assert bad.payload == "{}" and bad.repair_attempts == 2 and bad.error == "not a JSON object" and bad.grounded_ratio == 0.0
    found, _ = stocked.score()
    assert [r.accession for r in found.collect()] == ["k-2"]  # the ungrounded one is left out


def test_units(stocked):
    assert [r.unit_id for r in stocked.units("guidance_tone", limit=2).collect()] == ["q-1:results_of_operations", "k-2:mdna"]
    assert [r.unit_id for r in stocked.units("guidance_tone", cik="1").collect()] == ["k-2:mdna", "k-1:mdna"]
    (r,) = stocked.units("risk_delta").collect()
    assert r.source_text == FALL.strip() and r.variables["prior_text"] == RISE.strip() and r.variables["prior_period"] == "2020-03-01"
    (e,) = stocked.units("event_class").collect()
    assert e.section_id is None and e.variables["items"] == "(none reported)" and "Item 4.01\n" in e.source_text
    with pytest.raises(KeyError):
        stocked.units("nothing")
    with pytest.raises(Exception, match="names x"):
        tasks.prompted(stocked.units("risk_delta"), "{{ x }}").collect()


def test_evaluation_runs_are_stored(spark, stocked):
    rows = [
        ("a", "guidance_tone", {"direction": "bearish"}, {"section_text": FALL}), ("b", "guidance_tone", {"direction": "bullish", "guidance_change": "none"}, {"section_text": RISE}),
        ("c", "event_class", {"direction": "bullish"}, {"section_text": RISE}),
    ]
    cases = spark.createDataFrame(rows, "case_id string, task string, label map<string,string>, variables map<string,string>")
    schema = tasks.TASKS["guidance_tone"].schema
    priced = Router([Model("paid", "p", 1.0, 2.0)], {"p": lambda m, r: offline(schema)(r["prompt"], None).text})
    two = {v: plain_prompt("guidance_tone") | {"version": v, "hash": v * 2, "body": v + " <document>{{ section_text }}</document>"} for v in ("v1", "v2")}
    out = stocked.evaluate("guidance_tone", cases, {"free": offline(schema)}, two, "prompt_ab")
    assert out.count() == 4 and out.filter("latency_ms > 0").count() == 4
    stocked.evaluate("guidance_tone", cases, {"paid": asking(priced), "bad": lambda p, c: "no"}, suite="bakeoff")
    runs = {(r.suite, r.model, r.prompt_version): r for r in stocked.warehouse.table("eval_runs").collect()}
    assert set(runs) == {("prompt_ab", "heuristic", "v1"), ("prompt_ab", "heuristic", "v2"), ("bakeoff", "paid", "plain"), ("bakeoff", "bad", "plain")}
    m = json.loads(runs["bakeoff", "paid", "plain"].metrics)
    assert m["n"] == 2 and m["cost_usd"] > 0 and m["cost_per_1k"] > 0 and m["total_tokens"] > 0 and m["direction_accuracy"] == 1.0 and m["macro_f1"] == 1.0 and "ece" in m and json.loads(m["confusion"])["bearish"] == {"bearish": 1}
    assert runs["prompt_ab", "heuristic", "v2"].prompt_hash == "v2v2" and runs["bakeoff", "bad", "plain"].total_cost_usd == 0.0
    results = stocked.warehouse.table("eval_results")
    assert results.count() == 8 and json.loads(results.filter("correct").first().scores)["direction_correct"] is True
    assert stocked.evaluate("guidance_tone", cases, {"free": offline(schema)}, store=False).count() == 2 and results.count() == 8


PAYLOADS = [
    {}, {"direction": None}, {"direction": "up"}, {"direction": 3}, {"confidence": "high"}, {"confidence": None}, {"confidence": "0.7"}, {"confidence": 85}, {"confidence": -3}, {"confidence": [1]}, {"rationale": None}, {"rationale": 5},
    {"evidence": "text"}, {"evidence": None}, {"evidence": ["long enough to be a quote", None]}, {"evidence": [3]}, {"evidence": []}, {"evidence": [None]}, {"more": 1}, {"evidence": ["short", "  long enough   to be a quote  "]},
]


def test_both_checks_of_payloads_agree(spark):
    schema = tasks.TASKS["guidance_tone"].schema
    full = {"direction": "bearish", "guidance_change": "none", "confidence": 0.5, "rationale": "r", "evidence": []}
    values = [full | p for p in PAYLOADS] + [{k: v for k, v in full.items() if k != gone} for gone in full] + [[1], "x", 3]
    df = spark.createDataFrame([(n, json.dumps(v)) for n, v in enumerate(values)] + [(99, None), (98, "{broken")], "n int, payload string")
    out = {r.n: r for r in extraction.validated(df, "payload", schema).collect()}
    for n, v in enumerate(values):
        assert out[n].errors == schema.check(v), v
    assert out[99].errors == out[98].errors == ["not a JSON object"]
    conf = lambda p: next(out[n].fields.confidence for n, v in enumerate(values) if v == full | p)
    assert (conf({"confidence": "0.7"}), conf({"confidence": 85}), conf({"confidence": -3}), conf({"confidence": "high"}), conf({"confidence": None})) == (0.7, 0.85, 0.0, None, None)
    assert not out[1].valid and out[len(PAYLOADS) - 1].fields.evidence == ["long enough to be a quote"] and out[len(PAYLOADS) + 4].valid  # evidence may lack


def test_polarity(spark):
    rows = [("guidance_tone", {"direction": "bullish", "guidance_change": "lowered"}, -1.0), ("guidance_tone", {"direction": "bullish", "guidance_change": "none"}, 0.6), ("risk_delta", {"direction": "bearish", "severity": "medium"}, -0.65), ("event_class", {"direction": "neutral", "materiality": "high"}, 0.0)]
    for task, fields, want in rows:
        df = spark.createDataFrame([tuple(fields.values())], list(fields)).select(F.struct("*").alias("f"))
        assert df.select(tasks.TASKS[task].polarity(F.col("f")).alias("p")).first().p == want


def test_stale_payloads_have_no_signal(spark, stocked):
    rows = [("x1", "guidance_tone", "k-1", "1", '{"direction": "sideways"}', True, 1.0), ("x2", "guidance_tone", "k-1", "1", "{}", False, 1.0), ("x3", "unknown", "k-1", "1", "{}", True, 1.0)]
    df = spark.createDataFrame(rows, "extraction_id string, task string, accession string, cik string, payload string, valid boolean, grounded_ratio double")
    w = stocked.warehouse
    assert signals.score_stored(df, w.table("filings"), w.table("companies"), tasks.SCORING).count() == 0
