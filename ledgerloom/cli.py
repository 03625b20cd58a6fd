"""python -m ledgerloom.cli COMMAND: a warehouse from the command line.

Models are taken from a settings file (--models) and asked at --url; without one the offline reader answers.
"""

from __future__ import annotations

import argparse
import json
import sys


def _spark():
    from ledgerloom.session import session

    return session("ledgerloom")


def _parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="ledgerloom")
    p.add_argument("--warehouse", default="warehouse")
    p.add_argument("--prompts", help="folder of prompt files")
    p.add_argument("--models", help="file of model settings")
    p.add_argument("--url", default="http://127.0.0.1:11434/api/chat", help="chat endpoint of the models")
    sub = p.add_subparsers(dest="command", required=True)
    one = (("--chain", None), ("--limit", None), ("--prompt-version", None))
    commands = {
        "init-db": ([], []), "doctor": ([], []), "companies": ([], []), "review": ([], [("--task", None), ("--limit", "50")]), "costs": ([], []), "runs": ([], []), "schema": ([], []), "prompts": ([], []), "models": ([], []),
        "ingest": (["folder"], []), "index": ([], [("--model", "hash-64")]), "search": (["query"], [("--mode", "hybrid"), ("--k", "8")]), "sql": (["text"], []),
        "extract": (["task"], [*one, ("--cik", None)]), "score": ([], [("--task", None), ("--cik", None)]), "signals": ([], [("--ticker", None), ("--limit", "50")]),
        "composite": (["ticker"], []), "alerts": ([], [("--severity", None)]), "agent": (["question"], [("--chain", None), ("--max-steps", "8")]),
        "eval": (["what", "task", "cases"], [*one, ("--candidates", "offline"), ("--versions", None)]), "query": (["name", "root"], []), "python": (["code"], []), "serve": ([], [("--port", "8000")]),
    }
    for name, (positional, options) in commands.items():
        s = sub.add_parser(name)
        for x in positional:
            s.add_argument(x, **({"choices": ("run", "bakeoff", "ab", "gate")} if x == "what" else {}))
        for x, d in options:
            s.add_argument(x, default=d)
    return p


def _router(a, chain: str | None):
    from ledgerloom.agent.router import Registry, Router, over_http

    registry = Registry.read(a.models)
    models = registry.chain(chain)
    return Router(models, {m.provider: over_http(a.url) for m in models})


def _complete(a, task: str, name: str | None = None):
    """complete(prompt, complaint) of a task: by a chain or model of the settings, or offline."""
    from ledgerloom.agent.router import asking, offline
    from ledgerloom.tasks import TASKS

    schema = TASKS[task].schema
    return offline(schema) if not a.models or name == "offline" else asking(_router(a, name), schema)


def _prompt(a, task: str, version: str | None) -> dict | None:
    from ledgerloom.sources.filings import Prompts

    return Prompts(a.prompts).get(task, version) if a.prompts else None


def _evaluate(a, pipeline, spark) -> int:
    """eval run, bakeoff (several models), ab (several prompts) and gate; the exit code of gate says whether it held."""
    from pyspark.sql import functions as F

    from ledgerloom.operators import evaluation
    from ledgerloom.sources.filings import Prompts, load_cases

    cases = load_cases(spark, a.cases, a.task)
    if a.limit:
        cases = cases.orderBy("case_id").limit(int(a.limit))
    names = a.candidates.split(",") if a.what == "bakeoff" else [a.chain or "offline"]
    prompts = None
    if a.prompts:
        own = Prompts(a.prompts)
        versions = (a.versions.split(",") if a.versions else own.versions(a.task)) if a.what == "ab" else [own.get(a.task, a.prompt_version)["version"]]
        prompts = {str(v): own.get(a.task, str(v)) for v in versions}
    out = pipeline.evaluate(a.task, cases, {n: _complete(a, a.task, n) for n in names}, prompts, suite=a.what, store=a.what != "gate")
    by = ("candidate", "prompt_version")
    sums = evaluation.summary(out, by)
    evaluation.recommended(sums, evaluation.RECOMMENDED, evaluation.CHEAPEST, "candidate").drop("confusion").show(truncate=60, vertical=True)
    evaluation.failing(out).select("case_id", "candidate", "expected", "actual", "error").show(truncate=60)
    if a.what != "gate":
        return 0
    limits = spark.createDataFrame([g for g in evaluation.GATES if g[0] == a.task], "task string, metric string, op string, threshold double")
    held = evaluation.gate(evaluation.unpivoted(sums.withColumn("task", F.lit(a.task)).drop(*by), ["task"]), limits)
    held.select("message").show(truncate=False)
    return 1 if held.filter("NOT passed").count() else 0


def main(args: list[str] | None = None) -> int:
    a = _parser().parse_args(args)
    if a.command == "python":
        from ledgerloom.agent.sandbox import run_python

        print(run_python(a.code))
        return 0
    if a.command == "schema":
        from ledgerloom.agent.sqltool import describe

        print(describe())
        return 0
    if a.command == "prompts":
        from ledgerloom.sources.filings import Prompts

        print("\n".join(json.dumps(x) for x in (Prompts(a.prompts).manifest() if a.prompts else [])))
        return 0
    if a.command == "models":
        from ledgerloom.agent.router import Registry

        r = Registry.read(a.models) if a.models else Registry({})
        print(json.dumps({"models": [vars(m) for m in r.models.values()], "chains": r.chains, "embeddings": r.embeddings}, indent=1))
        return 0
    spark = _spark()
    if a.command == "query":
        from ledgerloom.queries import queries

        queries()[a.name](spark, a.root).show(50, truncate=80)
        return 0
    from ledgerloom.pipeline import Pipeline
    from ledgerloom.service import Service
    from ledgerloom.warehouse import Warehouse

    w = Warehouse.open(spark, a.warehouse)
    service, pipeline = Service(w), Pipeline(w)
    if a.command == "init-db":
        print(json.dumps({"warehouse": a.warehouse}))
    elif a.command == "ingest":
        from ledgerloom.operators import ingest
        from ledgerloom.plans.cut import written

        raw = spark.read.schema("accession string, cik string, form string, filing_date date, html string").json(a.folder)
        parsed = written(ingest.parsed(raw), "parsed")
        sections = ingest.sections_of(parsed)
        chunks = written(ingest.chunks_of(sections, parsed), "chunks")
        w.ingest_filing_rows(parsed.select("accession", "cik", "form", "filing_date"), sections, chunks, ingest.parse_reviews(parsed))
        ingest.report(parsed, sections, chunks).show()
        ingest.skipped(parsed).show(20, truncate=80)
    elif a.command == "extract":
        rows = pipeline.extract(a.task, _complete(a, a.task, a.chain), _prompt(a, a.task, a.prompt_version), a.cik, int(a.limit) if a.limit else None)
        rows.selectExpr("count(*) AS units", "count_if(valid) AS valid", "sum(repair_attempts) AS repairs", "count_if(hallucinated) AS hallucinated", "sum(cost_usd) AS cost_usd").show()
    elif a.command == "score":
        found, raised = pipeline.score(a.task, a.cik)
        found.orderBy("score", "signal_id").select("ticker", "name", "score", "confidence", "direction", "as_of").show(20)
        raised.select("severity", "headline").show(50, truncate=100)
    elif a.command == "eval":
        return _evaluate(a, pipeline, spark)
    elif a.command == "agent":
        from ledgerloom.agent.loop import Reply

        if not a.models:
            print("the agent needs a model: --models FILE", file=sys.stderr)
            return 2
        router = _router(a, a.chain)

        def ask(messages: list[dict]) -> Reply:
            said = router.complete({"messages": messages})
            return Reply(said.text, cost_usd=said.cost_usd)

        r = service.ask(a.question, ask, max_steps=int(a.max_steps))
        print(r.answer, json.dumps({"stopped": r.stopped, "steps": [s.tool for s in r.steps]} | router.stats()), sep="\n")
    elif a.command == "serve":
        from ledgerloom.api import serve

        serve(service, int(a.port)).serve_forever()
    elif a.command == "index":
        from ledgerloom.operators import retrieval

        new = retrieval.embedded(retrieval.pending(w.table("chunks"), w.table("embeddings"), a.model), a.model)
        w.upsert("embeddings", new)
        retrieval.index_stats(w.table("chunks"), w.table("embeddings")).show()
    else:
        shown = {
            "doctor": service.health, "companies": lambda: service.sql("SELECT cik, name, ticker FROM companies ORDER BY cik"), "review": lambda: service.review(task=a.task, limit=int(a.limit)), "costs": service.costs, "runs": service.eval_runs,
            "search": lambda: service.search(a.query, a.mode, int(a.k)), "sql": lambda: service.sql(a.text), "signals": lambda: service.list_signals(int(a.limit), ticker=a.ticker),
            "composite": lambda: service.company_composite(a.ticker), "alerts": lambda: service.list_alerts(a.severity),
        }
        shown[a.command]().show(50, truncate=80)
    return 0


if __name__ == "__main__":
    sys.exit(main())
