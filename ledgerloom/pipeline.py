"""From a warehouse's filings to extractions, reviews, signals and alerts, and evaluation runs, each step stored."""

from __future__ import annotations

import time
from collections.abc import Callable
from datetime import UTC, datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom import tasks
from ledgerloom.operators import evaluation, extraction, signals, units
from ledgerloom.plans.cut import written
from ledgerloom.warehouse import Warehouse

#: A prompt for offline use, where no prompt files are given: the unit's own text.
PLAIN = {t: "<document>{{ current_text }}</document>" if t == "risk_delta" else "<document>{{ section_text }}</document>" for t in tasks.TASKS}


def plain_prompt(task: str) -> dict:
    import hashlib

    return {"name": task, "version": "plain", "hash": hashlib.sha256(PLAIN[task].encode()).hexdigest()[:16], "body": PLAIN[task]}


def _dated(rows: DataFrame) -> DataFrame:
    return rows.withColumn("created_at", F.current_timestamp())


class Pipeline:
    def __init__(self, warehouse: Warehouse):
        self.warehouse = warehouse

    def units(self, task: str, cik: str | None = None, limit: int | None = None) -> DataFrame:
        w = self.warehouse
        return tasks.build_units(task, w.table("sections"), w.table("filings"), units.latest(w.table("companies"), "cik"), cik, limit)

    def extract(self, task: str, complete: Callable, prompt: dict | None = None, cik: str | None = None, limit: int | None = None) -> DataFrame:
        """Runs a task over all units that qualify, and stores extractions and the reviews of weak ones; the stored rows.

        The answers are written before they are used, so that no model is asked twice for a unit.
        """
        prompt = prompt or plain_prompt(task)
        schema = tasks.TASKS[task].schema if task in tasks.TASKS else None
        answers = extraction.extract(tasks.prompted(self.units(task, cik, limit), prompt["body"]), complete, schema.check)
        rows = written(extraction.records(written(answers, "answers"), schema, prompt), "extractions")
        self.warehouse.upsert("extractions", _dated(rows.drop("confidence", "hallucinated", "ungrounded", "raw")))
        self.warehouse.upsert("review_queue", _dated(extraction.reviews(rows, tasks.PRIORITIES)))
        return rows

    def score(self, task: str | None = None, cik: str | None = None) -> tuple[DataFrame, DataFrame]:
        """Scores the stored extractions anew and stores signals and alerts; (signals, alerts)."""
        w = self.warehouse
        found = signals.score_stored(w.table("extractions"), w.table("filings"), units.latest(w.table("companies"), "cik"), tasks.SCORING, task, cik)
        found = written(found, "signals")
        w.upsert("signals", _dated(found.withColumn("evidence", F.to_json("evidence")).withColumn("extraction_ids", F.to_json("extraction_ids"))))
        raised = written(signals.alerts(found, tasks.RULES), "alerts")
        w.upsert("alerts", _dated(raised.drop("score")))
        return found, raised

    def evaluate(self, task: str, cases: DataFrame, models: dict[str, Callable], prompts: dict[str, dict] | None = None, suite: str = "default", store: bool = True, git_sha: str = "", notes: str = "") -> DataFrame:
        """Grades every model under every prompt over the same cases; the outcomes. One model and several prompts compare prompts.

        Runs and results are stored unless store is false. An unknown task is a KeyError.
        """
        if task not in tasks.TASKS:
            raise KeyError(f"no task {task!r}")
        prompts = prompts or {"plain": plain_prompt(task)}
        began, started = time.monotonic(), datetime.now(UTC)
        said = {v: tasks.filled(p["body"]) for v, p in prompts.items()}
        outcomes = written(evaluation.run(cases.filter(F.col("task") == task), said, models, tasks.TASKS[task].schema.check), "outcomes")
        if store:
            meta = {"name": next(iter(prompts.values()))["name"], "hash": {v: p["hash"] for v, p in prompts.items()}}
            runs, results = evaluation.run_rows(outcomes, task, suite, meta, started, round(time.monotonic() - began, 2), git_sha, notes)
            self.warehouse.upsert("eval_runs", runs)
            self.warehouse.upsert("eval_results", results)
        return outcomes

