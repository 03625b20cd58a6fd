"""What an API or a command line offers over a warehouse: every function returns a DataFrame or plain values."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom import tasks
from ledgerloom.agent import loop, sandbox, sqltool
from ledgerloom.operators import observability, retrieval, signals
from ledgerloom.warehouse import Warehouse


def _bounded(name: str, value: int, least: int, most: int) -> int:
    if not least <= value <= most:
        raise ValueError(f"{name} must lie between {least} and {most}")
    return value


class Service:
    def __init__(self, warehouse: Warehouse, weights: dict[str, float] | None = None, model: str = "hash-64"):
        self.warehouse, self.weights, self.model = warehouse, tasks.WEIGHTS if weights is None else weights, model

    def health(self) -> DataFrame:
        """(table_name, n_rows) of the main tables."""
        return table_counts({n: self.warehouse.table(n) for n in ("filings", "signals", "alerts", "companies", "sections", "chunks")})

    def config(self) -> dict:
        """What this service is set to; no secrets."""
        state = self.warehouse.manifest()
        return {"warehouse": self.warehouse.path, "read_only": self.warehouse.read_only, "state": state["version"], "buckets": state["buckets"], "embedding": self.model, "weights": self.weights, "tasks": sorted(tasks.TASKS), "rules": [r.name for r in tasks.RULES]}

    def list_signals(self, limit: int = 50, **filters) -> DataFrame:
        return signals.listed(self.warehouse.table("signals"), self.warehouse.table("companies"), limit=_bounded("limit", limit, 1, 500), **filters)

    def company_composite(self, ticker: str) -> DataFrame:
        own = self.warehouse.table("companies").filter(F.upper("ticker") == ticker.upper()).select("cik")
        return signals.composite(self.warehouse.table("signals").join(own, "cik", "left_semi"), self.weights)

    def list_alerts(self, severity: str | None = None, limit: int = 50) -> DataFrame:
        """Alerts with their signal and company, gravest first."""
        a, s, c = self.warehouse.table("alerts"), self.warehouse.table("signals"), self.warehouse.table("companies")
        rows = alerts_view(a, s, c)
        if severity is not None:
            rows = rows.filter(F.col("severity") == severity)
        return rows.orderBy(signals.severity_rank(F.col("severity")), F.col("created_at").desc_nulls_last(), "alert_id").limit(_bounded("limit", limit, 1, 500))

    def search(self, query: str, mode: str = "hybrid", k: int = 8, **scope) -> DataFrame:
        _bounded("k", k, 1, 50)
        return retrieval.search(self.warehouse.table("chunks"), self.warehouse.table("embeddings"), query, self.model, mode, k, **scope)

    def costs(self, days: int = 30) -> DataFrame:
        return observability.cost_metrics(self.warehouse.table("traces"), F.current_timestamp(), _bounded("days", days, 1, 365))

    def eval_runs(self, task: str | None = None, limit: int = 20) -> DataFrame:
        rows = self.warehouse.table("eval_runs")
        if task is not None:
            rows = rows.filter(F.col("task") == task)
        return rows.orderBy(F.col("started_at").desc_nulls_last(), "run_id").limit(limit)

    def review(self, status: str = "open", task: str | None = None, limit: int = 50) -> DataFrame:
        rows = self.warehouse.table("review_queue").filter(F.col("status") == status)
        if task is not None:
            rows = rows.filter(F.col("task") == task)
        return rows.orderBy(F.col("priority").desc_nulls_last(), F.col("created_at").asc_nulls_last(), "review_id").limit(limit)

    def sql(self, text: str) -> DataFrame:
        self.warehouse.register(sqltool.schemas.READABLE)
        return sqltool.sql_query(self.warehouse.spark, text)

    def tools(self) -> list[loop.Tool]:
        """The tools of the agent."""
        shown = sqltool.as_table
        return [
            loop.Tool("search_filings", "passages on a question", {"query": {"type": "string"}, "k": {"type": "integer"}}, lambda query, k=5: shown(self.search(query, k=min(int(k), 10)))),
            loop.Tool("get_signals", "latest signals", {"cik": {"type": "string"}, "ticker": {"type": "string"}, "limit": {"type": "integer"}}, lambda limit=20, **f: shown(self.list_signals(min(int(limit), 50), **f))),
            loop.Tool("list_companies", "companies by filings", {"limit": {"type": "integer"}}, lambda limit=50: shown(signals.companies_overview(self.warehouse.table("companies"), self.warehouse.table("filings"), min(int(limit), 200)))),
            loop.Tool("sql_query", "read-only SQL", {"sql": {"type": "string"}}, lambda sql: shown(self.sql(sql))),
            loop.Tool("describe_schema", "tables and columns", {}, sqltool.describe),
            loop.Tool("run_python", "a small calculation", {"code": {"type": "string"}}, lambda code: str(sandbox.run_python(code))),
        ]

    def ask(self, question: str, model, **bounds) -> loop.Result:
        return loop.run(question, model, self.tools(), **bounds)


def table_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """(table_name, n_rows)"""
    out = None
    for name, t in tables.items():
        one = t.agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(name).alias("table_name"), "n_rows")
        out = one if out is None else out.unionByName(one)
    return out


def alerts_view(alerts: DataFrame, sig: DataFrame, companies: DataFrame) -> DataFrame:
    """Alerts joined to their signal, and to its company where there is one."""
    s = sig.select("signal_id", "cik", "name", F.col("ticker").alias("signal_ticker"))
    c = companies.select("cik", F.col("name").alias("company"), F.col("ticker").alias("company_ticker"))
    own = alerts.drop("score") if "score" in alerts.columns else alerts
    return own.join(s, "signal_id").join(c, "cik", "left").withColumn("ticker", F.coalesce("signal_ticker", "company_ticker")).drop("signal_ticker", "company_ticker")
