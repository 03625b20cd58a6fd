"""Costs, latencies and trees of recorded spans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.scalars import round_half_away
from ledgerloom.operators.quantiles import exact_quantiles, null_safe


def _money(x: str) -> Column:
    return F.sum(F.col(x).cast("decimal(20,8)")).cast("double")


def cost_metrics(traces: DataFrame, now: Column, days: int = 30) -> DataFrame:
    """(model, provider, calls, cached, tokens_in, tokens_out, cost_usd, avg_ms, p95_ms, errors) of model calls, dearest first."""
    if not 1 <= days <= 365:
        raise ValueError("days must lie between 1 and 365")
    rows = traces.filter((F.col("kind") == "llm") & (F.col("started_at") > now - F.make_dt_interval(F.lit(days))))
    by = ("model", "provider")
    p95 = exact_quantiles(rows, F.col("duration_ms"), {"p95_ms": 0.95}, by)
    per = rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("calls"), F.count_if(F.coalesce("cached", F.lit(False))).alias("cached"), F.sum("tokens_in").alias("tokens_in"),
        F.sum("tokens_out").alias("tokens_out"), round_half_away(_money("cost_usd"), 6).alias("cost_usd"),
        round_half_away(F.sum(F.col("duration_ms").cast("decimal(20,6)")).cast("double") / F.count("duration_ms"), 1).alias("avg_ms"),
        F.count_if(F.col("status") == "error").alias("errors"),
    )
    per = null_safe(per, p95, by, "left").withColumn("p95_ms", round_half_away(F.col("p95_ms"), 4))
    return per.orderBy(F.col("cost_usd").desc_nulls_last(), "model", "provider")


def totals(per_model: DataFrame) -> DataFrame:
    """(total_cost, calls, hit_rate) over the rows of cost_metrics; rate 0 without calls."""
    calls = F.coalesce(F.sum("calls"), F.lit(0))
    return per_model.agg(
        round_half_away(F.coalesce(_money("cost_usd"), F.lit(0.0)), 6).alias("total_cost"), calls.alias("calls"),
        F.when(calls > 0, round_half_away(F.sum("cached") / calls, 3)).otherwise(0.0).alias("hit_rate"),
    )


def trace_summary(traces: DataFrame) -> DataFrame:
    """One row: spans, llm_calls, cache_hits, errors, tokens, cost_usd, wall_ms (of root spans only)."""
    llm = F.col("kind") == "llm"
    return traces.agg(
        F.count(F.lit(1)).alias("spans"), F.count_if(llm).alias("llm_calls"), F.count_if(llm & F.coalesce("cached", F.lit(False))).alias("cache_hits"),
        F.count_if(F.col("status") == "error").alias("errors"), (F.coalesce(F.sum("tokens_in"), F.lit(0)) + F.coalesce(F.sum("tokens_out"), F.lit(0))).alias("tokens"),
        round_half_away(F.coalesce(_money("cost_usd"), F.lit(0.0)), 6).alias("cost_usd"),
        round_half_away(F.coalesce(F.sum(F.when(F.col("parent_id").isNull(), F.col("duration_ms")).cast("decimal(20,6)")).cast("double"), F.lit(0.0)), 1).alias("wall_ms"),
    )


def within_budget(calls: DataFrame, cap: float, by: str, order: str, cost: str = "cost_usd") -> DataFrame:
    """The calls of each group that a cap on the running cost lets through, checked before dispatch."""
    from pyspark.sql import Window

    w = Window.partitionBy(by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return calls.withColumn("running", F.sum(F.col(cost).cast("decimal(20,8)")).over(w)).filter(F.col("running") <= F.lit(cap).cast("decimal(20,8)"))


def daily(traces: DataFrame, every: str = "1 day") -> DataFrame:
    """(day, model, calls, cost_usd); also over a stream, after a watermark."""
    return traces.groupBy(F.window("started_at", every), "model").agg(F.count(F.lit(1)).alias("calls"), _money("cost_usd").alias("cost_usd")).select(
        F.col("window.start").alias("day"), "model", "calls", "cost_usd"
    )
