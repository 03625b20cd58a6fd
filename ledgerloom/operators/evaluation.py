"""Quality of predictions against labelled cases: grading, summaries, calibration, gates and comparisons.

An outcome has case_id, expected and actual (maps of strings, actual null where nothing valid came out), confidence,
grounded_ratio, hallucinated, valid, repair_attempts, latency_ms, cost_usd and model.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions import scalars
from ledgerloom.functions.scalars import round_half_away
from ledgerloom.operators.quantiles import exact_quantiles, null_safe


def graded(cases: DataFrame, predictions: DataFrame) -> DataFrame:
    """Cases (case_id, label) joined to predictions (case_id, actual, ...), with correct and direction_correct.

    correct: every labelled field is equal, as text. Without a labelled direction direction_correct is true. A case
    without a prediction is wrong.
    """
    rows = cases.select("case_id", F.col("label").alias("expected")).join(predictions, "case_id", "left")
    same = lambda k, v: F.coalesce(F.try_element_at("actual", k).eqNullSafe(v), F.lit(False))
    all_same = F.forall(F.map_entries("expected"), lambda e: same(e["key"], e["value"]))
    way = F.try_element_at("expected", F.lit("direction"))
    return rows.withColumn("correct", F.col("actual").isNotNull() & all_same).withColumn(
        "direction_correct", F.when(way.isNull(), F.lit(True)).otherwise(F.coalesce(F.try_element_at("actual", F.lit("direction")) == way, F.lit(False)))
    )


def _share(of: Column) -> Column:
    return F.avg(of.cast("int"))


def summary(outcomes: DataFrame, by: tuple[str, ...] = (), field: str = "direction") -> DataFrame:
    """One row (per group) of counts, rates, latencies, cost, calibration, and macro F1 and confusion of one labelled field.

    Rates over valid cases are null where none is valid, calibration where no valid case has a confidence. confusion is JSON,
    expected -> actual -> count. Tokens are counted where outcomes have them.
    """
    valid = F.col("valid")
    latency = exact_quantiles(outcomes, F.when(valid, F.col("latency_ms")), {"latency_p50": 0.5, "latency_p95": 0.95}, by)
    tokens = [F.coalesce(F.col(c), F.lit(0)) for c in ("tokens_in", "tokens_out") if c in outcomes.columns]
    cost = F.sum(F.col("cost_usd").cast("decimal(18,6)")).cast("double")
    rows = outcomes.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(valid).alias("n_valid"), _share(F.col("correct")).alias("accuracy"), _share(F.col("direction_correct")).alias("direction_accuracy"),
        _share(~valid).alias("schema_violation_rate"), _share(F.col("repair_attempts") > 0).alias("repair_rate"), F.avg("repair_attempts").alias("mean_repairs"),
        _share(F.when(valid, F.col("hallucinated"))).alias("hallucination_rate"), F.avg(F.when(valid, F.col("grounded_ratio"))).alias("mean_grounded_ratio"),
        cost.alias("cost_usd"), (cost / F.count(F.lit(1)) * 1000).alias("cost_per_1k"), F.coalesce(F.sum(sum(tokens, F.lit(0))), F.lit(0)).cast("long").alias("total_tokens"),
    )
    crossed = confusion(outcomes, field, by).groupBy(*by, "expected").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("actual", "n")))).alias("m"))  # labels only
    crossed = crossed.groupBy(*by).agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct("expected", F.to_json("m").alias("m")))))).alias("_c"))
    crossed = crossed.withColumn("confusion", F.replace(F.replace(F.replace(F.col("_c"), F.lit('\\"'), F.lit('"')), F.lit('"{'), F.lit("{")), F.lit('}"'), F.lit("}"))).drop("_c")
    for more in (latency, macro_f1(outcomes, field, by), calibration(outcomes, by=by), crossed):
        if not by:  # of one row, also where nothing was counted
            more = more.agg(*[F.max(c).alias(c) for c in more.columns])
        rows = null_safe(rows, more, by, "left")
    return rows.withColumns({c: F.coalesce(c, F.lit(0.0)) for c in ("latency_p50", "latency_p95", "macro_f1")})


def confusion(outcomes: DataFrame, field: str, by: tuple[str, ...] = ()) -> DataFrame:
    """(by, expected, actual, n): '?' where a label is missing, 'INVALID' where nothing valid came out."""
    want = F.coalesce(F.try_element_at("expected", F.lit(field)), F.lit("?"))
    got = F.when(F.col("actual").isNull(), "INVALID").otherwise(F.coalesce(F.try_element_at("actual", F.lit(field)), F.lit("?")))
    return outcomes.groupBy(*by, want.alias("expected"), got.alias("actual")).agg(F.count(F.lit(1)).alias("n"))


def macro_f1(outcomes: DataFrame, field: str, by: tuple[str, ...] = ()) -> DataFrame:
    """(by, macro_f1): the mean F1 of the labels that occur in the truth. No prediction counts as missed, not as wrong."""
    want, got = F.try_element_at("expected", F.lit(field)), F.try_element_at("actual", F.lit(field))
    hit = F.coalesce(want == got, F.lit(False))
    # one row per label and role; counts are combined before any shuffle
    roles = F.array(F.struct(want.alias("label"), hit.alias("hit"), F.lit(True).alias("truth")), F.struct(got.alias("label"), hit.alias("hit"), F.lit(False).alias("truth")))
    rows = outcomes.select(*by, F.explode(roles).alias("r")).select(*by, "r.*").filter(F.col("label").isNotNull())
    per = rows.groupBy(*by, "label").agg(
        F.count_if(F.col("hit") & F.col("truth")).alias("tp"), F.count_if(~F.col("hit") & ~F.col("truth")).alias("fp"), F.count_if(~F.col("hit") & F.col("truth")).alias("fn"), F.count_if("truth").alias("n")
    )
    f1 = F.when(F.col("tp") > 0, 2.0 * F.col("tp") / (2 * F.col("tp") + F.col("fp") + F.col("fn"))).otherwise(0.0)
    return per.filter("n > 0").groupBy(*by).agg(round_half_away(F.coalesce(F.avg(f1), F.lit(0.0)), 6).alias("macro_f1"))


def calibration(outcomes: DataFrame, bins: int = 10, by: tuple[str, ...] = ()) -> DataFrame:
    """(by, ece, brier, mean_confidence, overconfidence) over the valid outcomes with a confidence.

    overconfidence is the mean confidence, rounded to 4 places, less the accuracy of those same outcomes.
    """
    pool = outcomes.filter(F.col("valid") & F.col("confidence").isNotNull()).select(*by, "confidence", F.col("correct").cast("double").alias("hit"))
    b = F.least(F.floor(F.col("confidence") * bins).cast("int"), F.lit(bins - 1))
    per = pool.groupBy(*by, b.alias("bin")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("confidence").cast("decimal(18,9)")).cast("double").alias("conf"), F.sum("hit").alias("hits"),
        F.sum(F.pow(F.col("confidence") - F.col("hit"), 2).cast("decimal(18,9)")).cast("double").alias("sq"),
    )
    total = F.sum("n")
    mean = round_half_away(F.sum("conf") / total, 4)
    return per.groupBy(*by).agg(
        round_half_away(F.sum(F.abs(F.col("conf") - F.col("hits"))) / total, 6).alias("ece"), round_half_away(F.sum("sq") / total, 6).alias("brier"),
        mean.alias("mean_confidence"), round_half_away(mean - F.sum("hits") / total, 6).alias("overconfidence"),
    )


def served_models(outcomes: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """(by, models): the names of all models that answered, joined by '+'."""
    return outcomes.groupBy(*by).agg(F.array_join(F.array_sort(F.collect_set(F.nullif("model", F.lit("")))), "+").alias("models"))


def unpivoted(summaries: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, metric, value) of every figure of a summary."""
    figures = [c for c, t in summaries.dtypes if c not in keys and t != "string"]
    return summaries.select(*keys, *[F.col(c).cast("double") for c in figures]).unpivot(keys, figures, "metric", "value")


def gate(metrics: DataFrame, limits: DataFrame) -> DataFrame:
    """(task, metric, op, threshold, value, passed, message). limits: (task, metric, op, threshold), op <= or >=.

    A metric that is absent or null fails.
    """
    rows = limits.join(metrics, ["task", "metric"], "left")
    held = F.when(F.col("op") == "<=", F.col("value") <= F.col("threshold")).when(F.col("op") == ">=", F.col("value") >= F.col("threshold"))
    rows = rows.withColumn("passed", F.coalesce(held, F.lit(False)))
    shown = F.when(F.col("value").isNull(), "absent").otherwise(F.format_string("%.3f", "value"))
    return rows.withColumn("message", F.concat("metric", F.lit("="), shown, F.lit(" "), "op", F.lit(" "), F.format_string("%.3f", "threshold"), F.lit(" -> "), F.when(F.col("passed"), "PASS").otherwise("FAIL")))


def compared(summaries: DataFrame, by: str, metric: str = "accuracy") -> DataFrame:
    """Summaries with a flag at the best value of the metric."""
    best = summaries.agg(F.max(metric).alias("best"))
    return summaries.crossJoin(F.broadcast(best)).withColumn("is_best", F.col(metric) == F.col("best")).drop("best").orderBy(by)


def recommended(summaries: DataFrame, limits: dict[str, tuple[str, float]], order: tuple[str, ...], key: str = "model") -> DataFrame:
    """Each candidate with its reasons for rejection, and chosen for the first qualified one by the order.

    limits: metric -> (op, threshold); a null metric counts as 0, so that a calibration that was not measured rejects no one.
    """
    checks = []
    for metric, (op, threshold) in limits.items():
        value = F.coalesce(F.col(metric), F.lit(0.0))
        bad = value > threshold if op == "<=" else value < threshold
        checks.append(F.when(bad, F.concat(F.lit(f"{metric} "), F.format_string("%.3f", value), F.lit(f" not {op} {threshold}"))))
    rows = summaries.withColumn("reasons", F.array_compact(F.array(*checks)))
    best = rows.filter(F.size("reasons") == 0).agg(F.min_by(key, F.struct(*order, key)).alias("best"))
    return rows.crossJoin(F.broadcast(best)).withColumn("chosen", F.coalesce(F.col(key) == F.col("best"), F.lit(False))).drop("best")


# What a model must reach to be recommended, in which order the qualified ones stand, and what a run must reach.
RECOMMENDED = {"direction_accuracy": (">=", 0.75), "hallucination_rate": ("<=", 0.05), "schema_violation_rate": ("<=", 0.1), "ece": ("<=", 0.2)}
CHEAPEST = ("cost_per_1k", "latency_p95")
GATES = (
    ("guidance_tone", "schema_violation_rate", "<=", 0.0), ("guidance_tone", "hallucination_rate", "<=", 0.0), ("guidance_tone", "direction_accuracy", ">=", 0.4),
    ("event_class", "schema_violation_rate", "<=", 0.0), ("event_class", "hallucination_rate", "<=", 0.0),
    ("risk_delta", "schema_violation_rate", "<=", 0.0), ("risk_delta", "hallucination_rate", "<=", 0.0),
)


def failing(outcomes: DataFrame, most: int = 8) -> DataFrame:
    return outcomes.filter(~F.col("correct")).orderBy("case_id").limit(most)


#: A case's own text, in which evidence must stand: the first of these that it has.
SOURCES = ("section_text", "current_text")


def run(cases: DataFrame, prompts: Column | dict[str, Column], models: dict, check) -> DataFrame:
    """Outcomes of every case under every model and prompt: extraction, grounding in the case's own text, and grading.

    models: name -> complete(prompt, complaint); prompts: version -> prompt (one alone has version ''). Payload fields become the
    actual label. model is the one that answered, or else the name asked for, candidate is that name. Latency, cost and
    tokens are those of the calls; the answers are written once, so that no model is asked twice.
    """
    from ledgerloom.operators import extraction
    from ledgerloom.plans.cut import written

    prompts = prompts if isinstance(prompts, dict) else {"": prompts}
    out = None
    for version, prompt in prompts.items():
        units = cases.select("case_id", "variables", prompt.alias("prompt"))
        for name, complete in models.items():
            got = extraction.extract(units, complete, check).withColumn("candidate", F.lit(name)).withColumn("prompt_version", F.lit(version))
            out = got if out is None else out.unionByName(got)
    out = written(out, "evaluation-answers")
    actual = F.when(F.col("valid"), F.from_json("payload", "map<string,string>"))
    quotes = F.coalesce(F.from_json(F.get_json_object("payload", "$.evidence"), "array<string>"), F.array().cast("array<string>"))
    source = F.coalesce(*[F.try_element_at("variables", F.lit(v)) for v in SOURCES], F.lit(""))
    rows = extraction.with_grounding(out, "g", quotes, source)
    predictions = rows.select(
        "case_id", F.coalesce(F.nullif("model", F.lit("")), "candidate").alias("model"), "provider", "candidate", "prompt_version", actual.alias("actual"),
        scalars.clamped_confidence(F.get_json_object("payload", "$.confidence").try_cast("double")).alias("confidence"), "valid", "repair_attempts",
        F.when(F.col("valid"), F.col("g.ratio")).otherwise(0.0).alias("grounded_ratio"), (F.col("valid") & (F.col("g.grounded") < F.col("g.total"))).alias("hallucinated"),
        "latency_ms", "cost_usd", "tokens_in", "tokens_out", "error",
    )
    return graded(cases, predictions)


def run_rows(outcomes: DataFrame, task: str, suite: str, prompt: dict, started_at, duration_s: float, git_sha: str = "", notes: str = "", field: str = "direction") -> tuple[DataFrame, DataFrame]:
    """Rows of eval_runs and eval_results for the outcomes of run(), one run per candidate and prompt version.

    A run's id digests suite, task, candidate, prompt and start. prompt: name, and version and hash, or dicts of them by version.
    """
    by = ("candidate", "prompt_version")
    of = lambda k: F.lit(prompt.get(k) or "") if not isinstance(prompt.get(k), dict) else F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in prompt[k].items() for x in kv]), F.col("prompt_version")), F.lit(""))
    version = F.when(F.col("prompt_version") == "", of("version")).otherwise(F.col("prompt_version"))
    run_id = F.substring(scalars.stable_id(F.lit(suite), F.lit(task), F.col("candidate"), F.lit(prompt["name"]), version, F.lit(str(started_at))), 1, 16)
    served = null_safe(served_models(outcomes, by), outcomes.groupBy(*by).agg(F.array_join(F.array_sort(F.collect_set(F.nullif("provider", F.lit("")))), "+").alias("providers")), by)
    sums = summary(outcomes, by, field)
    metrics = F.to_json(F.struct(*[c for c in sums.columns if c not in by]))
    runs = null_safe(sums.select(*by, "n", "cost_usd", metrics.alias("metrics")), served, by).select(
        run_id.alias("run_id"), F.lit(suite).alias("suite"), F.lit(task).alias("task"), F.coalesce(F.nullif("models", F.lit("")), "candidate").alias("model"), F.col("providers").alias("provider"),
        F.lit(prompt["name"]).alias("prompt_name"), version.alias("prompt_version"), of("hash").alias("prompt_hash"), F.col("n").cast("int").alias("n_cases"), "metrics", F.lit(git_sha).alias("git_sha"),
        F.lit(started_at).cast("timestamp").alias("started_at"), F.lit(float(duration_s)).alias("duration_s"), F.col("cost_usd").alias("total_cost_usd"), F.lit(notes).alias("notes"),
    )
    scores = F.to_json(F.struct("direction_correct", "confidence", "grounded_ratio", "repair_attempts"))
    results = outcomes.select(
        F.concat_ws(":", run_id, "case_id").alias("result_id"), run_id.alias("run_id"), "case_id", F.to_json("expected").alias("expected"), F.to_json("actual").alias("actual"), "correct",
        scores.alias("scores"), "latency_ms", "cost_usd", "error",
    )
    return runs, results
