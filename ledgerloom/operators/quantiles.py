"""Exact quantiles that keep no group's values in one task.

A sketch brackets each quantile; rows below the bracket are only counted, rows inside are counted by value, and the wanted
ranks are read off the running counts: first over RANGES equal parts of the bracket, then over the values of the part that
holds the rank. What reaches one task is such a part: less than a millionth of the rows, unless values crowd in one.
Groups of up to ACCURACY rows are bracketed by their least and greatest value.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ACCURACY = 10_000
#: The bracket's half width; the sketch errs by 1 / ACCURACY at most.
MARGIN = 2.5 / ACCURACY
RANGES = 1000


def null_safe(left: DataFrame, right: DataFrame, by: tuple[str, ...], how: str = "inner") -> DataFrame:
    """A join by columns of the same name, nulls being equal; without columns, of one row on either side."""
    if not by:
        return left.crossJoin(F.broadcast(right))
    other = right.select(*[F.col(c).alias(f"_{c}") for c in by], *[c for c in right.columns if c not in by])
    return left.join(other, reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in by]), how).drop(*[f"_{c}" for c in by])


def exact_quantiles(df: DataFrame, value: Column, quantiles: dict[str, float], by: tuple[str, ...] = ()) -> DataFrame:
    """(by, one column for each of quantiles: name -> share): interpolated between neighbours, nulls left aside.

    Groups without any value have no row.
    """
    rows = df.select(*by, value.cast("double").alias("_v")).filter(F.col("_v").isNotNull())
    shares = list(quantiles.values())
    low, high = [max(0.0, p - MARGIN) for p in shares], [min(1.0, p + MARGIN) for p in shares]
    bounds = rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("_n"), F.min("_v").alias("_least"), F.max("_v").alias("_most"),
        F.percentile_approx("_v", [*low, *high], ACCURACY).alias("_b"),
    )
    few = F.col("_n") <= ACCURACY
    parts = [
        F.struct(
            F.lit(k).alias("k"), F.when(few | F.lit(p - MARGIN <= 0), F.col("_least")).otherwise(F.col("_b")[k]).alias("lo"),
            F.when(few | F.lit(p + MARGIN >= 1), F.col("_most")).otherwise(F.col("_b")[len(shares) + k]).alias("hi"), (F.lit(p) * (F.col("_n") - 1)).alias("rank"),
        )
        for k, p in enumerate(shares)
    ]
    bounds = bounds.filter("_n > 0").select(*by, F.explode(F.array(*parts)).alias("_q"))
    met = null_safe(rows, bounds.groupBy(*by).agg(F.collect_list("_q").alias("_qs")), by).select(*by, "_v", F.explode("_qs").alias("_q")).filter("_v <= _q.hi")
    counts = met.groupBy(*by, "_q", F.when(F.col("_v") >= F.col("_q.lo"), F.col("_v")).alias("_x")).agg(F.count(F.lit(1)).alias("_c"))
    width = F.col("_q.hi") - F.col("_q.lo")
    part = F.when(F.col("_x").isNull(), -1).when(width > 0, F.least(F.lit(RANGES - 1), F.floor((F.col("_x") - F.col("_q.lo")) / width * RANGES))).otherwise(0).cast("int")
    counts = counts.withColumn("_which", F.col("_q.k")).withColumn("_part", part)
    rank = F.col("_q.rank")
    ordered = Window.partitionBy(*by, "_which").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = counts.groupBy(*by, "_which", "_part", "_q").agg(F.sum("_c").alias("_n")).withColumn("_before", F.coalesce(F.sum("_n").over(ordered), F.lit(0)))
    held = parts.filter((F.col("_part") >= 0) & (F.col("_before") < F.ceil(rank) + 1) & (F.col("_before") + F.col("_n") >= F.floor(rank) + 1)).select(*by, "_which", "_part", "_before")
    inside = null_safe(counts, held, (*by, "_which", "_part"))
    running = inside.withColumn("_upto", F.col("_before") + F.sum("_c").over(Window.partitionBy(*by, "_which", "_part").orderBy("_x")))
    found = running.groupBy(*by, "_which").agg(
        F.min(F.when(F.col("_upto") >= F.floor(rank) + 1, F.col("_x"))).alias("a"), F.min(F.when(F.col("_upto") >= F.ceil(rank) + 1, F.col("_x"))).alias("b"), F.max(rank - F.floor(rank)).alias("part")
    )
    at = F.col("a") + (F.col("b") - F.col("a")) * F.col("part")
    return found.groupBy(*by).agg(*[F.max(F.when(F.col("_which") == k, at)).alias(name) for k, name in enumerate(quantiles)])
