"""Distinct rows of wide tables in which few rows repeat."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.plans.cut import written


def once(rows: DataFrame) -> DataFrame:
    """rows.distinct(), shuffling hashes of all rows but only those rows whose hash comes again.

    rows should be cheap to read twice (a scan). Nulls are equal. If repeated rows are many, both ways cost the same.
    """
    hashed = rows.withColumn("_h", F.xxhash64(*rows.columns))
    again = written(hashed.select("_h").groupBy("_h").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("_h"), "repeated-rows")
    if again.isEmpty():
        return rows
    single = hashed.join(again, "_h", "left_anti").drop("_h")
    return single.unionByName(hashed.join(again, "_h", "left_semi").drop("_h").distinct())
