"""All pairs within groups, where a result asks for them, with no group held by one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A group's members are hashed into parts of about so many; every two parts meet under a key of their own.
CELL = 2048


def pairs_within(members: DataFrame, group: list[str], item: str, carry: tuple[str, ...] = (), cell: int = CELL, unlike: Column | None = None) -> DataFrame:
    """(a, b, and carry once for either: c_a, c_b), a < b: the pairs of items of one group.

    members has distinct (group, item). A pair that several groups hold comes once per group. unlike, over the columns of the
    result, keeps only some of the pairs. Null groups and items meet nothing.
    """
    rows = members.filter(F.col(item).isNotNull()).select(*group, F.col(item).alias("_i"), *carry)
    sizes = rows.groupBy(*group).agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").withColumn("_n", F.ceil(F.col("_n") / cell))
    parts = rows.join(sizes, group).withColumn("_own", F.pmod(F.xxhash64("_i"), F.col("_n")))
    left = parts.select(
        *group, F.col("_own").alias("_lo"), F.explode(F.sequence(F.col("_own"), F.col("_n") - 1)).alias("_hi"), F.col("_i").alias("a"), *[F.col(c).alias(f"{c}_a") for c in carry]
    )
    right = parts.select(*group, F.explode(F.sequence(F.lit(0).cast("bigint"), "_own")).alias("_lo"), F.col("_own").alias("_hi"), F.col("_i").alias("b"), *[F.col(c).alias(f"{c}_b") for c in carry])
    met = left.join(right, [*group, "_lo", "_hi"]).filter("_lo < _hi OR a < b")
    if unlike is not None:
        met = met.filter(unlike)
    swap = F.col("a") > F.col("b")
    out = [F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")]
    for c in carry:
        out += [F.when(swap, F.col(f"{c}_b")).otherwise(F.col(f"{c}_a")).alias(f"{c}_a"), F.when(swap, F.col(f"{c}_a")).otherwise(F.col(f"{c}_b")).alias(f"{c}_b")]
    return met.select(*out)
