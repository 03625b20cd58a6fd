"""Looking at physical plans: what runs where, for tests and for tuning."""

from __future__ import annotations

import re
from collections import Counter

from pyspark.sql import DataFrame

#: Nodes that leave the JVM, and nodes that hold rows of one side against all of another.
PYTHON_NODES = ("MapInArrow", "MapInPandas", "ArrowEvalPython", "BatchEvalPython", "FlatMapGroupsInPandas")
ALL_PAIRS_NODES = ("CartesianProduct", "BroadcastNestedLoopJoin")


def text(df: DataFrame) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def nodes(df: DataFrame) -> Counter:
    """How often each physical operator occurs in the plan, before adaptive changes."""
    return Counter(re.findall(r"^[\s:+*|!-]*(?:\(\d+\) )?([A-Z]\w+)", text(df), re.M))


def read_columns(df: DataFrame) -> list[set[str]]:
    """The columns that each file scan reads."""
    return [set(re.findall(r"(\w+):", m)) for m in re.findall(r"ReadSchema: struct<([^\n]*)>", text(df))]


def stays_in_jvm(df: DataFrame) -> bool:
    return not set(nodes(df)) & set(PYTHON_NODES)


def pairs_all(df: DataFrame) -> bool:
    return bool(set(nodes(df)) & set(ALL_PAIRS_NODES))
