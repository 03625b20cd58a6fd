"""Cutting lineage by a table written to the folder that all executors share."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; where that is unset, a folder of this machine if all of Spark runs on it."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not re.match(r"local($|\[)", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return named or f"file://{tempfile.gettempdir()}/ledgerloom-checkpoints"


_SCOPES: list[list[tuple]] = []


@contextmanager
def scratch() -> Iterator[None]:
    """Tables written inside are removed at the end, when results that read them must have been used."""
    _SCOPES.append([])
    try:
        yield
    finally:
        for fs, at in _SCOPES.pop():
            fs.delete(at, True)


def written(df: DataFrame, name: str) -> DataFrame:
    """The same rows, read back from a table in the shared folder. It is removed when the driver ends, or the scratch() round it."""
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/ledgerloom/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.deleteOnExit(at)
    if _SCOPES:
        _SCOPES[-1].append((fs, at))
    return spark.read.schema(df.schema).parquet(path)
