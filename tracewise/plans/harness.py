"""Timing of queries over partitioners: every query is run to its end, without fetching rows."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession


def run(df: DataFrame) -> float:
    """Seconds that the whole result takes."""
    began = time.perf_counter()
    df.write.format("noop").mode("overwrite").save()
    return time.perf_counter() - began


def run_all(spark: SparkSession, sf_dir: str, queries: dict[str, Callable[[SparkSession, str], DataFrame]], names: Iterable[str] | None = None) -> DataFrame:
    """(query, seconds, plan) for each query."""
    rows = []
    for name in names or queries:
        df = queries[name](spark, sf_dir)
        rows.append((name, run(df), df._jdf.queryExecution().simpleString()))
    return spark.createDataFrame(rows, "query string, seconds double, plan string")
