"""Order statistics over whole tables without sorting in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..shared import materialize


def global_rank(df: DataFrame, group: list[str], order: list[str], name: str = "rank") -> DataFrame:
    """Adds the 1-based place of each row in its group and the group's size (``name``_n).

    Rows are dealt by range, so a group of any size is spread over tasks; each
    counts its own rows and adds what lies before. ``order`` should be unique
    in a group; rows that tie get places in any order.
    """
    n = max(2, df.sparkSession.sparkContext.defaultParallelism)
    ranged = materialize(df.repartitionByRange(n, *group, *order).withColumn("_part", F.spark_partition_id()), "ranged")
    counts = ranged.groupBy(*group, "_part").count()
    before = Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*group)
    base = counts.withColumns({"_before": F.coalesce(F.sum("count").over(before), F.lit(0)), f"{name}_n": F.sum("count").over(whole)}).drop("count")
    mine = F.row_number().over(Window.partitionBy("_part", *group).orderBy(*order))
    joined = ranged.withColumn("_mine", mine).alias("r").join(
        F.broadcast(base.alias("c")), F.expr(" AND ".join(f"r.{c} <=> c.{c}" for c in [*group, "_part"]))
    )
    return joined.select(*(F.col(f"r.{c}") for c in df.columns), (F.col("_mine") + F.col("_before")).alias(name), F.col(f"{name}_n"))


def tile_of_rank(rank: str, n: str, k: int) -> str:
    """NTILE(k) of a place among n, as SQL text."""
    q, r = f"floor({n} / {k})", f"({n} % {k})"
    return f"CAST(CASE WHEN {rank} <= {r} * ({q} + 1) THEN floor(({rank} - 1) / ({q} + 1)) ELSE {r} + floor(({rank} - 1 - {r} * ({q} + 1)) / {q}) END + 1 AS BIGINT)"
