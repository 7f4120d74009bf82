"""Connected components of a link table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import hinted, materialize


def components(links: DataFrame, max_rounds: int = 50) -> DataFrame:
    """(node, root) for every node of ``links`` (columns a, b), root the smallest node it reaches.

    Each step takes the smallest neighbour by a partial aggregation, writes it
    and joins it back, so a hub's links are never gathered in one row: a small
    table is broadcast, a large one joined by a shuffle whose skewed partitions
    adaptive execution splits, as nothing stands between it and the join. Rounds are written to the shared folder; the number of
    rounds grows with the logarithm of the number of nodes.
    """
    spark = links.sparkSession
    edges = canonical(links)
    state = None
    for _ in range(max_rounds):
        edges = materialize(small_star(materialize(large_star(edges), "links")), "links")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == state:
            break
        state = now
    else:
        raise RuntimeError("components did not settle")
    roots = edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.union(edges.select(F.col("b"), F.col("b")).distinct()) if not edges.isEmpty() else spark.createDataFrame([], roots.schema)


def canonical(links: DataFrame) -> DataFrame:
    """Distinct links with a > b."""
    return links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = materialize(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")), "least")
    return canonical(both.where("b > a").join(hinted(least), "a").select(F.col("b").alias("a"), F.col("m").alias("b")))


def small_star(edges: DataFrame) -> DataFrame:
    least = materialize(edges.groupBy("a").agg(F.min("b").alias("m")), "least")
    moved = edges.join(hinted(least), "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return canonical(moved.union(least.select("a", F.col("m").alias("b"))))
