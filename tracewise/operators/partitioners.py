"""Partitioners: each makes a grid of boxes (tileid, xmin, xmax, ymin, ymax, tmin, tmax)."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Protocol

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..shared import materialize
from .ranks import global_rank, tile_of_rank
from .trajectory import extent

#: Points of a node, or of an axis, that a window in one task may order; more are ranked by range.
WINDOW_ROWS = 1_000_000
AXES = ("x", "y", "t")
BOX = tuple(f"{a}{e}" for a in AXES for e in ("min", "max"))


class Partitioner(Protocol):
    """Anything that makes a grid from points (columns x, y, us and a unique event_id)."""

    def grid(self, points: DataFrame) -> DataFrame: ...


def source(axis: str) -> str:
    return "us" if axis == "t" else axis


@dataclass(frozen=True)
class Grid:
    """Equal cells on each of ``axes``; tileid = ((xi * n + yi) * n + ti) for three axes."""

    cells: int
    axes: tuple[str, ...] = AXES

    def grid(self, points: DataFrame) -> DataFrame:
        n, box = self.cells, extent(points)
        out = box
        for a in self.axes:
            out = out.withColumn(f"_{a}", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
        tile = f"_{self.axes[0]}"
        for a in self.axes[1:]:
            tile = f"({tile}) * {n} + _{a}"
        cols = []
        for a in AXES:
            lo, hi = f"{a}min", f"{a}max"
            if a in self.axes:
                cols += [f"{lo} + _{a} * (({hi} - {lo}) / {n}) AS {lo}", f"CASE WHEN _{a} = {n - 1} THEN CAST({hi} AS DOUBLE) ELSE {lo} + (_{a} + 1) * (({hi} - {lo}) / {n}) END AS {hi}"]
            else:
                cols += [f"CAST({lo} AS DOUBLE) AS {lo}", f"CAST({hi} AS DOUBLE) AS {hi}"]
        return out.selectExpr(f"CAST({tile} AS BIGINT) AS tileid", *cols)

    def assign(self, points: DataFrame) -> DataFrame:
        """Adds the tileid of the cell that owns each point (lower borders in; the last cell holds the extent's upper one)."""
        n = self.cells
        cells = [f"least({n - 1}, CAST(floor(({source(a)} - {a}min) / (({a}max - {a}min) / {n})) AS BIGINT))" for a in self.axes]
        tile = cells[0]
        for c in cells[1:]:
            tile = f"({tile}) * {n} + {c}"
        return points.join(F.broadcast(extent(points))).withColumn("tileid", F.expr(tile)).drop(*BOX)


@dataclass(frozen=True)
class KdTree:
    """Splits by count at the middle row of the axis in turn, level by level over all nodes at once.

    While nodes are large, places come from ranks by range; nodes of
    ``window_rows`` points at most are ordered by windows, a node to a task.
    """

    depth: int
    axes: tuple[str, ...] = AXES
    window_rows: int = WINDOW_ROWS

    def leaves(self, points: DataFrame) -> DataFrame:
        """Points with the number of their leaf (bits of the halves taken, the first highest)."""
        out, largest = points.withColumn("node", F.lit(0).cast("long")), points.count()
        for level in range(self.depth):
            axis = source(self.axes[level % len(self.axes)])
            if largest > self.window_rows:
                ranked = global_rank(out, ["node"], [axis, "event_id"], "_r")
            else:
                node = Window.partitionBy("node")
                ranked = out.withColumns({"_r": F.row_number().over(node.orderBy(axis, "event_id")), "_r_n": F.count("*").over(node)})
            largest = -(-largest // 2)
            out = ranked.withColumn("node", F.expr("node * 2 + CASE WHEN _r - 1 >= floor(_r_n / 2) THEN 1 ELSE 0 END")).drop("_r", "_r_n")
        return out

    def grid(self, points: DataFrame) -> DataFrame:
        """Leaf boxes: the splitting planes, from the outer box inwards; a leaf without points has no box.

        The plane of a node is the least value of its upper half.
        """
        least = [F.min(source(a)).cast("double").alias(f"_{a}") for a in AXES]
        rows = materialize(self.leaves(points.select("event_id", *map(source, AXES))).groupBy("node").agg(*least), "leaves")  # a row for each leaf, all that planes need
        out = rows.join(F.broadcast(extent(points).select(*(F.col(c).cast("double").alias(c) for c in BOX))))
        for level in range(self.depth):
            axis, shift = self.axes[level % len(self.axes)], self.depth - level - 1
            upper = F.expr(f"shiftright(node, {shift}) % 2 = 1")
            plane = F.min(F.when(upper, F.col(f"_{axis}"))).over(Window.partitionBy(F.shiftright("node", shift + 1)))
            side = F.when(upper, F.col("_plane"))
            out = out.withColumn("_plane", plane).withColumns({f"{axis}min": F.coalesce(side, f"{axis}min"), f"{axis}max": F.when(upper, F.col(f"{axis}max")).otherwise(F.col("_plane"))})
        return out.select(F.col("node").alias("tileid"), *BOX)


@dataclass(frozen=True)
class AdaptiveBins:
    """Equi-depth bins on each axis by itself; tiles are all combinations (first axis of ``axes`` outermost).

    ``exact`` bins by NTILE over ranks; otherwise by mergeable quantile
    sketches, one pass over the points for all axes.
    """

    bins: int
    axes: tuple[str, ...] = ("t", "y", "x")
    exact: bool = True
    accuracy: int = 10_000
    window_rows: int = WINDOW_ROWS

    def axis_bins(self, points: DataFrame, axis: str) -> DataFrame:
        """(bin, lo, hi): a bin starts at its first value and ends where the next starts; the outer ends are the extent's."""
        v = source(axis)
        if self.exact:
            values = points.select(F.col(v).cast("double").alias("v"), "event_id").withColumn("_one", F.lit(1))
            if points.count() > self.window_rows:
                ranked = global_rank(values, ["_one"], ["v", "event_id"], "_r")
            else:
                every = Window.partitionBy("_one")
                ranked = values.withColumns({"_r": F.row_number().over(every.orderBy("v", "event_id")), "_r_n": F.count("*").over(every)})
            starts = ranked.groupBy(F.expr(tile_of_rank("_r", "_r_n", self.bins)).alias("bin")).agg(F.min("v").alias("lo"), F.max("v").alias("_top"))
        else:
            cut = [i / self.bins for i in range(self.bins)]
            quantiles = points.agg(F.percentile_approx(F.col(v).cast("double"), cut, self.accuracy).alias("_q"), F.max(F.col(v).cast("double")).alias("_top"), F.min(F.col(v).cast("double")).alias("_low"))
            starts = quantiles.select(F.posexplode("_q").alias("_k", "lo"), "_top", "_low").select(F.expr("CAST(_k + 1 AS BIGINT) AS bin"), F.expr("CASE WHEN _k = 0 THEN _low ELSE lo END AS lo"), "_top")
        later = starts.select((F.col("bin") - 1).alias("bin"), F.col("lo").alias("_next"))
        top = starts.agg(F.max("_top").alias("_end"))
        return starts.join(later, "bin", "left").join(F.broadcast(top)).select("bin", "lo", F.coalesce("_next", "_end").alias("hi"))

    def grid(self, points: DataFrame) -> DataFrame:
        if self.exact:
            points = materialize(points.select("event_id", *map(source, AXES)), "points")  # read once for each axis
        out, tile = None, "0"
        for a in self.axes:
            b = self.axis_bins(points, a).select(F.col("bin").alias(f"_{a}"), F.col("lo").alias(f"{a}min"), F.col("hi").alias(f"{a}max"))
            out = b if out is None else out.join(F.broadcast(b))  # bins times bins: a few rows whatever the points
            tile = f"({tile}) * {self.bins} + (_{a} - 1)"
        rest = [c for c in BOX if c[0] not in self.axes]
        if rest:
            out = out.join(F.broadcast(extent(points).select(*(F.col(c).cast("double").alias(c) for c in rest))))
        return out.selectExpr(f"CAST({tile} AS BIGINT) AS tileid", *BOX)


@dataclass(frozen=True)
class BisectingKMeans:
    """Tiles are the extents of clusters of scaled points; empty clusters have none.

    Values are scaled but not centred: clusters don't depend on the origin, and
    a centre at the origin can't be split by the library's relative noise.
    """

    k: int
    axes: tuple[str, ...] = AXES
    seed: int = 3

    def clusters(self, points: DataFrame) -> DataFrame:
        from pyspark.ml import Pipeline
        from pyspark.ml.clustering import BisectingKMeans as Model
        from pyspark.ml.feature import StandardScaler, VectorAssembler

        cols = [source(a) for a in self.axes]
        rows = points.withColumn("us", F.col("us").cast("double"))
        steps = [VectorAssembler(inputCols=cols, outputCol="_raw"), StandardScaler(inputCol="_raw", outputCol="_v", withMean=False, withStd=True), Model(featuresCol="_v", predictionCol="tileid", k=self.k, seed=self.seed)]
        out = Pipeline(stages=steps).fit(rows).transform(rows)
        return out.withColumn("us", F.col("us").cast("long")).withColumn("tileid", F.col("tileid").cast("long")).drop("_raw", "_v")

    def grid(self, points: DataFrame) -> DataFrame:
        ends = [f(source(a)).cast("double").alias(f"{a}{f.__name__}") for a in AXES for f in (F.min, F.max)]
        return self.clusters(points).groupBy("tileid").agg(*ends)


@dataclass(frozen=True)
class Hash:
    """No boxes: rows are dealt by a key."""

    n: int
    key: str = "vehid"

    def assign(self, points: DataFrame) -> DataFrame:
        return points.withColumn("tileid", F.pmod(F.col(self.key), F.lit(self.n)).cast("long"))
