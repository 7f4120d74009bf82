"""Trajectories from points: nested rows for interchange, segment rows for computation."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import kernels as K


def dedup_points(points: DataFrame, key: str = "mo_id", time: str = "us", tie: str = "event_id", keep: tuple[str, ...] = ("vehid", "x", "y")) -> DataFrame:
    """One row per (key, time): of points at the same time, that with the smallest tie breaker."""
    first = F.min_by(F.struct(*keep), F.col(tie)).alias("_first")
    return points.groupBy(key, time).agg(first).select(key, time, "_first.*")


def to_segments(points: DataFrame, bucket_us: int | None = None, key: str = "mo_id") -> DataFrame:
    """Linear pieces between consecutive points (columns ``key``, vehid, us, x, y).

    A sequence of several points is half-open, one of a single point is that
    point. With ``bucket_us`` the points of a key are ordered within buckets of
    time only, and the last of a bucket is joined to the first of the next, so
    a key with very many points is spread over tasks.
    """
    point = F.struct("us", "x", "y")
    if bucket_us is None:
        w = Window.partitionBy(key).orderBy("us")
        rows = points.select(key, "vehid", "us", "x", "y", F.lead(point).over(w).alias("_n"), F.lag("us").over(w).alias("_p"))
    else:
        b = points.withColumn("_b", F.floor(F.col("us") / bucket_us))
        heads = b.groupBy(key, "_b").agg(F.min(point).alias("_head"), F.max("us").alias("_last"))
        across = Window.partitionBy(key).orderBy("_b")
        heads = heads.select(key, "_b", F.lead("_head").over(across).alias("_next"), F.lag("_last").over(across).alias("_before"))
        w = Window.partitionBy(key, "_b").orderBy("us")
        rows = b.withColumns({"_n": F.lead(point).over(w), "_p": F.lag("us").over(w)}).join(heads, [key, "_b"])
        rows = rows.select(key, "vehid", "us", "x", "y", F.coalesce("_n", "_next").alias("_n"), F.coalesce("_p", "_before").alias("_p"))
    single = F.col("_n").isNull() & F.col("_p").isNull()
    last = F.struct(*(F.col(c) for c in ("us", "x", "y")))
    to = F.coalesce("_n", last)
    return rows.where(F.col("_n").isNotNull() | single).select(
        key, "vehid", F.col("us").alias("t0"), F.col("x").alias("x0"), F.col("y").alias("y0"), to["us"].alias("t1"), to["x"].alias("x1"), to["y"].alias("y1"), single.alias("upper_inc")
    )


def to_sequences(points: DataFrame, key: str = "mo_id") -> DataFrame:
    """One row per key with the nested sequence ``trip`` (see :data:`tracewise.types.SEQ`)."""
    inst = F.array_sort(F.collect_list(F.struct("us", "x", "y")))
    return points.groupBy(key).agg(F.min("vehid").alias("vehid"), inst.alias("_i")).select(
        key, "vehid", F.struct(F.col("_i").alias("inst"), F.lit(True).alias("lower_inc"), (F.size("_i") == 1).alias("upper_inc"), F.lit("LINEAR").alias("interp")).alias("trip")
    )


def sequences_to_segments(trips: DataFrame, key: str = "mo_id", trip: str = "trip") -> DataFrame:
    """Segment rows of nested sequences."""
    t = F.col(trip)
    i, n = t["inst"], F.size(t["inst"])
    pairs = F.when(n == 1, F.transform(i, lambda p: F.struct(p.alias("a"), p.alias("b")))).otherwise(
        F.arrays_zip(F.slice(i, 1, F.greatest(n - 1, F.lit(0))).alias("a"), F.slice(i, 2, F.greatest(n - 1, F.lit(0))).alias("b"))
    )
    rows = trips.select(key, "vehid", n.alias("_n"), t["upper_inc"].alias("_u"), F.posexplode(pairs).alias("_k", "_s"))
    ends = [F.col(f"_s.{e}.{c}").alias(f"{o}{j}") for j, e in ((0, "a"), (1, "b")) for c, o in (("us", "t"), ("x", "x"), ("y", "y"))]
    return rows.select(key, "vehid", *ends, (F.col("_u") & ((F.col("_n") == 1) | (F.col("_k") == F.col("_n") - 2))).alias("upper_inc"))


def lengths(segments: DataFrame, key: str = "vehid") -> DataFrame:
    """Travelled length of each key."""
    return segments.groupBy(key).agg(F.sum(F.expr(K.length())).alias("length"))


def extent(points: DataFrame) -> DataFrame:
    """Bounding box of all points, one row (box columns null if there are none)."""
    return points.agg(*(f(c).alias(f"{o}{f.__name__}") for c, o in (("x", "x"), ("y", "y"), ("us", "t")) for f in (F.min, F.max)))
