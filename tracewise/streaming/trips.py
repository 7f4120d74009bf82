"""Trips from a stream of points: sessions of each vehicle, closed by a gap and a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def sessions(points: DataFrame, gap: str = "6 hours", late: str | None = "1 day", time: str = "ts", key: str = "vehid") -> DataFrame:
    """(key, start, end, n, xmin, xmax, ymin, ymax) of each run of points without a longer gap.

    Works on batches and streams; on a stream, points later than ``late`` are
    dropped and a session comes out once no more of it can arrive.
    """
    p = points.withWatermark(time, late) if late and points.isStreaming else points
    ends = [f(c).alias(f"{c}{f.__name__}") for c in "xy" for f in (F.min, F.max)]
    return p.groupBy(key, F.session_window(time, gap).alias("w")).agg(F.count("*").alias("n"), *ends).select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n", *(f"{c}{f}" for c in "xy" for f in ("min", "max")))


def windowed_counts(points: DataFrame, width: str = "1 hour", late: str = "1 day", time: str = "ts") -> DataFrame:
    """Points and vehicles (approximate on streams) in each window of time."""
    p = points.withWatermark(time, late) if points.isStreaming else points
    return p.groupBy(F.window(time, width).alias("w")).agg(F.count("*").alias("n"), F.approx_count_distinct("vehid").alias("vehicles")).select(F.col("w.start").alias("start"), "n", "vehicles")
