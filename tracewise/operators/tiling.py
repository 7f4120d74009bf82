"""Tiling: pieces of moving points, and whole static things, by tile."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import kernels as K
from ..shared import materialize
from .boxes import SEGMENT, meet
from .restrict import _cut


def tile_segments(segments: DataFrame, grid: DataFrame, axes: str = "xyt") -> DataFrame:
    """Pieces of segments clipped to tiles, borders in (mo_id, vehid, tileid, piece, length)."""
    both = meet(segments, grid, {a: SEGMENT[a] for a in axes})
    lo, hi = K.clip(axes)
    return _cut(both.withColumns({"_lo": F.expr(lo), "_hi": F.expr(hi)}).where(K.kept("_lo", "_hi")), "_lo", "_hi", "mo_id", "vehid", "tileid")


def tile(things: DataFrame, grid: DataFrame, axes: str, columns: dict[str, tuple[str, str]], condition: str | None = None) -> DataFrame:
    """Whole rows of ``things`` with each tile whose box they overlap and, if given, that meets ``condition``.

    ``columns`` names each axis' lower and upper column (the same for points
    and instants).
    """
    both = meet(things, grid, {a: columns[a] for a in axes})
    return (both.where(condition) if condition else both).select(*things.columns, "tileid")


def tile_of_points(points: DataFrame, grid: DataFrame, axes: str = "xyt") -> DataFrame:
    """Adds the first tile that holds each point, -1 where none does; repeated rows stay."""
    rows = materialize(points.withColumn("_row", F.monotonically_increasing_id()), "points")
    found = meet(rows, grid, {a: ("us", "us") if a == "t" else (a, a) for a in axes}, "left")
    first = F.min(F.struct(F.coalesce("tileid", F.lit(-1)).alias("tileid"), *points.columns)).alias("_f")  # of a row all but the tile are equal
    return found.groupBy("_row").agg(first).select(*(F.col(f"_f.{c}") for c in points.columns), "_f.tileid")


def entropy(counted: DataFrame, count: str = "count", by: tuple[str, ...] = ()) -> DataFrame:
    """Natural-log entropy of counts."""
    return counted.groupBy(*by).agg((F.log(F.sum(count)) - F.sum(F.col(count) * F.log(F.col(count))) / F.sum(count)).alias("entropy"), F.count("*").alias("tiles"))
