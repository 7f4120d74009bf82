"""Restriction of moving points to instants, periods, boxes and polygons, and predicates on them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import kernels as K
from ..shared import hinted
from .boxes import SEGMENT, meet
from .movers import meet_blocks, meet_movers
from .traces import Pairs

_PIECE = ("t0", "x0", "y0", "t1", "x1", "y1")


def _cut(df: DataFrame, lo: str, hi: str, *keep: str) -> DataFrame:
    """Pieces between the fractions in columns ``lo`` and ``hi``."""
    ends = {f"{a}{j}": K.at(a, lam) if a != "t" else K.time_at(lam) for j, lam in ((0, lo), (1, hi)) for a in "txy"}
    upper = F.expr(f"upper_inc OR {hi} < 1 OR {lo} = {hi}")
    return df.select(*keep, *(F.expr(e).alias(n) for n, e in ends.items()), upper.alias("upper_inc"))


def time_buckets(df: DataFrame, lo: str, hi: str, width: int, name: str = "_bucket") -> DataFrame:
    """A row for each bucket of time that [lo, hi] touches."""
    return df.withColumn(name, F.explode(F.sequence(F.floor(F.col(lo) / width), F.floor(F.col(hi) / width))))


def positions_at(segments: DataFrame, instants: DataFrame, width: int = 86_400_000_000) -> DataFrame:
    """(mo_id, vehid, columns of ``instants``, x, y) for every moving point defined at an instant (column us).

    Segments and instants meet by bucket of time; every instant is in one
    bucket, so no pair comes twice.
    """
    s = time_buckets(segments, "t0", "t1", width)
    i = instants.withColumn("_bucket", F.floor(F.col("us") / width))
    lam = K.fraction("us")
    return s.join(hinted(i), "_bucket").where(K.covers("us")).select("mo_id", "vehid", *instants.columns, F.expr(K.at("x", lam)).alias("x"), F.expr(K.at("y", lam)).alias("y"))


def at_periods(segments: DataFrame, periods: DataFrame, width: int = 5 * 86_400_000_000) -> DataFrame:
    """Pieces of segments within periods (columns periodid, tmin, tmax, both ends in)."""
    p = time_buckets(periods, "tmin", "tmax", width)
    s = time_buckets(segments, "t0", "t1", width)
    both = s.join(hinted(p), "_bucket").where(f"t0 <= tmax AND t1 >= tmin AND _bucket = floor(greatest(t0, tmin) / {width})")
    lo, hi = K.clip("t")
    both = both.withColumns({"_lo": F.expr(lo), "_hi": F.expr(hi)}).where(K.kept("_lo", "_hi"))
    return _cut(both, "_lo", "_hi", "mo_id", "vehid", "periodid")


def at_boxes(segments: DataFrame, boxes: DataFrame, box_id: str, axes: str = "xy") -> DataFrame:
    """Pieces of segments within boxes (columns xmin.. for each of ``axes``), borders in."""
    lo, hi = K.clip(axes)
    both = meet(segments, boxes, {a: SEGMENT[a] for a in axes}).withColumns({"_lo": F.expr(lo), "_hi": F.expr(hi)}).where(K.kept("_lo", "_hi"))
    return _cut(both, "_lo", "_hi", "mo_id", "vehid", box_id)


def in_polygons(segments: DataFrame, polygons: DataFrame, polygon_id: str) -> DataFrame:
    """Segments with the share of each that lies in a polygon (column edges), where that is more than nothing."""
    box = {f"{a}{f}": F.expr(f"array_{f}(transform(edges, q -> q.a{a}))") for a in "xy" for f in ("min", "max")}
    both = meet(segments, polygons.withColumns(box), {a: SEGMENT[a] for a in "xy"})
    # cuts are bound as a lambda variable: as a column they would be computed anew for every use
    share = f"get(transform(array({K.ring_cuts('edges')}), cuts -> {K.inside_share('cuts', 'edges')}), 0)"
    return both.withColumn("share", F.expr(share)).where("share > 0").drop(*box)


def ever_intersects_boxes(segments: DataFrame, boxes: DataFrame, box_id: str) -> DataFrame:
    """Distinct (mo_id, box) whose traces meet the rectangle."""
    lo, hi = K.clip("xy")
    return meet(segments, boxes, {a: SEGMENT[a] for a in "xy"}).where(K.kept(lo, hi)).select("mo_id", "vehid", box_id).distinct()


def ever_touches_boxes(segments: DataFrame, boxes: DataFrame, box_id: str) -> DataFrame:
    """Distinct (mo_id, box) whose traces meet the rectangle's border."""
    lo, hi = K.clip("xy")

    def on(lam: str) -> str:
        x, y = K.at("x", lam), K.at("y", lam)
        return f"({lam} > 0 AND {lam} < 1 OR {x} = xmin OR {x} = xmax OR {y} = ymin OR {y} = ymax)"

    both = meet(segments, boxes, {a: SEGMENT[a] for a in "xy"}).withColumns({"_lo": F.expr(lo), "_hi": F.expr(hi)})
    return both.where(F.expr(f"{K.kept('_lo', '_hi')} AND ({on('_lo')} OR {on('_hi')})")).select("mo_id", "vehid", box_id).distinct()


def ever_intersects_movers(left: DataFrame, right: DataFrame, pair: str = "a.mo_id < b.mo_id", cell: float = 64.0) -> DataFrame:
    """Distinct (a_mo_id, b_mo_id) of movers whose traces have a point in common, at whatever times.

    Movers meet by cell of the plane, where their common box begins, and by
    blocks of movers (see :func:`meet_movers`), so a pair's segments are all
    met by one task, which returns the pair once. Boxes are compared before the
    exact test. A sequence's exclusive end counts as part of its trace.
    """
    both, at = meet_movers(left, right, ("mo_id", "vehid", "x0", "y0", "x1", "y1"), {"x": cell, "y": cell}, f"({pair}) AND {K.crosses()}")
    pairs = both.select(*(F.col(f"a.{c}").alias(c) for c in at), F.col("a.mo_id").alias("a_mo_id"), F.col("b.mo_id").alias("b_mo_id"))
    return pairs.distinct().select("a_mo_id", "b_mo_id")


def ever_intersects_vehicles(left: DataFrame, right: DataFrame, cell: float = 64.0) -> DataFrame:
    """As :func:`ever_intersects_movers` for two tables and movers of different vehicles.

    A pair's longest segments are tested first and those that meet end its tests.
    """
    met = meet_blocks(left, right, ("mo_id", "vehid", "x0", "y0", "x1", "y1"), {"x": cell, "y": cell})
    return met.mapInArrow(Pairs(("crossing",), 2, 0, True), "a_mo_id long, b_mo_id long")


def passes_points(segments: DataFrame, points: DataFrame, cell: float = 16.0) -> DataFrame:
    """(mo_id, vehid, pointid) where a trace goes exactly through a point (columns pointid, x, y).

    Both sides meet by cell of the plane; a point is in one cell, so a segment
    and a point meet once at most.
    """
    cells = [F.explode(F.sequence(F.floor(F.least(f"{a}0", f"{a}1") / cell), F.floor(F.greatest(f"{a}0", f"{a}1") / cell))) for a in "xy"]
    s = segments.withColumn("_cx", cells[0]).withColumn("_cy", cells[1])
    p = points.select("pointid", F.col("x").alias("px"), F.col("y").alias("py"), F.floor(F.col("x") / cell).alias("_cx"), F.floor(F.col("y") / cell).alias("_cy"))
    box = "px BETWEEN least(x0, x1) AND greatest(x0, x1) AND py BETWEEN least(y0, y1) AND greatest(y0, y1)"
    on = f"{box} AND {K.point_distance('px', 'py')} = 0 AND (t0 = t1 OR upper_inc OR NOT (px = x1 AND py = y1) OR (x0 = x1 AND y0 = y1))"
    return s.join(p, ["_cx", "_cy"]).where(on).select("mo_id", "vehid", "pointid")
