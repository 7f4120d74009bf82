"""The twelve vehicle-tracking benchmark queries and two on municipalities.

Tables meet by cell, tile or bucket of time; results don't depend on tiles, so
a position on a tile border comes once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import kernels as K
from ..operators import distance as D
from ..operators import partitioners as P
from ..operators import restrict as R
from ..operators import tiling
from ..operators.boxes import SEGMENT, meet
from ..shared import hinted, materialize
from .queries import _GRID, _LAM, CELLS, _pairs, q, query
from .world import World

_Q1S = "(SELECT s.*, licence FROM segs s JOIN vehicles USING (vehid) JOIN ql1 USING (licence))"
_Q2S = "(SELECT s.*, licence FROM segs s JOIN vehicles USING (vehid) JOIN ql2 USING (licence))"
_TRUCKS = "(SELECT s.*, licence FROM segs s JOIN vehicles USING (vehid) WHERE type = 'truck')"


def licensed(w: World, licences: DataFrame) -> DataFrame:
    """Segments of the vehicles with stated licences."""
    ids = w.vehicles.join(F.broadcast(licences), "licence").select("vehid", "licence")
    return w.segments.join(hinted(ids), "vehid")


@query("SELECT licence, model FROM ql1 JOIN vehicles USING (licence)")
def bench_01_models(w: World) -> DataFrame:
    return w.vehicles.join(F.broadcast(w.licences1), "licence").select("licence", "model")


@query("SELECT count(licence) AS passenger_cars FROM vehicles WHERE type = 'passenger'")
def bench_02_passenger_cars(w: World) -> DataFrame:
    return w.vehicles.where("type = 'passenger'").agg(F.count("licence").alias("passenger_cars"))


@query(f"SELECT s.vehid, licence, instantid, {q(K.at('x', _LAM), 'x')}, {q(K.at('y', _LAM), 'y')} FROM {_Q1S} s, instants WHERE {K.covers('us')}")
def bench_03_positions(w: World) -> DataFrame:
    found = R.positions_at(licensed(w, w.licences1).drop("licence"), w.instants)
    return found.selectExpr("vehid", "concat('L-', CAST(vehid AS STRING)) AS licence", "instantid", q("x", "x"), q("y", "y"))


_ON = f"{K.point_distance('q.x', 'q.y', 's.')} = 0 AND (t0 = t1 OR upper_inc OR NOT (q.x = x1 AND q.y = y1) OR (x0 = x1 AND y0 = y1))"


@query(f"SELECT DISTINCT vehid, 'L-' || CAST(vehid AS VARCHAR) AS licence, pointid FROM segs s, qpts q WHERE q.x BETWEEN least(x0, x1) AND greatest(x0, x1) AND q.y BETWEEN least(y0, y1) AND greatest(y0, y1) AND {_ON}")
def bench_04_passed_points(w: World) -> DataFrame:
    found = R.passes_points(w.segments, w.query_points).select("vehid", "pointid").distinct()
    return found.join(w.vehicles.select("vehid", "licence"), "vehid").select("vehid", "licence", "pointid")


@query(f"SELECT 'L-' || CAST(a_vehid AS VARCHAR) AS licence1, 'L-' || CAST(b_vehid AS VARCHAR) AS licence2, {q('min(dist)', 'min_dist')} FROM ({_pairs(_Q1S, _Q2S, 'a.vehid <> b.vehid')}) GROUP BY 1, 2")
def bench_05_min_distance(w: World) -> DataFrame:
    found = D.approaches(licensed(w, w.licences1), licensed(w, w.licences2), "a.vehid <> b.vehid").groupBy("a_vehid", "b_vehid").agg(F.expr(q("min(dist)", "min_dist")))
    return found.selectExpr("concat('L-', CAST(a_vehid AS STRING)) AS licence1", "concat('L-', CAST(b_vehid AS STRING)) AS licence2", "min_dist")


@query(f"SELECT * FROM (SELECT 'L-' || CAST(a_vehid AS VARCHAR) AS licence1, 'L-' || CAST(b_vehid AS VARCHAR) AS licence2, a_mo_id, b_mo_id, {q('min(dist)', 'nad')} FROM ({_pairs(_TRUCKS, _TRUCKS, 'a.vehid <> b.vehid')}) GROUP BY ALL) WHERE nad BETWEEN 0.1 AND 10.1")
def bench_06_close_trucks(w: World) -> DataFrame:
    trucks = w.segments.join(w.vehicles.where("type = 'truck'").select("vehid"), "vehid")
    found = D.nearest_distance(trucks, trucks, "a.vehid <> b.vehid", ("a_vehid", "b_vehid", "a_mo_id", "b_mo_id"), within=10.2)  # a little over the bound, as rounding comes last
    rows = found.selectExpr("concat('L-', CAST(a_vehid AS STRING)) AS licence1", "concat('L-', CAST(b_vehid AS STRING)) AS licence2", "a_mo_id", "b_mo_id", q("nad", "nad"))
    return rows.where("nad BETWEEN 0.1D AND 10.1D")


_AT = f"SELECT s.vehid, instantid, {K.at('x', _LAM)} AS x, {K.at('y', _LAM)} AS y FROM segs s, instants WHERE {K.covers('us')}"


@query(f"SELECT instantid, pointid, string_agg(DISTINCT CAST(vehid AS VARCHAR), ',' ORDER BY CAST(vehid AS VARCHAR)) AS vehids FROM ({_AT}) a JOIN qpts q ON a.x = q.x AND a.y = q.y GROUP BY instantid, pointid")
def bench_11_at_point_and_instant(w: World) -> DataFrame:
    found = R.positions_at(w.segments, w.instants).join(w.query_points, ["x", "y"])
    return found.groupBy("instantid", "pointid").agg(F.array_join(F.array_sort(F.collect_set(F.col("vehid").cast("string"))), ",").alias("vehids"))


@query(f"SELECT DISTINCT vehid FROM ({_AT}) a JOIN qpts q ON a.x = q.x AND a.y = q.y")
def bench_12_met_at_point(w: World) -> DataFrame:
    return R.positions_at(w.segments, w.instants).join(w.query_points, ["x", "y"]).select("vehid").distinct()


_TLO, _THI = K.clip("t")
_XLO, _XHI = K.clip("xy")
_CUT = ", ".join(f"{K.at(a, lam)} AS {a}{j}" for a in "xy" for j, lam in ((0, "lo"), (1, "hi")))
_PIECES = f"SELECT vehid, mo_id, periodid, t0, t1, hi < 1 OR lo = hi OR upper_inc AS upper_inc, {_CUT} FROM (SELECT s.*, periodid, {_TLO} AS lo, {_THI} AS hi FROM segs s, periods WHERE t0 <= tmax AND t1 >= tmin) WHERE {K.kept('lo', 'hi')}"


_IN_BOX = "(SELECT p.*, regionid, xmin, xmax, ymin, ymax, {0} AS lo, {1} AS hi FROM ({2}) p, regions)".format(_XLO, _XHI, _PIECES)


@query(f"SELECT regionid, periodid, string_agg(DISTINCT CAST(vehid AS VARCHAR), ',' ORDER BY CAST(vehid AS VARCHAR)) AS vehids FROM {_IN_BOX} WHERE lo < hi OR (lo = hi AND NOT (lo = 1 AND t0 < t1 AND NOT upper_inc)) GROUP BY regionid, periodid")
def bench_13_in_region_during_period(w: World) -> DataFrame:
    """Vehicles in a region at some time of a period; included ends count, exclusive ones don't."""
    pieces = R.at_periods(w.segments, w.periods)
    lo, hi = K.clip("xy")
    found = meet(pieces, w.regions, {a: SEGMENT[a] for a in "xy"}).where(K.kept(lo, hi))
    return found.groupBy("regionid", "periodid").agg(F.array_join(F.array_sort(F.collect_set(F.col("vehid").cast("string"))), ",").alias("vehids"))


@query(f"SELECT DISTINCT vehid FROM (SELECT vehid, x0 AS x, y0 AS y FROM ({_PIECES}) UNION ALL SELECT vehid, x1, y1 FROM ({_PIECES}) WHERE upper_inc) JOIN qpts USING (x, y)")
def bench_15_passed_in_period(w: World) -> DataFrame:
    """By the places where a trip's part within a period begins, turns or ends, recorded or not (an exclusive end is none)."""
    pieces = R.at_periods(w.segments, w.periods)
    places = pieces.select("vehid", F.col("x0").alias("x"), F.col("y0").alias("y")).union(pieces.where("upper_inc").select("vehid", "x1", "y1"))
    return places.join(w.query_points, ["x", "y"]).select("vehid").distinct()


@query(
    f"SELECT v1, instantid, v2, {q('nad', 'nad')}, rank FROM (SELECT *, row_number() OVER (PARTITION BY instantid, v1 ORDER BY nad, v2) AS rank FROM (SELECT a.instantid, a.vehid AS v1, b.vehid AS v2, sqrt((b.x - a.x) * (b.x - a.x) + (b.y - a.y) * (b.y - a.y)) AS nad "
    f"FROM ({_AT}) a JOIN ({_AT}) b ON a.instantid = b.instantid AND a.vehid <> b.vehid WHERE a.vehid IN (SELECT vehid FROM vehicles JOIN ql1 USING (licence)))) WHERE rank <= 10"
)
def bench_18_nearest_vehicles(w: World) -> DataFrame:
    at = materialize(R.positions_at(w.segments, w.instants).select("vehid", "instantid", "x", "y"), "positions")
    ids = w.vehicles.join(F.broadcast(w.licences1), "licence").select("vehid")
    return D.knn_at_instants(at.join(hinted(ids), "vehid"), at).selectExpr("v1", "instantid", "v2", q("nad", "nad"), "CAST(rank AS BIGINT) AS rank")


@query(
    f"SELECT regionid, periodid, 'L-' || CAST(vehid AS VARCHAR) AS licence, {q('nad', 'nad')}, rank FROM (SELECT *, row_number() OVER (PARTITION BY regionid, periodid ORDER BY nad, vehid) AS rank FROM (SELECT regionid, periodid, vehid, min({K.box_distance()}) AS nad FROM ({_PIECES}) p, regions GROUP BY regionid, periodid, vehid)) WHERE rank <= 10"
)
def bench_20_nearest_to_region(w: World) -> DataFrame:
    """The ten nearest vehicles by exact distance, ties to the smaller number; rounded at the end."""
    near = D.distance_to_boxes(R.at_periods(w.segments, w.periods), w.regions, ("regionid", "periodid", "vehid"))
    best = D.nearest(near, ("regionid", "periodid"), ("nad", "vehid"), 10).join(w.vehicles.select("vehid", "licence"), "vehid")
    return best.selectExpr("regionid", "periodid", "licence", q("nad", "nad"), "CAST(rank AS BIGINT) AS rank")


@query(
    f"SELECT regionid, tileid FROM (SELECT regionid, list_min(list_transform(edges, lambda e: e.ax)) AS x0, list_max(list_transform(edges, lambda e: e.ax)) AS x1, list_min(list_transform(edges, lambda e: e.ay)) AS y0, list_max(list_transform(edges, lambda e: e.ay)) AS y1 FROM polygons) r, ({_GRID}) g "
    "WHERE x0 <= g.xmax AND x1 >= g.xmin AND y0 <= g.ymax AND y1 >= g.ymin"
)
def tiles_of_municipality(w: World) -> DataFrame:
    box = w.polygons.selectExpr("regionid", *(f"array_{f}(edges.a{a}) AS r{a}{f}" for a in "xy" for f in ("min", "max")))
    return tiling.tile(box, P.Grid(CELLS).grid(w.points), "xy", {"x": ("rxmin", "rxmax"), "y": ("rymin", "rymax")}).select("regionid", "tileid")


@query(
    f"SELECT mo_id, {q(f'sum(({K.length()}) * share)', 'length', 2)} FROM (SELECT s.*, {K.inside_share('cuts', 'edges', e=K.Duck)} AS share FROM (SELECT s.*, edges, {K.ring_cuts('edges', e=K.Duck)} AS cuts FROM segs s, polygons WHERE regionid = 2) s) WHERE share > 0 GROUP BY mo_id"
)
def trips_in_municipality(w: World) -> DataFrame:
    found = R.in_polygons(w.segments, w.polygons.where("regionid = 2"), "regionid")
    return found.groupBy("mo_id").agg(F.expr(q(f"sum(({K.length()}) * share)", "length", 2)))
