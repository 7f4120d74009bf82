"""Queries over the vehicle-tracking world, one for each operator, with SQL that restates them plainly.

The SQL joins everything with everything and filters; the DataFrame queries
meet by tile, cell or bucket of time.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import kernels as K
from ..operators import distance as D
from ..operators import partitioners as P
from ..operators import restrict as R
from ..operators import tiling
from ..operators import trajectory as T
from .world import DAY, SQL, World

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
CELLS, BINS, DEPTH = 4, 4, 6


def query(sql: str | None = None):
    """Registers a function of a :class:`World`; ``sql`` follows the world's common table expressions."""

    def add(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(World(spark, sf_dir))
        if sql:
            ORACLES[f.__name__] = SQL + sql
        return f

    return add


def q(value: str, name: str, digits: int = 4) -> str:
    return f"{K.quantised(value, digits)} AS {name}"


_LAM = K.fraction("us")
_TLO, _THI = K.clip("t")
_XLO, _XHI = K.clip("xy")
_ALO, _AHI = K.clip("xyt")


@query(f"SELECT mo_id, s.vehid, instantid, {q(K.at('x', _LAM), 'x')}, {q(K.at('y', _LAM), 'y')} FROM segs s, instants WHERE {K.covers('us')}")
def positions_at_instants(w: World) -> DataFrame:
    return R.positions_at(w.segments, w.instants).selectExpr("mo_id", "vehid", "instantid", q("x", "x"), q("y", "y"))


@query("SELECT vehid, us, x, y, event_id FROM pts")
def dedup_points(w: World) -> DataFrame:
    return w.points.select("vehid", "us", "x", "y", "event_id")


@query("SELECT * FROM ext")
def extent(w: World) -> DataFrame:
    return T.extent(w.points)


@query("SELECT mo_id, vehid, t0, x0, y0, t1, x1, y1, upper_inc FROM segs")
def segments(w: World) -> DataFrame:
    return w.segments


@query("SELECT mo_id, vehid, t0, x0, y0, t1, x1, y1, upper_inc FROM segs")
def segments_of_sequences(w: World) -> DataFrame:
    return T.sequences_to_segments(w.trips)


@query(f"SELECT vehid, {q(f'sum({K.length()})', 'length', 2)} FROM segs GROUP BY vehid")
def length(w: World) -> DataFrame:
    return T.lengths(w.segments).selectExpr("vehid", q("length", "length", 2))


@query(
    "SELECT mo_id, count(*) AS num_instants, min(us) AS first_us, max(us) AS last_us, arg_min(x, us) AS start_x, arg_min(y, us) AS start_y, min(x) AS xmin, max(x) AS xmax, "
    "string_agg(CAST(us AS VARCHAR), ',' ORDER BY us) AS timestamps, count(*) = 1 AS upper_inc FROM pts GROUP BY mo_id"
)
def accessors(w: World) -> DataFrame:
    return w.trips.selectExpr(
        "mo_id", "CAST(size(trip.inst) AS BIGINT) AS num_instants", "trip.inst[0].us AS first_us", "element_at(trip.inst, -1).us AS last_us", "trip.inst[0].x AS start_x", "trip.inst[0].y AS start_y",
        "array_min(trip.inst.x) AS xmin", "array_max(trip.inst.x) AS xmax", "array_join(transform(trip.inst.us, v -> CAST(v AS STRING)), ',') AS timestamps", "trip.upper_inc AS upper_inc",
    )


@query("SELECT mo_id, us, x AS value FROM pts")
def spatial_values(w: World) -> DataFrame:
    return w.trips.selectExpr("mo_id", "explode(trip.inst) AS i").selectExpr("mo_id", "i.us AS us", "i.x AS value")


# --- restriction and predicates ----------------------------------------------


@query(
    f"SELECT vehid, periodid, count(*) AS pieces, {q(f'sum(({K.length()}) * (hi - lo))', 'length', 2)}, CAST(sum(CAST(floor((t1 - t0) * hi + 0.5) AS BIGINT) - CAST(floor((t1 - t0) * lo + 0.5) AS BIGINT)) AS BIGINT) AS duration "
    f"FROM (SELECT s.*, periodid, {_TLO} AS lo, {_THI} AS hi FROM segs s, periods WHERE t0 <= tmax AND t1 >= tmin) WHERE {K.kept('lo', 'hi')} GROUP BY vehid, periodid"
)
def at_period(w: World) -> DataFrame:
    return R.at_periods(w.segments, w.periods).groupBy("vehid", "periodid").agg(F.count("*").alias("pieces"), F.expr(q(f"sum({K.length()})", "length", 2)), F.expr("sum(t1 - t0) AS duration"))


@query(
    f"SELECT vehid, regionid, count(*) AS pieces, {q(f'sum(({K.length()}) * (hi - lo))', 'length', 2)} FROM (SELECT s.*, regionid, {_XLO} AS lo, {_XHI} AS hi FROM segs s, regions) WHERE {K.kept('lo', 'hi')} GROUP BY vehid, regionid"
)
def at_box(w: World) -> DataFrame:
    return R.at_boxes(w.segments, w.regions, "regionid").groupBy("vehid", "regionid").agg(F.count("*").alias("pieces"), F.expr(q(f"sum({K.length()})", "length", 2)))


@query(
    f"SELECT vehid, regionid, {q(f'sum(({K.length()}) * share)', 'length', 2)}, count(*) AS pieces FROM (SELECT s.*, regionid, {K.inside_share('cuts', 'edges', e=K.Duck)} AS share FROM "
    f"(SELECT s.*, regionid, edges, {K.ring_cuts('edges', e=K.Duck)} AS cuts FROM segs s, polygons) s) WHERE share > 0 GROUP BY vehid, regionid"
)
def at_polygon(w: World) -> DataFrame:
    return R.in_polygons(w.segments, w.polygons, "regionid").groupBy("vehid", "regionid").agg(F.expr(q(f"sum(({K.length()}) * share)", "length", 2)), F.count("*").alias("pieces"))


@query(f"SELECT DISTINCT mo_id, vehid, regionid FROM segs, regions WHERE {K.kept(_XLO, _XHI)}")
def ever_intersects_box(w: World) -> DataFrame:
    return R.ever_intersects_boxes(w.segments, w.regions, "regionid")


@query("SELECT DISTINCT p.mo_id, p.vehid, pointid FROM pts p JOIN qpts q ON p.x = q.x AND p.y = q.y JOIN segs s ON s.mo_id = p.mo_id AND s.t0 = p.us")
def ever_intersects_recorded_point(w: World) -> DataFrame:
    """Places that a trip was recorded at (the exclusive end of a trip is not on it)."""
    passed = R.passes_points(w.segments, w.query_points)
    starts = w.segments.select("mo_id", F.col("x0").alias("x"), F.col("y0").alias("y")).join(w.query_points, ["x", "y"]).select("mo_id", "pointid")
    return passed.join(starts, ["mo_id", "pointid"], "left_semi").distinct().select("mo_id", "vehid", "pointid")


@query(
    f"SELECT DISTINCT mo_id, vehid, regionid FROM (SELECT s.*, r.*, {_XLO} AS lo, {_XHI} AS hi FROM segs s, regions r) WHERE {K.kept('lo', 'hi')} AND ("
    + " OR ".join(f"({v} > 0 AND {v} < 1 OR {K.at('x', v)} = xmin OR {K.at('x', v)} = xmax OR {K.at('y', v)} = ymin OR {K.at('y', v)} = ymax)" for v in ("lo", "hi"))
    + ")"
)
def ever_touches_box(w: World) -> DataFrame:
    return R.ever_touches_boxes(w.segments, w.regions, "regionid")


_SPANS = "SELECT mo_id, min(t0) AS lo, max(t1) AS hi, bool_or(upper_inc) AS hi_inc FROM segs GROUP BY mo_id"


def _spans(w: World) -> DataFrame:
    return w.segments.groupBy("mo_id").agg(F.min("t0").alias("lo"), F.max("t1").alias("hi"), F.bool_or("upper_inc").alias("hi_inc"))


@query(f"SELECT mo_id, periodid FROM ({_SPANS}), periods WHERE lo <= tmax AND (tmin < hi OR (tmin = hi AND hi_inc))")
def temporally_overlaps(w: World) -> DataFrame:
    return _spans(w).join(F.broadcast(w.periods), F.expr("lo <= tmax AND (tmin < hi OR (tmin = hi AND hi_inc))")).select("mo_id", "periodid")


@query(f"SELECT mo_id, periodid FROM ({_SPANS}), periods WHERE lo <= tmin AND (tmax < hi OR (tmax = hi AND hi_inc))")
def temporally_contains(w: World) -> DataFrame:
    return _spans(w).join(F.broadcast(w.periods), F.expr("lo <= tmin AND (tmax < hi OR (tmax = hi AND hi_inc))")).select("mo_id", "periodid")


@query("SELECT mo_id, regionid FROM (SELECT mo_id, min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM pts GROUP BY mo_id), regions WHERE x0 >= xmin AND x1 <= xmax AND y0 >= ymin AND y1 <= ymax")
def stbox_contains(w: World) -> DataFrame:
    boxes = w.points.groupBy("mo_id").agg(F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"))
    return boxes.join(F.broadcast(w.regions), F.expr("x0 >= xmin AND x1 <= xmax AND y0 >= ymin AND y1 <= ymax")).select("mo_id", "regionid")


# --- distance -----------------------------------------------------------------

_A = K.approach()
_PAIRS = (
    "SELECT *, " + K.approach_distance() + " AS dist FROM (SELECT a.mo_id AS a_mo_id, b.mo_id AS b_mo_id, a.vehid AS a_vehid, b.vehid AS b_vehid, "
    + ", ".join(f"{_A[c]} AS {c}" for c in ("s", "e", "ax", "ay", "vx", "vy", "lam"))
    + " FROM {left} a JOIN {right} b ON {pair} AND a.t0 <= b.t1 AND b.t0 <= a.t1 AND " + _A["common"] + ")"
)


def _pairs(left: str, right: str, pair: str) -> str:
    return _PAIRS.replace("{left}", left).replace("{right}", right).replace("{pair}", pair)


#: The stated query set: vehicles whose number is divisible by 100, against all.
ASKED = "vehid % 100 = 0"
_NEAR = _pairs(f"(SELECT * FROM segs WHERE {ASKED})", "segs", "a.vehid <> b.vehid")
#: All of all other vehicles.
_BOTH = _pairs("segs", "segs", "a.vehid <> b.vehid")


@query(f"SELECT a_mo_id, b_mo_id, {q('min(dist)', 'nad')} FROM ({_NEAR}) GROUP BY a_mo_id, b_mo_id")
def nearest_approach_distance(w: World) -> DataFrame:
    return D.nearest_distance(w.segments.where(ASKED), w.segments, "a.vehid <> b.vehid").selectExpr("a_mo_id", "b_mo_id", q("nad", "nad"))


@query(
    f"SELECT a_mo_id, b_mo_id, us FROM (SELECT *, row_number() OVER (PARTITION BY a_mo_id, b_mo_id ORDER BY dist, s + CAST(floor((e - s) * lam + 0.5) AS BIGINT)) AS rn, s + CAST(floor((e - s) * lam + 0.5) AS BIGINT) AS us FROM ({_BOTH})) WHERE rn = 1"
)
def nearest_approach_instant(w: World) -> DataFrame:
    return D.of_all_pairs(w.segments, ("us",), both=True)


@query(f"SELECT a_mo_id, b_mo_id, count(*) AS parts, {q('min(dist)', 'least')}, {q('max(sqrt(ax * ax + ay * ay))', 'most_at_start')} FROM ({_BOTH}) GROUP BY a_mo_id, b_mo_id")
def temporal_distance(w: World) -> DataFrame:
    return D.of_all_pairs(w.segments, ("parts", "near", "most"), both=True).selectExpr("a_mo_id", "b_mo_id", "parts", q("near", "least"), q("most", "most_at_start"))


# the same for all pairs of movers

_ALL = _pairs("segs", "segs", "a.mo_id < b.mo_id")


@query(f"SELECT a_mo_id, b_mo_id, {q('min(dist)', 'nad')} FROM ({_ALL}) GROUP BY a_mo_id, b_mo_id")
def nearest_approach_distance_of_all(w: World) -> DataFrame:
    return D.of_all_pairs(w.segments, ("near",)).selectExpr("a_mo_id", "b_mo_id", q("near", "nad"))


@query(
    f"SELECT a_mo_id, b_mo_id, us FROM (SELECT *, row_number() OVER (PARTITION BY a_mo_id, b_mo_id ORDER BY dist, s + CAST(floor((e - s) * lam + 0.5) AS BIGINT)) AS rn, s + CAST(floor((e - s) * lam + 0.5) AS BIGINT) AS us FROM ({_ALL})) WHERE rn = 1"
)
def nearest_approach_instant_of_all(w: World) -> DataFrame:
    return D.of_all_pairs(w.segments, ("us",))


@query(f"SELECT a_mo_id, b_mo_id, count(*) AS parts, {q('min(dist)', 'least')}, {q('max(sqrt(ax * ax + ay * ay))', 'most_at_start')} FROM ({_ALL}) GROUP BY a_mo_id, b_mo_id")
def temporal_distance_of_all(w: World) -> DataFrame:
    return D.of_all_pairs(w.segments, ("parts", "near", "most")).selectExpr("a_mo_id", "b_mo_id", "parts", q("near", "least"), q("most", "most_at_start"))


def _sides(one: str, two: str) -> str:
    a, b = (f"sign(({one}.x1 - {one}.x0) * ({two}.y{k} - {one}.y0) - ({one}.y1 - {one}.y0) * ({two}.x{k} - {one}.x0))" for k in (0, 1))
    return f"{a} * {b} <= 0"


@query(
    f"SELECT DISTINCT a.mo_id AS a_mo_id, b.mo_id AS b_mo_id FROM (SELECT * FROM segs WHERE {ASKED}) a, segs b WHERE a.vehid <> b.vehid AND {_sides('a', 'b')} AND {_sides('b', 'a')} AND "
    + " AND ".join(f"least(a.{c}0, a.{c}1) <= greatest(b.{c}0, b.{c}1) AND least(b.{c}0, b.{c}1) <= greatest(a.{c}0, a.{c}1)" for c in "xy")
)
def ever_intersects_mover(w: World) -> DataFrame:
    """Trips of the stated query set and all trips of others whose traces cross."""
    return R.ever_intersects_vehicles(w.segments.where(ASKED), w.segments)


@query(f"SELECT vehid, pointid, {q('min(' + K.point_distance('px', 'py') + ')', 'dist')} FROM segs, places GROUP BY vehid, pointid")
def min_distance_to_point(w: World) -> DataFrame:
    return D.distance_to_points(w.segments, w.places).selectExpr("vehid", "pointid", q("dist", "dist"))


@query(f"SELECT vehid, regionid, {q('min(' + K.box_distance() + ')', 'nad')} FROM segs, regions GROUP BY vehid, regionid")
def distance_to_region(w: World) -> DataFrame:
    return D.distance_to_boxes(w.segments, w.regions, ("vehid", "regionid")).selectExpr("vehid", "regionid", q("nad", "nad"))


# --- partitioners and tiling ----------------------------------------------------


def _cell(axis: str, v: str, n: int = CELLS) -> str:
    return f"least({n - 1}, CAST(floor(({v} - {axis}min) / (({axis}max - {axis}min) / {n})) AS BIGINT))"


_TILE = f"({_cell('x', 'x')} * {CELLS} + {_cell('y', 'y')}) * {CELLS} + {_cell('t', 'us')}"
_AXIS = {
    a: f"SELECT i AS {a}i, {a}min + i * (({a}max - {a}min) / {CELLS}) AS {a}min, CASE WHEN i = {CELLS - 1} THEN CAST({a}max AS DOUBLE) ELSE {a}min + (i + 1) * (({a}max - {a}min) / {CELLS}) END AS {a}max FROM ext, (SELECT unnest(range({CELLS})) AS i)"
    for a in "xyt"
}
_GRID = f"SELECT CAST((xi * {CELLS} + yi) * {CELLS} + ti AS BIGINT) AS tileid, xmin, xmax, ymin, ymax, tmin, tmax FROM ({_AXIS['x']}), ({_AXIS['y']}), ({_AXIS['t']})"
_CLIPPED = f"SELECT * FROM (SELECT s.*, tileid, {_ALO} AS lo, {_AHI} AS hi FROM segs s, ({_GRID})) WHERE {K.kept('lo', 'hi')}"


@query(_GRID)
def grid_tiles(w: World) -> DataFrame:
    return P.Grid(CELLS).grid(w.points)


@query(f"SELECT {_TILE} AS tileid, count(*) AS n FROM pts, ext GROUP BY 1")
def grid_assign(w: World) -> DataFrame:
    return P.Grid(CELLS).assign(w.points).groupBy("tileid").agg(F.count("*").alias("n"))


@query(f"SELECT tileid, count(*) AS pieces, count(DISTINCT vehid) AS vehicles, {q(f'sum(({K.length()}) * (hi - lo))', 'length', 1)} FROM ({_CLIPPED}) GROUP BY tileid")
def tile_clip(w: World) -> DataFrame:
    pieces = tiling.tile_segments(w.segments, P.Grid(CELLS).grid(w.points))
    return pieces.groupBy("tileid").agg(F.count("*").alias("pieces"), F.countDistinct("vehid").alias("vehicles"), F.expr(q(f"sum({K.length()})", "length", 1)))


@query(f"SELECT {q('ln(sum(n)) - sum(n * ln(n)) / sum(n)', 'entropy', 6)}, count(*) AS tiles, {q('avg(n)', 'mean', 6)}, {q('stddev_samp(n)', 'std', 6)} FROM (SELECT count(*) AS n FROM ({_CLIPPED}) GROUP BY tileid)")
def tile_entropy(w: World) -> DataFrame:
    counts = tiling.tile_segments(w.segments, P.Grid(CELLS).grid(w.points)).groupBy("tileid").count()
    both = tiling.entropy(counts).join(counts.agg(F.avg("count").alias("mean"), F.stddev_samp("count").alias("std")))
    return both.selectExpr(q("entropy", "entropy", 6), "tiles", q("mean", "mean", 6), q("std", "std", 6))


@query(f"SELECT instantid, tileid FROM instants i, ({_GRID}) g WHERE i.us >= g.tmin AND i.us <= g.tmax")
def tile_instants(w: World) -> DataFrame:
    return tiling.tile(w.instants, P.Grid(CELLS).grid(w.points), "t", {"t": ("us", "us")}).select("instantid", "tileid")


@query(f"SELECT periodid, tileid FROM periods p, ({_GRID}) g WHERE p.tmin <= g.tmax AND p.tmax >= g.tmin")
def tile_periods(w: World) -> DataFrame:
    p = w.periods.select("periodid", F.col("tmin").alias("beginp"), F.col("tmax").alias("endp"))
    return tiling.tile(p, P.Grid(CELLS).grid(w.points), "t", {"t": ("beginp", "endp")}).select("periodid", "tileid")


@query(f"SELECT pointid, tileid FROM qpts p, ({_GRID}) g WHERE p.x >= xmin AND p.x <= xmax AND p.y >= ymin AND p.y <= ymax")
def tile_points(w: World) -> DataFrame:
    return tiling.tile(w.query_points, P.Grid(CELLS).grid(w.points), "xy", {"x": ("x", "x"), "y": ("y", "y")}).select("pointid", "tileid")


@query(f"SELECT regionid, tileid FROM regions r, ({_GRID}) g WHERE r.xmin <= g.xmax AND r.xmax >= g.xmin AND r.ymin <= g.ymax AND r.ymax >= g.ymin")
def tile_regions(w: World) -> DataFrame:
    r = w.regions.selectExpr("regionid", *(f"{a}{e} AS r{a}{e}" for a in "xy" for e in ("min", "max")))
    return tiling.tile(r, P.Grid(CELLS).grid(w.points), "xy", {"x": ("rxmin", "rxmax"), "y": ("rymin", "rymax")}).select("regionid", "tileid")


@query(f"SELECT event_id, coalesce(min(tileid), -1) AS tileid FROM pts p LEFT JOIN (SELECT * FROM ({_GRID}) WHERE tileid % 2 = 0) g ON p.x >= xmin AND p.x <= xmax AND p.y >= ymin AND p.y <= ymax AND p.us >= g.tmin AND p.us <= g.tmax GROUP BY event_id")
def tile_of_points(w: World) -> DataFrame:
    """Tiles of points in a grid with gaps; -1 outside."""
    return tiling.tile_of_points(w.points, P.Grid(CELLS).grid(w.points).where("tileid % 2 = 0")).select("event_id", "tileid")


def _kd(depth: int) -> str:
    rows = "SELECT *, CAST(0 AS BIGINT) AS node FROM pts"
    for level in range(depth):
        axis = ("x", "y", "us")[level % 3]
        rows = f"SELECT * EXCLUDE (node, rn, n), node * 2 + CASE WHEN rn - 1 >= n // 2 THEN 1 ELSE 0 END AS node FROM (SELECT *, row_number() OVER (PARTITION BY node ORDER BY {axis}, event_id) AS rn, count(*) OVER (PARTITION BY node) AS n FROM ({rows}))"
    return rows


@query(f"SELECT node AS tileid, count(*) AS n, min(x) AS xlo, max(x) AS xhi, min(us) AS tlo, max(us) AS thi FROM ({_kd(DEPTH)}) GROUP BY node")
def kdtree_leaves(w: World) -> DataFrame:
    return P.KdTree(DEPTH).leaves(w.points).groupBy(F.col("node").alias("tileid")).agg(F.count("*").alias("n"), F.min("x").alias("xlo"), F.max("x").alias("xhi"), F.min("us").alias("tlo"), F.max("us").alias("thi"))


def _kd_boxes(depth: int) -> str:
    """Boxes from the points, split from the outer one inwards along with them."""
    box = [f"{a}{e}" for a in "xyt" for e in ("min", "max")]
    rows = f"SELECT event_id, x, y, us, CAST(0 AS BIGINT) AS node, {', '.join(f'CAST(ext.{c} AS DOUBLE) AS {c}' for c in box)} FROM pts, ext"
    for level in range(depth):
        axis, a = (("x", "x"), ("y", "y"), ("us", "t"))[level % 3]
        rows = f"SELECT *, row_number() OVER (PARTITION BY node ORDER BY {axis}, event_id) > count(*) OVER (PARTITION BY node) // 2 AS up FROM ({rows})"
        rows = f"SELECT *, min(CAST({axis} AS DOUBLE)) FILTER (WHERE up) OVER (PARTITION BY node) AS plane FROM ({rows})"
        cut = f"if(up, plane, {a}min) AS {a}min, if(up, {a}max, plane) AS {a}max"
        rows = f"SELECT event_id, x, y, us, node * 2 + if(up, 1, 0) AS node, {', '.join(c for c in box if c[0] != a)}, {cut} FROM ({rows})"
    return f"SELECT DISTINCT CAST(node AS BIGINT) AS tileid, {', '.join(box)} FROM ({rows})"


@query(_kd_boxes(DEPTH))
def kdtree_tiles(w: World) -> DataFrame:
    return P.KdTree(DEPTH).grid(w.points)


def _bins(axis: str) -> str:
    v = "us" if axis == "t" else axis
    return f"SELECT bin, lo, coalesce(lead(lo) OVER (ORDER BY bin), top) AS hi FROM (SELECT bin, min(v) AS lo, max(max(v)) OVER () AS top FROM (SELECT CAST({v} AS DOUBLE) AS v, ntile({BINS}) OVER (ORDER BY {v}, event_id) AS bin FROM pts) GROUP BY bin)"


@query(_bins("x"))
def adaptive_bins_x(w: World) -> DataFrame:
    return P.AdaptiveBins(BINS).axis_bins(w.points, "x")


@query(_bins("y"))
def adaptive_bins_y(w: World) -> DataFrame:
    return P.AdaptiveBins(BINS).axis_bins(w.points, "y")


@query(_bins("t"))
def adaptive_bins_t(w: World) -> DataFrame:
    return P.AdaptiveBins(BINS).axis_bins(w.points, "t")


@query(
    f"SELECT CAST(((t.bin - 1) * {BINS} + y.bin - 1) * {BINS} + x.bin - 1 AS BIGINT) AS tileid, x.lo AS xmin, x.hi AS xmax, y.lo AS ymin, y.hi AS ymax, t.lo AS tmin, t.hi AS tmax FROM ({_bins('t')}) t, ({_bins('y')}) y, ({_bins('x')}) x"
)
def adaptive_tiles(w: World) -> DataFrame:
    return P.AdaptiveBins(BINS).grid(w.points)


@query()
def approximate_tiles(w: World) -> DataFrame:
    return P.AdaptiveBins(BINS, exact=False).grid(w.points)


@query()
def kmeans_tiles(w: World) -> DataFrame:
    return P.BisectingKMeans(8).grid(w.points)


@query("SELECT vehid % 8 AS tileid, count(*) AS n FROM pts GROUP BY 1")
def hash_assign(w: World) -> DataFrame:
    return P.Hash(8).assign(w.points).groupBy("tileid").agg(F.count("*").alias("n"))


@query("SELECT event_id, CASE WHEN hi > lo THEN (x - lo) / (hi - lo) ELSE 0 END AS x_norm FROM (SELECT event_id, x, min(x) OVER (PARTITION BY vehid) AS lo, max(x) OVER (PARTITION BY vehid) AS hi FROM pts)")
def minmax_normalise(w: World) -> DataFrame:
    ends = w.points.groupBy("vehid").agg(F.min("x").alias("lo"), F.max("x").alias("hi"))
    return w.points.join(ends, "vehid").selectExpr("event_id", "CASE WHEN hi > lo THEN (x - lo) / (hi - lo) ELSE CAST(0 AS DOUBLE) END AS x_norm")


# --- tile joins, text, SQL functions, sessions ----------------------------------


@query(f"SELECT mo_id, s.vehid, instantid, {q(K.at('x', _LAM), 'x', 2)} FROM segs s, instants WHERE {K.covers('us')}")
def positions_by_tile(w: World) -> DataFrame:
    """Pieces and instants meet by tile; a position on a border of tiles comes once."""
    grid = P.Grid(CELLS).grid(w.points)
    pieces = tiling.tile_segments(w.segments, grid)
    at = tiling.tile(w.instants, grid, "t", {"t": ("us", "us")})
    found = pieces.join(at, "tileid").where(K.covers("us")).selectExpr("mo_id", "vehid", "instantid", f"{K.at('x', _LAM)} AS x")
    return found.groupBy("mo_id", "vehid", "instantid").agg(F.expr(q("min(x)", "x", 2)))


@query("SELECT mo_id, count(*) AS n, min(us) AS first_us, max(us) AS last_us, min(x) AS xmin, max(y) AS ymax, count(*) = 1 AS upper_inc FROM pts GROUP BY mo_id")
def text_round_trip(w: World) -> DataFrame:
    """Trips written as text and read back."""
    from ..sources import text

    written = w.trips.selectExpr("mo_id", f"{text.show_sequence('trip')} AS txt")
    trips = written.selectExpr("mo_id", f"{text.sequence('txt')} AS trip")
    return trips.selectExpr(
        "mo_id", "CAST(size(trip.inst) AS BIGINT) AS n", "array_min(trip.inst.us) AS first_us", "array_max(trip.inst.us) AS last_us",
        "array_min(trip.inst.x) AS xmin", "array_max(trip.inst.y) AS ymax", "trip.upper_inc AS upper_inc",
    )


@query(
    f"SELECT mo_id, count(*) AS segments, {q(f'sum({K.length()})', 'length', 2)}, max(CASE WHEN {K.covers(str(10 * DAY))} THEN {K.quantised(K.at('x', K.fraction(str(10 * DAY))))} END) AS x_at, "
    f"bool_or({K.kept(*K.clip('xy', '', 'b.'))}) AS meets FROM segs, (SELECT 20.0 AS xmin, 60.0 AS xmax, 20.0 AS ymin, 60.0 AS ymax) b GROUP BY mo_id"
)
def sql_functions(w: World) -> DataFrame:
    """Registered SQL functions on nested trips."""
    from ..functions import sql

    sql.register(w.spark)
    box = "bounds_as_box(20D, 60D, 20D, 60D, NULL, NULL, NULL, NULL)"
    return w.trips.selectExpr(
        "mo_id", "CAST(size(segs(trip)) AS BIGINT) AS segments", q("trip_length(trip)", "length", 2), f"{K.quantised(f'tpoint_at(trip, {10 * DAY}L).x')} AS x_at", f"ever_intersects(trip, {box}) AS meets"
    )


@query(
    "SELECT vehid, min(us) AS first_us, count(*) AS n, min(x) AS xmin, max(x) AS xmax, min(y) AS ymin, max(y) AS ymax FROM (SELECT *, sum(fresh) OVER (PARTITION BY vehid ORDER BY us, event_id) AS k FROM "
    "(SELECT *, CASE WHEN us - lag(us) OVER (PARTITION BY vehid ORDER BY us, event_id) < 21600000000 THEN 0 ELSE 1 END AS fresh FROM pts)) GROUP BY vehid, k"
)
def session_trips(w: World) -> DataFrame:
    """Trips closed by six hours without a point."""
    from ..streaming.trips import sessions

    found = sessions(w.points.withColumn("ts", F.timestamp_micros("us")), "6 hours")
    return found.select("vehid", F.unix_micros("start").alias("first_us"), "n", "xmin", "xmax", "ymin", "ymax")


@query("SELECT vehid, us // 1000000 * 1000000 AS us, x, y FROM (SELECT *, row_number() OVER (PARTITION BY vehid, us // 1000000 ORDER BY event_id) AS rn FROM raw) WHERE rn = 1")
def points_at_seconds(w: World) -> DataFrame:
    """The first point of each vehicle and second, as trips are loaded."""
    raw = w.raw.withColumn("us", F.expr("us div 1000000 * 1000000"))
    return T.dedup_points(raw, key="vehid", keep=("x", "y"))
