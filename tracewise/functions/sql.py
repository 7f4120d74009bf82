"""SQL functions on nested moving points, defined as SQL expressions.

:func:`register` creates temporary functions that the optimizer inlines, so
``spark.sql`` users call them by name without Python workers (only reading of
binary geometries is one). Times are microseconds (BIGINT); ``us_of`` makes
them from timestamps.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

from ..sources import text, wkb
from ..types import GEOM, INSTANT, SEQ, SEQSET, SPAN, STBOX, TFLOAT
from . import kernels as K

_SEGMENT = "STRUCT<t0: BIGINT, x0: DOUBLE, y0: DOUBLE, t1: BIGINT, x1: DOUBLE, y1: DOUBLE, upper_inc: BOOLEAN>"
_PIECE = "named_struct('inst', array(named_struct('us', {t0}, 'x', {x0}, 'y', {y0}), named_struct('us', {t1}, 'x', {x1}, 'y', {y1})), 'lower_inc', true, 'upper_inc', {upper}, 'interp', 'LINEAR')"
_NOBODY = "CAST(NULL AS DOUBLE)"


def _pieces(axes: str, rename: dict[str, str]) -> str:
    """Pieces of a trip's segments in a box; touching pieces stay apart."""
    lo, hi = K.clip(axes, "s.", "b.")
    for a, b in rename.items():
        lo, hi = lo.replace(a, b), hi.replace(a, b)
    ends = {f"{a}{j}": (K.at(a, lam, "s.") if a != "t" else K.time_at(lam, "s.")) for j, lam in ((0, "s.lo"), (1, "s.hi")) for a in "txy"}
    cut = f"transform(segs(trip), s -> named_struct({', '.join(f'''{chr(39)}{c}{chr(39)}, s.{c}''' for c in ('t0', 'x0', 'y0', 't1', 'x1', 'y1', 'upper_inc'))}, 'lo', {lo}, 'hi', {hi}))"
    piece = _PIECE.format(upper="s.upper_inc OR s.hi < 1 OR s.lo = s.hi", **ends)
    return f"transform(filter({cut}, s -> {K.kept('s.lo', 's.hi', 's.')}), s -> {piece})"


def _ring_pieces() -> str:
    """Pieces of a trip's segments inside a polygon; touching pieces stay apart."""
    mid = "((w.c[k - 1] + w.c[k]) / 2)"
    ends = {f"{a}{j}": (K.at(a, lam, "w.s.") if a != "t" else K.time_at(lam, "w.s.")) for j, lam in ((0, "w.c[k - 1]"), (1, "w.c[k]")) for a in "txy"}
    piece = _PIECE.format(upper="w.s.upper_inc OR w.c[k] < 1", **ends)
    body = f"CASE WHEN {K.inside(K.at('x', mid, 'w.s.'), K.at('y', mid, 'w.s.'), 'geom.edges')} THEN {piece} END"
    cut = f"transform(segs(trip), s -> named_struct('s', s, 'c', {K.ring_cuts('geom.edges', 's.')}))"
    return f"filter(flatten(transform({cut}, w -> transform(sequence(1, size(w.c) - 1), k -> {body}))), z -> z IS NOT NULL)"


def _pairs() -> str:
    t = K.approach("a.", "b.")
    terms = ", ".join(f"'{c}', {t[c]}" for c in ("s", "e", "ax", "ay", "vx", "vy", "lam"))
    at = {f"p{x}": K.at(x, K.fraction(t["s"], "a."), "a.") for x in "xy"} | {f"q{x}": K.at(x, K.fraction(t["e"], "a."), "a.") for x in "xy"}
    ends = ", ".join(f"'{n}', {v}" for n, v in at.items())
    body = f"CASE WHEN {t['common']} THEN named_struct({terms}, {ends}) END"
    return f"filter(flatten(transform(segs(a), a -> transform(segs(b), b -> {body}))), w -> w IS NOT NULL)"


_TERM = "STRUCT<s: BIGINT, e: BIGINT, ax: DOUBLE, ay: DOUBLE, vx: DOUBLE, vy: DOUBLE, lam: DOUBLE, px: DOUBLE, py: DOUBLE, qx: DOUBLE, qy: DOUBLE>"


def definitions() -> list[tuple[str, str, str, str]]:
    """(name, parameters, result, expression), in an order in which each uses only earlier ones."""
    point = "STRUCT<x: DOUBLE, y: DOUBLE>"
    one = lambda c: f"trip.inst[0].{c}"
    xlo, xhi = K.clip("xy", "s.", "box.")

    def border(lam: str) -> str:
        x, y = K.at("x", lam, "s."), K.at("y", lam, "s.")
        return f"(({lam}) > 0 AND ({lam}) < 1 OR {x} = box.xmin OR {x} = box.xmax OR {y} = box.ymin OR {y} = box.ymax)"

    segment = "named_struct('t0', {i}.us, 'x0', {i}.x, 'y0', {i}.y, 't1', {j}.us, 'x1', {j}.x, 'y1', {j}.y, 'upper_inc', {u})"
    inner = segment.format(i="trip.inst[k]", j="trip.inst[k + 1]", u="trip.upper_inc AND k = size(trip.inst) - 2")
    alone = segment.format(i="trip.inst[0]", j="trip.inst[0]", u="true")
    dist = K.approach_distance("w.")
    when = "w.s + CAST(floor((w.e - w.s) * w.lam + 0.5) AS BIGINT)"
    return [
        ("us_of", "t TIMESTAMP", "BIGINT", "unix_micros(t)"),
        ("tboolinst_from_base_time", "t TIMESTAMP", "BIGINT", "unix_micros(t)"),
        ("datetime_to_tinstant", "t TIMESTAMP", "BIGINT", "unix_micros(t)"),
        ("create_point_udf", "lat DOUBLE, lon DOUBLE, us BIGINT", INSTANT, "named_struct('us', us, 'x', lon, 'y', lat)"),
        ("create_pointseq_instants_udf", "lats ARRAY<DOUBLE>, lons ARRAY<DOUBLE>, times ARRAY<BIGINT>", "INT", "size(arrays_zip(lats, lons, times))"),
        ("tgeompointinst", f"point {point}, us BIGINT", INSTANT, "named_struct('us', us, 'x', point.x, 'y', point.y)"),
        ("tgeompointseq", f"point {point}, span {SPAN}", SEQ, "named_struct('inst', array(named_struct('us', span.lo, 'x', point.x, 'y', point.y), named_struct('us', span.hi, 'x', point.x, 'y', point.y)), 'lower_inc', true, 'upper_inc', true, 'interp', 'DISCRETE')"),
        ("tgeompointseq_from_instant_list", f"list ARRAY<{INSTANT}>", SEQ, "CASE WHEN size(list) > 0 THEN named_struct('inst', array_sort(list), 'lower_inc', true, 'upper_inc', size(list) = 1, 'interp', 'LINEAR') END"),
        ("tgeompointseq_from_tpoint_list", f"list ARRAY<{INSTANT}>", SEQ, f"CASE WHEN size(list) > 0 THEN tgeompointseq_from_instant_list(filter(list, (p, i) -> NOT exists(slice(list, 1, i), z -> z.us = p.us))) END"),
        ("tgeompointseqset", "txt STRING", SEQSET, text.sequence_set("txt")),
        ("tstzspan", "txt STRING", SPAN, text.span("txt")),
        ("tstzspan_from_values", "lo BIGINT, hi BIGINT", SPAN, "CASE WHEN lo < hi THEN named_struct('lo', lo, 'hi', hi, 'lo_inc', true, 'hi_inc', false) END"),
        ("geometry_from_wkt", "txt STRING", GEOM, text.geometry("txt")),
        ("bounds_as_box", "xmin DOUBLE, xmax DOUBLE, ymin DOUBLE, ymax DOUBLE, tmin BIGINT, tmax BIGINT, zmin DOUBLE, zmax DOUBLE", STBOX, "named_struct('xmin', xmin, 'xmax', xmax, 'ymin', ymin, 'ymax', ymax, 'zmin', zmin, 'zmax', zmax, 'tmin', tmin, 'tmax', tmax)"),
        ("get_point_x", f"trip {SEQ}", "DOUBLE", one("x")),
        ("get_point_y", f"trip {SEQ}", "DOUBLE", one("y")),
        ("get_point_z", f"trip {SEQ}", "DOUBLE", _NOBODY),
        ("get_point_timestamp", f"trip {SEQ}", "BIGINT", one("us")),
        ("point_to_stbox", f"trip {SEQ}", STBOX, "named_struct('xmin', array_min(trip.inst.x), 'xmax', array_max(trip.inst.x), 'ymin', array_min(trip.inst.y), 'ymax', array_max(trip.inst.y), 'zmin', CAST(NULL AS DOUBLE), 'zmax', CAST(NULL AS DOUBLE), 'tmin', array_min(trip.inst.us), 'tmax', array_max(trip.inst.us))"),
        ("instants", f"trip {SEQ}", f"ARRAY<{INSTANT}>", "trip.inst"),
        ("sequences", f"trips {SEQSET}", SEQSET, "trips"),
        ("timestamps", f"trip {SEQ}", "ARRAY<BIGINT>", "trip.inst.us"),
        ("spatial_values", f"trip {SEQ}, dim STRING", "ARRAY<DOUBLE>", "CASE dim WHEN 'x' THEN trip.inst.x WHEN 'y' THEN trip.inst.y END"),
        ("geometry_values", f"trip {SEQ}", f"ARRAY<{point}>", "transform(trip.inst, i -> named_struct('x', i.x, 'y', i.y))"),
        ("num_instants", f"trip {SEQ}", "INT", "size(trip.inst)"),
        ("segs", f"trip {SEQ}", f"ARRAY<{_SEGMENT}>", f"CASE WHEN size(trip.inst) = 1 THEN array({alone}) WHEN size(trip.inst) > 1 THEN transform(sequence(0, size(trip.inst) - 2), k -> {inner}) END"),
        ("length", f"trip {SEQ}", "DOUBLE", f"aggregate(segs(trip), CAST(0 AS DOUBLE), (acc, s) -> acc + {K.length('s.')})"),
        ("tpoint_at", f"trip {SEQ}, us BIGINT", INSTANT, f"get(transform(filter(segs(trip), s -> {K.covers('us', 's.')}), s -> named_struct('us', us, 'x', {K.at('x', K.fraction('us', 's.'), 's.')}, 'y', {K.at('y', K.fraction('us', 's.'), 's.')})), 0)"),
        ("at_period", f"trip {SEQ}, span {SPAN}", SEQSET, _pieces("t", {"b.tmin": "span.lo", "b.tmax": "span.hi"})),
        ("at_stbox", f"trip {SEQ}, box {STBOX}", SEQSET, _pieces("xyt", {"b.": "box."})),
        ("ever_intersects", f"trip {SEQ}, box {STBOX}", "BOOLEAN", f"exists(segs(trip), s -> {K.kept(xlo, xhi, 's.')})"),
        ("ever_touches", f"trip {SEQ}, box {STBOX}", "BOOLEAN", f"exists(segs(trip), s -> {K.kept(xlo, xhi, 's.')} AND ({border(xlo)} OR {border(xhi)}))"),
        ("temporally_contains", f"a {SPAN}, b {SPAN}", "BOOLEAN", "(a.lo < b.lo OR (a.lo = b.lo AND (a.lo_inc OR NOT b.lo_inc))) AND (a.hi > b.hi OR (a.hi = b.hi AND (a.hi_inc OR NOT b.hi_inc)))"),
        ("temporally_overlaps", f"a {SPAN}, b {SPAN}", "BOOLEAN", "(a.lo < b.hi OR (a.lo = b.hi AND a.lo_inc AND b.hi_inc)) AND (b.lo < a.hi OR (b.lo = a.hi AND b.lo_inc AND a.hi_inc))"),
        ("contains_stbox_stbox", f"a {STBOX}, b {STBOX}", "BOOLEAN", " AND ".join(f"(a.{c}min IS NULL OR b.{c}min IS NULL OR (a.{c}min <= b.{c}min AND a.{c}max >= b.{c}max))" for c in "xyzt")),
        ("approach_terms", f"a {SEQ}, b {SEQ}", f"ARRAY<{_TERM}>", _pairs()),
        ("distance", f"a {SEQ}, b {SEQ}", TFLOAT, f"array_sort(array_distinct(flatten(transform(approach_terms(a, b), w -> array(named_struct('us', w.s, 'v', sqrt(w.ax * w.ax + w.ay * w.ay)), named_struct('us', {when}, 'v', {dist}), named_struct('us', w.e, 'v', sqrt((w.ax + w.vx) * (w.ax + w.vx) + (w.ay + w.vy) * (w.ay + w.vy))))))))"),
        ("min_distance", f"a {SEQ}, b {SEQ}", "DOUBLE", f"array_min(transform(approach_terms(a, b), w -> {dist}))"),
        ("nearest_approach_distance", f"a {SEQ}, b {SEQ}", "DOUBLE", f"array_min(transform(approach_terms(a, b), w -> {dist}))"),
        ("nearest_approach_instant", f"a {SEQ}, b {SEQ}", INSTANT, f"array_min(transform(approach_terms(a, b), w -> named_struct('d', {dist}, 'p', named_struct('us', {when}, 'x', w.px + (w.qx - w.px) * w.lam, 'y', w.py + (w.qy - w.py) * w.lam)))).p"),
        ("at_geom", f"trip {SEQ}, geom {GEOM}", SEQSET, _ring_pieces()),
        ("ever_intersects_geom", f"trip {SEQ}, geom {GEOM}", "BOOLEAN", f"exists(segs(trip), s -> CASE WHEN geom.kind = 'point' THEN {K.point_distance('geom.x', 'geom.y', 's.')} = 0 ELSE {K.inside('s.x0', 's.y0', 'geom.edges')} OR size({K.ring_cuts('geom.edges', 's.')}) > 2 END)"),
        ("min_distance_geom", f"trip {SEQ}, geom {GEOM}", "DOUBLE", f"CASE WHEN geom.kind = 'point' THEN array_min(transform(segs(trip), s -> {K.point_distance('geom.x', 'geom.y', 's.')})) END"),
    ]


def register(spark: SparkSession) -> list[str]:
    """Creates all functions in the session and returns their names."""
    names = []
    for name, params, result, body in definitions():
        if name == "length":
            name = "trip_length"  # the name without prefix is the built-in one for strings
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({params}) RETURNS {result} RETURN {body}")
        names.append(name)
    wkb.register(spark)
    return [*names, "geometry_from_hexwkb", "trip_from_hexwkb"]
