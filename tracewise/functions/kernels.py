"""Closed-form kernels on linear segments, as SQL text.

A segment goes from (t0, x0, y0) to (t1, x1, y1). Every kernel is scalar
arithmetic, so it stays inside code generation and reads the same in any SQL
engine; ``F.expr`` makes a column of it. ``p`` is a prefix such as ``"a."``.
"""

from __future__ import annotations


def fraction(t: str, p: str = "") -> str:
    """How far along the segment time ``t`` is; 0 on a segment of no duration."""
    return f"coalesce(CAST({t} - {p}t0 AS DOUBLE) / nullif({p}t1 - {p}t0, 0), CAST(0 AS DOUBLE))"


def covers(t: str, p: str = "") -> str:
    """The segment is defined at ``t``."""
    return f"({p}t0 <= {t} AND ({t} < {p}t1 OR ({t} = {p}t1 AND {p}upper_inc)))"


def at(axis: str, lam: str, p: str = "") -> str:
    """Coordinate (``x``, ``y``) at the fraction ``lam``."""
    return f"({p}{axis}0 + ({p}{axis}1 - {p}{axis}0) * ({lam}))"


def time_at(lam: str, p: str = "") -> str:
    """Time at a fraction, in whole microseconds."""
    return f"({p}t0 + CAST(floor(({p}t1 - {p}t0) * ({lam}) + 0.5) AS BIGINT))"


def length(p: str = "") -> str:
    return f"sqrt(({p}x1 - {p}x0) * ({p}x1 - {p}x0) + ({p}y1 - {p}y0) * ({p}y1 - {p}y0))"


def _enter(v0: str, v1: str, lo: str, hi: str) -> str:
    return f"CASE WHEN {v1} = {v0} THEN CASE WHEN {v0} >= {lo} AND {v0} <= {hi} THEN 0.0 ELSE 2.0 END ELSE least(CAST({lo} - {v0} AS DOUBLE) / ({v1} - {v0}), CAST({hi} - {v0} AS DOUBLE) / ({v1} - {v0})) END"


def _leave(v0: str, v1: str, lo: str, hi: str) -> str:
    return f"CASE WHEN {v1} = {v0} THEN 1.0 ELSE greatest(CAST({lo} - {v0} AS DOUBLE) / ({v1} - {v0}), CAST({hi} - {v0} AS DOUBLE) / ({v1} - {v0})) END"


def clip(axes: str, p: str = "", b: str = "") -> tuple[str, str]:
    """Fractions where the segment enters and leaves a closed box (prefix ``b``) on ``axes`` such as ``"xyt"``."""
    enter = ", ".join(_enter(f"{p}{a}0", f"{p}{a}1", f"{b}{a}min", f"{b}{a}max") for a in axes)
    leave = ", ".join(_leave(f"{p}{a}0", f"{p}{a}1", f"{b}{a}min", f"{b}{a}max") for a in axes)
    return f"CAST(greatest(0.0, {enter}) AS DOUBLE)", f"CAST(least(1.0, {leave}) AS DOUBLE)"


def kept(lo: str, hi: str, p: str = "") -> str:
    """A clip result is not empty; the exclusive end of a sequence alone is nothing."""
    return f"({lo} <= {hi} AND ({lo} < 1 OR {p}upper_inc OR {p}t0 = {p}t1))"


def point_distance(px: str, py: str, p: str = "") -> str:
    """Distance of a point from a segment."""
    dx, dy = f"({p}x1 - {p}x0)", f"({p}y1 - {p}y0)"
    lam = f"least(1.0, greatest(0.0, coalesce((({px} - {p}x0) * {dx} + ({py} - {p}y0) * {dy}) / nullif({dx} * {dx} + {dy} * {dy}, 0), 0)))"
    ex, ey = f"({p}x0 + {dx} * {lam} - {px})", f"({p}y0 + {dy} * {lam} - {py})"
    return f"sqrt({ex} * {ex} + {ey} * {ey})"


def _point_box(px: str, py: str, b: str) -> str:
    gx = f"greatest(0.0, {b}xmin - {px}, {px} - {b}xmax)"
    gy = f"greatest(0.0, {b}ymin - {py}, {py} - {b}ymax)"
    return f"sqrt({gx} * {gx} + {gy} * {gy})"


def box_distance(p: str = "", b: str = "") -> str:
    """Distance of a segment from a rectangle: zero where they meet, else from an end or to a corner."""
    lo, hi = clip("xy", p, b)
    corners = ", ".join(point_distance(f"{b}{x}", f"{b}{y}", p) for x in ("xmin", "xmax") for y in ("ymin", "ymax"))
    return f"CASE WHEN {lo} <= {hi} THEN 0.0 ELSE least({_point_box(f'{p}x0', f'{p}y0', b)}, {_point_box(f'{p}x1', f'{p}y1', b)}, {corners}) END"


def crosses(p: str = "a.", q: str = "b.") -> str:
    """Two segments' traces meet (bounding boxes of collinear ones decide)."""
    def side(px, py, s):
        return f"sign(({s}x1 - {s}x0) * ({py} - {s}y0) - ({s}y1 - {s}y0) * ({px} - {s}x0))"

    overlap = " AND ".join(
        f"least({p}{a}0, {p}{a}1) <= greatest({q}{a}0, {q}{a}1) AND least({q}{a}0, {q}{a}1) <= greatest({p}{a}0, {p}{a}1)" for a in "xy"
    )
    return (
        f"({overlap} AND {side(f'{q}x0', f'{q}y0', p)} * {side(f'{q}x1', f'{q}y1', p)} <= 0"
        f" AND {side(f'{p}x0', f'{p}y0', q)} * {side(f'{p}x1', f'{p}y1', q)} <= 0)"
    )


def approach(p: str = "a.", q: str = "b.") -> dict[str, str]:
    """Terms of the nearest approach of two movers on their common time.

    s, e: the common interval; ``common``: it is not empty; lam: fraction of it
    at which they are nearest; dist: that distance; when: that time.
    """
    s, e = f"greatest({p}t0, {q}t0)", f"least({p}t1, {q}t1)"

    def offset(axis, t):
        return f"({at(axis, fraction(t, p), p)} - {at(axis, fraction(t, q), q)})"

    ax, ay = offset("x", s), offset("y", s)
    vx, vy = f"({offset('x', e)} - {ax})", f"({offset('y', e)} - {ay})"
    lam = f"least(1.0, greatest(0.0, coalesce(-({ax} * {vx} + {ay} * {vy}) / nullif({vx} * {vx} + {vy} * {vy}, 0), 0)))"
    return {
        "s": s, "e": e, "ax": ax, "ay": ay, "vx": vx, "vy": vy, "lam": lam,
        "common": f"({s} < {e} OR ({s} = {e} AND ({s} < {p}t1 OR {p}upper_inc) AND ({s} < {q}t1 OR {q}upper_inc)))",
    }


def approach_distance(c: str = "") -> str:
    """Distance at the nearest approach, from columns ax, ay, vx, vy, lam."""
    return f"sqrt(({c}ax + {c}vx * {c}lam) * ({c}ax + {c}vx * {c}lam) + ({c}ay + {c}vy * {c}lam) * ({c}ay + {c}vy * {c}lam))"


def quantised(value: str, digits: int = 4) -> str:
    """Rounded half up in a way that every engine does alike."""
    k = 10**digits
    return f"floor(({value}) * {k} + 0.5) / {k}"


# --- polygons: the same text but for each engine's lambda syntax -------------


class Spark:
    name = "spark"

    @staticmethod
    def each(items, var, body):
        return f"transform({items}, {var} -> {body})"

    @staticmethod
    def where(items, var, body):
        return f"filter({items}, {var} -> {body})"

    @staticmethod
    def cuts(found):
        return f"array_sort(array_distinct(concat(array(CAST(0 AS DOUBLE), CAST(1 AS DOUBLE)), {found})))"

    @staticmethod
    def steps(cuts, body):
        return f"aggregate(transform(sequence(1, size({cuts}) - 1), k -> {body(f'{cuts}[k - 1]', f'{cuts}[k]')}), CAST(0 AS DOUBLE), (acc, v) -> acc + v)"

    size = staticmethod(lambda items: f"size({items})")


class Duck:
    name = "duck"

    @staticmethod
    def each(items, var, body):
        return f"list_transform({items}, lambda {var}: {body})"

    @staticmethod
    def where(items, var, body):
        return f"list_filter({items}, lambda {var}: {body})"

    @staticmethod
    def cuts(found):
        return f"list_sort(list_distinct(list_concat([CAST(0 AS DOUBLE), CAST(1 AS DOUBLE)], {found})))"

    @staticmethod
    def steps(cuts, body):
        return f"list_reduce(list_concat([CAST(0 AS DOUBLE)], list_transform(range(1, len({cuts})), lambda k: {body(f'{cuts}[k]', f'{cuts}[k + 1]')})), lambda acc, v: acc + v)"

    size = staticmethod(lambda items: f"len({items})")


def inside(px: str, py: str, edges: str, e=Spark) -> str:
    """A point is in a ring, by the number of edges that a ray from it crosses."""
    body = f"((q.ay > {py}) <> (q.by > {py})) AND {px} < (q.bx - q.ax) * ({py} - q.ay) / (q.by - q.ay) + q.ax"
    return f"({e.size(e.where(edges, 'q', body))} % 2 = 1)"


def ring_cuts(edges: str, p: str = "", e=Spark) -> str:
    """Sorted fractions at which the segment crosses the ring, 0 and 1 included."""
    dx, dy = f"({p}x1 - {p}x0)", f"({p}y1 - {p}y0)"
    ex, ey = "(q.bx - q.ax)", "(q.by - q.ay)"
    den = f"({dx} * {ey} - {dy} * {ex})"
    lam = f"((q.ax - {p}x0) * {ey} - (q.ay - {p}y0) * {ex}) / {den}"
    mu = f"((q.ax - {p}x0) * {dy} - (q.ay - {p}y0) * {dx}) / {den}"
    body = f"CASE WHEN {den} <> 0 THEN CASE WHEN {lam} > 0 AND {lam} < 1 AND {mu} >= 0 AND {mu} <= 1 THEN {lam} END END"
    return e.cuts(e.where(e.each(edges, "q", body), "w", "w IS NOT NULL"))


def inside_share(cuts: str, edges: str, p: str = "", e=Spark) -> str:
    """Share of the segment inside the ring; each stretch between cuts is tested at its middle."""

    def body(a, b):
        mid = f"(({a} + {b}) / 2)"
        return f"CASE WHEN {inside(at('x', mid, p), at('y', mid, p), edges, e)} THEN {b} - {a} ELSE CAST(0 AS DOUBLE) END"

    return e.steps(cuts, body)
