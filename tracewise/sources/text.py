"""Text forms of moving points, spans, boxes and geometries, as column expressions.

Formats (fixed): ``POINT(x y)@time``, ``[p, p)``, ``{[p, p), [p]}``, ``[time,
time]``, ``STBOX XT(((x,y),(x,y)),[t,t])``, ``SRID=n;POLYGON ((x y, ...))``.
Times without an offset are in the session's zone.
"""

from __future__ import annotations

_NUMBER = r"[-+0-9.eE]+"
_INST = rf"POINT\\s*Z?\\s*\\([^)]*\\)@[^,\\])}}]+"
_PARTS = rf"POINT\\s*Z?\\s*\\(({_NUMBER}) ({_NUMBER})[^)]*\\)@([^,\\])}}]+)"
_SEQ = rf"[\\[(]{_INST}(?:,\\s*{_INST})*[\\])]"


def micros(text: str) -> str:
    """Microseconds of a timestamp text."""
    return f"unix_micros(CAST(trim({text}) AS TIMESTAMP))"


def _instant(m: str) -> str:
    x, y, t = (f"regexp_extract({m}, '{_PARTS}', {i})" for i in (1, 2, 3))
    return f"named_struct('us', {micros(t)}, 'x', CAST({x} AS DOUBLE), 'y', CAST({y} AS DOUBLE))"


def instant(text: str) -> str:
    """One instant; null where the text is none."""
    return f"CASE WHEN {text} RLIKE '^\\\\s*{_PARTS}\\\\s*$' THEN {_instant(text)} END"


def sequence(text: str) -> str:
    """A sequence, or a single instant as a closed one; null where the text holds no instant."""
    inst = f"transform(regexp_extract_all({text}, '{_INST}', 0), m -> {_instant('m')})"
    bare = f"NOT (trim({text}) RLIKE '^[\\\\[(]')"
    return (
        f"CASE WHEN {text} RLIKE '{_PARTS}' THEN named_struct('inst', {inst}, 'lower_inc', {bare} OR trim({text}) LIKE '[%',"
        f" 'upper_inc', {bare} OR trim({text}) LIKE '%]', 'interp', 'LINEAR') END"
    )


def sequence_set(text: str) -> str:
    """The sequences of a set; a bare sequence is a set of one."""
    return f"transform(regexp_extract_all({text}, '{_SEQ}', 0), z -> {sequence('z')})"


def span(text: str) -> str:
    part = r"^\\s*([\\[(])\\s*([^,]+),\\s*([^\\])]+)([\\])])\\s*$"
    take = lambda i: f"regexp_extract({text}, '{part}', {i})"
    return f"CASE WHEN {text} RLIKE '{part}' THEN named_struct('lo', {micros(take(2))}, 'hi', {micros(take(3))}, 'lo_inc', {take(1)} = '[', 'hi_inc', {take(4)} = ']') END"


def box(text: str) -> str:
    """``STBOX X`` or ``STBOX XT``; missing dimensions are null."""
    n = rf"({_NUMBER})"
    part = rf"\\(\\(\\(?{n},\\s*{n}\\),\\s*\\({n},\\s*{n}\\)"
    num = lambda i: f"CAST(regexp_extract({text}, '{part}', {i}) AS DOUBLE)"
    time = r"\\[([^,\\]]+),\\s*([^\\]]+)\\]"
    t = lambda i: f"CASE WHEN {text} RLIKE '{time}' THEN {micros(f'''regexp_extract({text}, '{time}', {i})''')} END"
    return (
        f"CASE WHEN {text} RLIKE '{part}' THEN named_struct('xmin', {num(1)}, 'xmax', {num(3)}, 'ymin', {num(2)}, 'ymax', {num(4)},"
        f" 'zmin', CAST(NULL AS DOUBLE), 'zmax', CAST(NULL AS DOUBLE), 'tmin', {t(1)}, 'tmax', {t(2)}) END"
    )


def geometry(text: str) -> str:
    """Points and polygons (outer and inner rings' edges), with or without a leading SRID."""
    bare = f"regexp_replace({text}, '^SRID=[0-9]+;', '')"
    point = rf"^\\s*POINT\\s*\\(\\s*({_NUMBER})\\s+({_NUMBER})"
    num = lambda i: f"CASE WHEN {bare} RLIKE '{point}' THEN CAST(regexp_extract({bare}, '{point}', {i}) AS DOUBLE) END"
    corner = "transform(split(r, ','), c -> named_struct('x', CAST(split(trim(c), '\\\\s+')[0] AS DOUBLE), 'y', CAST(split(trim(c), '\\\\s+')[1] AS DOUBLE)))"
    rings = rf"regexp_extract_all({bare}, '\\(([^()]+)\\)', 1)"
    edge = "named_struct('ax', p.x, 'ay', p.y, 'bx', cs[i + 1].x, 'by', cs[i + 1].y)"
    edges = f"flatten(transform(transform({rings}, r -> {corner}), cs -> transform(slice(cs, 1, size(cs) - 1), (p, i) -> {edge})))"
    poly = f"{bare} RLIKE '^\\\\s*(MULTI)?POLYGON'"
    return f"CASE WHEN {bare} RLIKE '{point}' OR {poly} THEN named_struct('kind', CASE WHEN {poly} THEN 'polygon' ELSE 'point' END, 'x', {num(1)}, 'y', {num(2)}, 'edges', CASE WHEN {poly} THEN {edges} END) END"


def show_instant(i: str) -> str:
    return f"concat('POINT(', {i}.x, ' ', {i}.y, ')@', date_format(timestamp_micros({i}.us), 'yyyy-MM-dd HH:mm:ss.SSSSSS'), '+00')"


def show_sequence(s: str) -> str:
    """Text of a sequence that :func:`sequence` reads back unchanged (in a UTC session)."""
    return f"concat(CASE WHEN {s}.lower_inc THEN '[' ELSE '(' END, array_join(transform({s}.inst, i -> {show_instant('i')}), ', '), CASE WHEN {s}.upper_inc THEN ']' ELSE ')' END)"


def show_sequence_set(ss: str) -> str:
    return f"concat('{{', array_join(transform({ss}, s -> {show_sequence('s')}), ', '), '}}')"
