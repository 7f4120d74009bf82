"""Struct types of moving points, spans, boxes and geometries, as DDL text.

Times are whole microseconds from an origin (``us``), so that interpolation is
plain arithmetic in every engine; the SQL function ``us_of`` makes them from
timestamps.
"""

INSTANT = "STRUCT<us: BIGINT, x: DOUBLE, y: DOUBLE>"
#: Linear (or, with interp 'DISCRETE', isolated) instants; ends are inclusive or not.
SEQ = f"STRUCT<inst: ARRAY<{INSTANT}>, lower_inc: BOOLEAN, upper_inc: BOOLEAN, interp: STRING>"
SEQSET = f"ARRAY<{SEQ}>"
SPAN = "STRUCT<lo: BIGINT, hi: BIGINT, lo_inc: BOOLEAN, hi_inc: BOOLEAN>"
STBOX = "STRUCT<xmin: DOUBLE, xmax: DOUBLE, ymin: DOUBLE, ymax: DOUBLE, zmin: DOUBLE, zmax: DOUBLE, tmin: BIGINT, tmax: BIGINT>"
#: A point has no edges; a polygon's rings are lists of edges.
EDGE = "STRUCT<ax: DOUBLE, ay: DOUBLE, bx: DOUBLE, by: DOUBLE>"
GEOM = f"STRUCT<kind: STRING, x: DOUBLE, y: DOUBLE, edges: ARRAY<{EDGE}>>"
TFLOAT = "ARRAY<STRUCT<us: BIGINT, v: DOUBLE>>"
