"""Binary forms in hexadecimal, for the I/O edge only: points, lines, polygons, and trips.

A trip is: byte order; type (two bytes); flags (subtype in bits 0 and 1,
interpolation in bits 2 and 3, then z, geodetic, reference system); the number
of the reference system if flagged; and, by subtype, one instant, a sequence or
a list of sequences. A sequence is the number of its instants, a byte that tells
whether its ends are included, and the instants: coordinates and microseconds
from the year 2000. Heights are read over.
"""

from __future__ import annotations

import struct

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..types import GEOM, SEQSET


def decode(text: str | None) -> tuple | None:
    """(kind, x, y, edges) of one geometry; null where the text is none that is known."""
    if not text:
        return None
    try:
        data = bytes.fromhex(text)
        order = "<" if data[0] == 1 else ">"
        kind = struct.unpack_from(order + "I", data, 1)[0]
        at = 9 if kind & 0x20000000 else 5
        size = 2 + bool(kind & 0x80000000) + bool(kind & 0x40000000)
        kind &= 0xFF
        if kind == 1:
            return ("point", *struct.unpack_from(order + "2d", data, at), None)
        if kind == 2:
            (n,) = struct.unpack_from(order + "I", data, at)
            flat = struct.unpack_from(f"{order}{n * size}d", data, at + 4)
            corners = [(flat[i * size], flat[i * size + 1]) for i in range(n)]
            return ("line", None, None, [(*a, *b) for a, b in zip(corners, corners[1:])])
        if kind != 3:
            return None
        (rings,) = struct.unpack_from(order + "I", data, at)
        at, edges = at + 4, []
        for _ in range(rings):
            (n,) = struct.unpack_from(order + "I", data, at)
            flat = struct.unpack_from(f"{order}{n * size}d", data, at + 4)
            at += 4 + 8 * n * size
            corners = [(flat[i * size], flat[i * size + 1]) for i in range(n)]
            edges += [(*a, *b) for a, b in zip(corners, corners[1:])]
        return ("polygon", None, None, edges)
    except (ValueError, struct.error, IndexError):
        return None


def encode_point(x: float, y: float, srid: int | None = None) -> str:
    head = struct.pack("<BI", 1, 1 | (0x20000000 if srid is not None else 0))
    return (head + (struct.pack("<I", srid) if srid is not None else b"") + struct.pack("<2d", x, y)).hex().upper()


#: Unix time of the year 2000 in microseconds, and names of interpolations by number.
EPOCH_2000 = 946_684_800_000_000
INTERPOLATIONS = ("NONE", "DISCRETE", "STEP", "LINEAR")


def decode_trip(text: str | None) -> list[tuple] | None:
    """Sequences (instants, lower_inc, upper_inc, interpolation) of one trip; null where the text is none."""
    if not text:
        return None
    try:
        data = bytes.fromhex(text)
        order, flags, at = "<" if data[0] == 1 else ">", data[3], 8 if data[3] & 0x40 else 4
        subtype, interp, dims = flags & 3, INTERPOLATIONS[flags >> 2 & 3], 3 if flags & 0x10 else 2
        one = struct.Struct(f"{order}{dims}dq")

        def sequence(at: int) -> tuple[tuple, int]:
            n, ends = struct.unpack_from(order + "IB", data, at)
            found = [one.unpack_from(data, at + 5 + k * one.size) for k in range(n)]
            inst = [(x[-1] + EPOCH_2000, x[0], x[1]) for x in found]
            return (inst, bool(ends & 1), bool(ends & 2), interp), at + 5 + n * one.size

        if subtype == 1:
            x = one.unpack_from(data, at)
            return [([(x[-1] + EPOCH_2000, x[0], x[1])], True, True, "DISCRETE")]
        if subtype == 2:
            return [sequence(at)[0]]
        if subtype != 3:
            return None
        (n,), out, at = struct.unpack_from(order + "I", data, at), [], at + 4
        for _ in range(n):
            found, at = sequence(at)
            out.append(found)
        return out
    except (ValueError, struct.error, IndexError):
        return None


def _udf():
    return F.udf(decode, GEOM, useArrow=True)


def _trip_udf():
    return F.udf(decode_trip, SEQSET, useArrow=True)


def geometry_from_hexwkb(column):
    """The decoded geometry of a column of hexadecimal texts."""
    return _udf()(column)


def trip_from_hexwkb(column):
    """The sequences of a column of binary trips in hexadecimal."""
    return _trip_udf()(column)


def register(spark: SparkSession) -> None:
    spark.udf.register("geometry_from_hexwkb", _udf())
    spark.udf.register("trip_from_hexwkb", _trip_udf())
