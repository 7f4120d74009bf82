"""A vehicle-tracking world from the event table: points, trips, vehicles and the query tables.

Every table is made twice: as DataFrames, and as SQL text (:data:`SQL`) that
an independent engine runs for comparison.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import trajectory as T
from ..shared import materialize, table

DAY = 86_400_000_000
TRIP_DAYS = 6
#: Numbers of trips that each vehicle has room for (over 16,000 years).
TRIPS = 1_000_000
#: The stated query tables (the benchmark's parameters).
REGIONS = ((1, 0.0, 50.0, 0.0, 30.0), (2, 20.0, 120.0, 10.0, 60.0), (3, 100.0, 490.0, 40.0, 99.0), (4, 5.0, 15.0, 5.0, 15.0))
POLYGONS = (
    (1, ((0.0, 0.0), (60.0, 10.0), (30.0, 70.0))),
    (2, ((10.0, 10.0), (120.0, 10.0), (120.0, 80.0), (60.0, 30.0), (10.0, 80.0))),
    (3, ((200.0, 5.0), (300.0, 50.0), (200.0, 95.0), (100.0, 50.0))),
)
PERIODS = tuple((i, i * 5 * DAY + 3_600_000_000, i * 5 * DAY + 2 * DAY) for i in range(6))
INSTANTS = tuple((i, i * 3 * DAY + 12_345_678_901) for i in range(1, 9))
LICENCES1 = tuple(f"L-{i}" for i in range(1, 11))
LICENCES2 = tuple(f"L-{i}" for i in range(6, 21))
PLACES = ((1, 10.0, 10.0), (2, 55.5, 20.25), (3, 250.0, 50.0))


def edges(corners) -> list[tuple[float, float, float, float]]:
    return [(*a, *b) for a, b in zip(corners, (*corners[1:], corners[0]))]


@dataclass
class World:
    """The DataFrames of one data folder."""

    spark: SparkSession
    sf_dir: str

    @cached_property
    def raw(self) -> DataFrame:
        return table(self.spark, self.sf_dir, "events").selectExpr(
            "event_id", "user_id AS vehid", "timestampdiff(MICROSECOND, TIMESTAMP_NTZ'2024-01-01 00:00:00', ts) AS us",
            "value AS x", "CAST(regexp_extract(props, '([0-9]+)', 1) AS DOUBLE) AS y",
        ).withColumn("mo_id", F.expr(f"vehid * {TRIPS} + floor(us / {TRIP_DAYS * DAY})"))

    @cached_property
    def points(self) -> DataFrame:
        """Written once: several tables of a query are made from it."""
        return materialize(T.dedup_points(self.raw, keep=("vehid", "x", "y", "event_id")), "points")

    @cached_property
    def segments(self) -> DataFrame:
        return T.to_segments(self.points, bucket_us=DAY)

    @cached_property
    def trips(self) -> DataFrame:
        return T.to_sequences(self.points)

    @cached_property
    def vehicles(self) -> DataFrame:
        return self.raw.select("vehid").distinct().selectExpr(
            "vehid", "concat('L-', CAST(vehid AS STRING)) AS licence",
            "CASE WHEN vehid % 10 = 0 THEN 'truck' WHEN vehid % 10 = 1 THEN 'bus' ELSE 'passenger' END AS type", "concat('M-', CAST(vehid % 12 AS STRING)) AS model",
        )

    def _rows(self, rows, schema: str) -> DataFrame:
        return self.spark.createDataFrame(list(rows), schema)

    @cached_property
    def instants(self) -> DataFrame:
        """The stated instants, and the time of each day's first event (so that some fall on recorded points)."""
        days = self.raw.groupBy(F.expr(f"CAST(floor(us / {DAY}) AS BIGINT) + 100 AS instantid")).agg(F.min("us").alias("us"))
        return self._rows(INSTANTS, "instantid long, us long").union(days)

    @cached_property
    def periods(self) -> DataFrame:
        return self._rows(PERIODS, "periodid long, tmin long, tmax long")

    @cached_property
    def regions(self) -> DataFrame:
        return self._rows(REGIONS, "regionid long, xmin double, xmax double, ymin double, ymax double")

    @cached_property
    def polygons(self) -> DataFrame:
        return self._rows([(i, edges(c)) for i, c in POLYGONS], "regionid long, edges array<struct<ax:double,ay:double,bx:double,by:double>>")

    @cached_property
    def query_points(self) -> DataFrame:
        """The first recorded place of each vehicle."""
        return self.points.groupBy("vehid").agg(F.min(F.struct("us", "x", "y")).alias("f")).select(F.col("vehid").alias("pointid"), "f.x", "f.y")

    @cached_property
    def places(self) -> DataFrame:
        return self._rows(PLACES, "pointid long, px double, py double")

    @cached_property
    def licences1(self) -> DataFrame:
        return self._rows([(x,) for x in LICENCES1], "licence string")

    @cached_property
    def licences2(self) -> DataFrame:
        return self._rows([(x,) for x in LICENCES2], "licence string")


def _values(rows) -> str:
    def lit(v) -> str:
        return "'" + v + "'" if isinstance(v, str) else f"CAST({v!r} AS DOUBLE)" if isinstance(v, float) else f"CAST({v} AS BIGINT)"

    return ", ".join("(" + ", ".join(lit(v) for v in r) + ")" for r in rows)


_EDGES = "UNION ALL ".join(
    f"SELECT CAST({i} AS BIGINT) AS regionid, [" + ", ".join(f"{{'ax': CAST({a!r} AS DOUBLE), 'ay': CAST({b!r} AS DOUBLE), 'bx': CAST({c!r} AS DOUBLE), 'by': CAST({d!r} AS DOUBLE)}}" for a, b, c, d in edges(p)) + "] AS edges "
    for i, p in POLYGONS
)

#: Common table expressions; a query follows after ``WITH ...``.
SQL = f"""WITH raw AS (SELECT event_id, user_id AS vehid, epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01') AS us, value AS x, CAST(regexp_extract(props, '([0-9]+)', 1) AS DOUBLE) AS y FROM events),
pts AS (SELECT vehid * {TRIPS} + us // {TRIP_DAYS * DAY} AS mo_id, us, vehid, x, y, event_id FROM (SELECT *, row_number() OVER (PARTITION BY vehid, us ORDER BY event_id) AS rn FROM raw) WHERE rn = 1),
segs AS (SELECT mo_id, vehid, us AS t0, x AS x0, y AS y0, coalesce(nt, us) AS t1, coalesce(nx, x) AS x1, coalesce(ny, y) AS y1, n = 1 AS upper_inc FROM (
    SELECT *, lead(us) OVER w AS nt, lead(x) OVER w AS nx, lead(y) OVER w AS ny, count(*) OVER (PARTITION BY mo_id) AS n FROM pts WINDOW w AS (PARTITION BY mo_id ORDER BY us)) WHERE nt IS NOT NULL OR n = 1),
vehicles AS (SELECT DISTINCT vehid, 'L-' || CAST(vehid AS VARCHAR) AS licence, CASE WHEN vehid % 10 = 0 THEN 'truck' WHEN vehid % 10 = 1 THEN 'bus' ELSE 'passenger' END AS type, 'M-' || CAST(vehid % 12 AS VARCHAR) AS model FROM raw),
instants AS (SELECT * FROM (VALUES {_values(INSTANTS)}) v(instantid, us) UNION ALL SELECT CAST(us // {DAY} + 100 AS BIGINT), min(us) FROM raw GROUP BY 1),
periods AS (SELECT * FROM (VALUES {_values(PERIODS)}) v(periodid, tmin, tmax)),
regions AS (SELECT * FROM (VALUES {_values(REGIONS)}) v(regionid, xmin, xmax, ymin, ymax)),
polygons AS ({_EDGES}),
qpts AS (SELECT vehid AS pointid, x, y FROM (SELECT *, row_number() OVER (PARTITION BY vehid ORDER BY us) AS rn FROM pts) WHERE rn = 1),
places AS (SELECT * FROM (VALUES {_values(PLACES)}) v(pointid, px, py)),
ql1 AS (SELECT * FROM (VALUES {_values((x,) for x in LICENCES1)}) v(licence)),
ql2 AS (SELECT * FROM (VALUES {_values((x,) for x in LICENCES2)}) v(licence)),
ext AS (SELECT min(x) AS xmin, max(x) AS xmax, min(y) AS ymin, max(y) AS ymax, min(us) AS tmin, max(us) AS tmax FROM pts)
"""
