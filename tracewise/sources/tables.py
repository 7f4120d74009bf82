"""Readers and writers of the tracking tables.

Each reader takes a CSV path and an optional grid; without one, ``tileid`` is
-1, so queries run with and without tiles.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import tiling
from ..operators import trajectory as T
from . import text, wkb

SCHEMAS = {
    "instants": "instantid long, instant string",
    "periods": "periodid long, beginp string, endp string, period string",
    "points": "pointid long, posx double, posy double, geom string",
    "regions": "regionid long, geom string",
    "municipalities": "municipalityid long, name string, geom string",
    "licences": "licenceid long, licence string, vehid long",
    "vehicles": "vehid long, licence string, type string, model string",
    "trips": "vehid long, tripid long, seqno long, point string, t string",
    "binary_trips": "tripid long, vehid long, day string, seqno long, sourcenode long, targetnode long, trip string, trajectory string, licence string",
}


def read_csv(spark: SparkSession, path: str, name: str) -> DataFrame:
    """A table with its declared columns; malformed fields are null."""
    return spark.read.csv(path, schema=SCHEMAS[name], header=True, mode="PERMISSIVE")


def _tiled(df: DataFrame, grid: DataFrame | None, axes: str, columns: dict) -> DataFrame:
    return df.withColumn("tileid", F.lit(-1).cast("long")) if grid is None else tiling.tile(df, grid, axes, columns)


def load_instants(spark: SparkSession, path: str, grid: DataFrame | None = None) -> DataFrame:
    df = read_csv(spark, path, "instants").select("instantid", F.expr(text.micros("instant")).alias("us"))
    return _tiled(df, grid, "t", {"t": ("us", "us")})


def load_periods(spark: SparkSession, path: str, grid: DataFrame | None = None) -> DataFrame:
    df = read_csv(spark, path, "periods").select("periodid", F.expr(text.span("period")).alias("period"))
    df = df.select("periodid", "period", F.col("period.lo").alias("beginp"), F.col("period.hi").alias("endp"))
    return _tiled(df, grid, "t", {"t": ("beginp", "endp")})


def _boxed(df: DataFrame) -> DataFrame:
    one = {f"g{a}{f}": F.coalesce(F.expr(f"array_{f}(geom.edges.a{a})"), F.col(f"geom.{a}")) for a in "xy" for f in ("min", "max")}
    return df.withColumns(one)


def _load_places(df: DataFrame, grid: DataFrame | None) -> DataFrame:
    sides = {a: (f"g{a}min", f"g{a}max") for a in "xy"}
    return _tiled(_boxed(df), grid, "xy", sides).drop(*(c for s in sides.values() for c in s))


def load_points(spark: SparkSession, path: str, grid: DataFrame | None = None) -> DataFrame:
    df = read_csv(spark, path, "points").withColumn("geom", wkb.geometry_from_hexwkb("geom"))
    return _load_places(df.select("pointid", F.col("geom.x").alias("x"), F.col("geom.y").alias("y"), "geom"), grid)


def load_regions(spark: SparkSession, path: str, grid: DataFrame | None = None) -> DataFrame:
    return _load_places(read_csv(spark, path, "regions").withColumn("geom", wkb.geometry_from_hexwkb("geom")), grid)


def load_municipalities(spark: SparkSession, path: str, grid: DataFrame | None = None) -> DataFrame:
    return _load_places(read_csv(spark, path, "municipalities").withColumn("geom", F.expr(text.geometry("geom"))), grid)


def load_trip_points(spark: SparkSession, path: str) -> DataFrame:
    """Points of trips at whole seconds, as :func:`tracewise.operators.trajectory.dedup_points` takes them."""
    df = read_csv(spark, path, "trips").withColumn("geom", wkb.geometry_from_hexwkb("point"))
    us = F.expr(f"{text.micros('t')} div 1000000 * 1000000")
    return df.select(F.concat_ws("-", "vehid", "tripid", "seqno").alias("mo_id"), "vehid", us.alias("us"), F.col("geom.x").alias("x"), F.col("geom.y").alias("y"), F.expr(text.micros("t")).alias("event_id"))


def load_licences(spark: SparkSession, path: str, grid: DataFrame | None = None) -> DataFrame:
    return read_csv(spark, path, "licences")


def load_vehicles(spark: SparkSession, path: str, grid: DataFrame | None = None) -> DataFrame:
    return read_csv(spark, path, "vehicles")


_PIECE = "named_struct('inst', array(named_struct('us', s.t0, 'x', s.x0, 'y', s.y0), named_struct('us', s.t1, 'x', s.x1, 'y', s.y1)), 'lower_inc', true, 'upper_inc', s.upper_inc, 'interp', 'LINEAR')"


def load_trips(spark: SparkSession, path: str, grid: DataFrame | None = None) -> DataFrame:
    """Whole trips from binary; with a grid, a row for each tile that a trip meets, with its pieces there."""
    df = read_csv(spark, path, "binary_trips").select(
        F.col("tripid").alias("movingobjectid"), "vehid", "day", "seqno", "sourcenode", "targetnode", wkb.geometry_from_hexwkb("trajectory").alias("trajectory"), "licence", wkb.trip_from_hexwkb("trip").alias("movingobject")
    )
    if grid is None:
        return df.withColumn("tileid", F.lit(-1).cast("long"))
    segments = T.sequences_to_segments(df.select(F.col("movingobjectid").alias("mo_id"), "vehid", F.explode("movingobject").alias("trip")))
    pieces = tiling.tile_segments(segments, grid).groupBy(F.col("mo_id").alias("movingobjectid"), "tileid").agg(F.array_sort(F.collect_list(F.struct("t0", "x0", "y0", "t1", "x1", "y1", "upper_inc"))).alias("_s"))
    pieces = pieces.select("movingobjectid", "tileid", F.expr(f"transform(_s, s -> {_PIECE})").alias("movingobject"))
    return df.drop("movingobject").join(pieces, "movingobjectid")


LOADERS = {"trips": load_trips, "instants": load_instants, "periods": load_periods, "points": load_points, "regions": load_regions, "municipalities": load_municipalities, "licences": load_licences, "vehicles": load_vehicles}


def load_all(spark: SparkSession, paths: dict[str, str], grid: DataFrame | None = None, sample: float = 0.01) -> dict[str, DataFrame]:
    """The tables of ``paths`` (name to CSV), cached as needed and registered as views by their names.

    If there are vehicles, two samples of them are registered as
    ``querylicences1`` and ``querylicences2``.
    """
    out = {name: LOADERS[name](spark, path, grid) for name, path in paths.items()}
    if "vehicles" in out:
        out |= {f"querylicences{k}": out["vehicles"].sample(fraction=sample, seed=seed) for k, seed in ((1, 3), (2, 7))}
    for name, df in out.items():
        df.cache().createOrReplaceTempView(name)
    return out


def write_tiled(df: DataFrame, path: str, format: str = "parquet") -> None:
    """A folder for each tile; a filter on tileid then reads only its folders."""
    df.write.mode("overwrite").partitionBy("tileid").format(format).save(path)


def write_bucketed(df: DataFrame, name: str, buckets: int, key: str = "tileid") -> None:
    """A table in buckets of ``key``: tables with as many buckets join on it without a shuffle."""
    df.write.mode("overwrite").bucketBy(buckets, key).sortBy(key).format("parquet").saveAsTable(name)
