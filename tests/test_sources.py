import struct

import pytest
from pyspark.sql import functions as F

from tracewise.functions import sql
from tracewise.operators.partitioners import Grid
from tracewise.sources import tables, text, wkb
from tracewise.streaming import trips


def ev(spark, kernel, value):
    return spark.createDataFrame([(value,)], "v string").select(F.expr(kernel("v")).alias("r")).first()["r"]


def test_text_round_trip(spark):
    s = "[POINT(-75.5 0.0)@2022-06-27 00:00:10.000000+00, POINT(12.5 25.72)@2022-06-27 00:00:30.500000+00)"
    df = spark.createDataFrame([(s, f"{{{s}, [POINT(1.0 2.0)@2022-06-28 00:00:00.000000+00]}}")], "s string, ss string")
    out = df.select(F.expr(text.sequence("s")).alias("s"), F.expr(text.sequence_set("ss")).alias("ss"))
    row = out.select(F.expr(text.show_sequence("s")), F.expr(text.show_sequence_set("ss"))).first()
    assert tuple(row) == df.first()[:]


def test_malformed_text_is_null(spark):
    for kernel in (text.instant, text.sequence, text.span, text.box, text.geometry):
        assert ev(spark, kernel, "nonsense") is None and ev(spark, kernel, None) is None


def test_span_box_geometry(spark):
    s = ev(spark, text.span, "[2020-06-09 13:15:14+02, 2020-06-09 22:38:19+02)")
    assert s["hi"] - s["lo"] == (9 * 3600 + 23 * 60 + 5) * 1_000_000 and s["lo_inc"] and not s["hi_inc"]
    b = ev(spark, text.box, "STBOX XT(((1,2),(3,4)),[2022-01-01 00:00:00+00, 2022-01-01 00:00:01+00])")
    assert (b["xmin"], b["ymin"], b["xmax"], b["ymax"], b["tmax"] - b["tmin"]) == (1, 2, 3, 4, 1_000_000)
    assert ev(spark, text.box, "STBOX X((0,2),(3,4))")["xmin"] == 0  # zero counts as a bound
    g = ev(spark, text.geometry, "SRID=3857;POLYGON ((3 0, 8 0, 8 5, 3 0))")  # digits of the SRID stay in the numbers
    assert [tuple(e) for e in g["edges"]] == [(3, 0, 8, 0), (8, 0, 8, 5), (8, 5, 3, 0)]


def test_binary_geometries(spark):
    assert wkb.decode(wkb.encode_point(475999.5, 6621389.25, 3857)) == ("point", 475999.5, 6621389.25, None)
    ring = struct.pack("<BIII", 1, 3, 1, 4) + struct.pack("<8d", 0, 0, 2, 0, 2, 2, 0, 0)
    assert wkb.decode(ring.hex())[3] == [(0, 0, 2, 0), (2, 0, 2, 2), (2, 2, 0, 0)]
    assert wkb.decode("00zz") is None and wkb.decode(None) is None and wkb.decode(ring.hex()[:40]) is None
    df = spark.createDataFrame([(wkb.encode_point(1.0, 2.0),), (None,)], "h string").select(wkb.geometry_from_hexwkb("h").alias("g"))
    assert [r["g"] and r["g"]["x"] for r in df.collect()] == [1.0, None]


def test_loaders_with_and_without_grid(spark, tmp_path):
    (tmp_path / "i.csv").write_text("instantid,instant\n1,2020-06-01 21:44:49.709717+02\n2,2020-06-02 01:00:00+02\n")
    (tmp_path / "p.csv").write_text(f"pointid,posx,posy,geom\n1,,,{wkb.encode_point(3.0, 4.0, 3857)}\n")
    (tmp_path / "m.csv").write_text('municipalityid,name,geom\n7,A,"SRID=3857;POLYGON ((0 0, 4 0, 4 4, 0 0))"\n')
    (tmp_path / "d.csv").write_text('periodid,beginp,endp,period\n1,a,b,"[2020-06-01 00:00:00+00, 2020-06-02 00:00:00+00]"\n')
    i = tables.load_instants(spark, str(tmp_path / "i.csv"))
    assert {r["tileid"] for r in i.collect()} == {-1}
    points = i.select("us", F.lit(1.0).alias("x"), F.lit(2.0).alias("y")).union(i.selectExpr("us", "9.0D", "9.0D"))
    grid = Grid(2).grid(points)
    assert {r["tileid"] for r in tables.load_instants(spark, str(tmp_path / "i.csv"), grid).where("instantid = 1").collect()} == {0, 2, 4, 6}
    assert tables.load_points(spark, str(tmp_path / "p.csv"), grid).count() == 2
    assert tables.load_municipalities(spark, str(tmp_path / "m.csv"), grid).count() == 2
    assert tables.load_periods(spark, str(tmp_path / "d.csv"), grid).count() == 8


def test_writers(spark, tmp_path):
    df = spark.range(20).select("id", (F.col("id") % 3).alias("tileid"))
    tables.write_tiled(df, str(tmp_path / "t"))
    one = spark.read.parquet(str(tmp_path / "t")).where("tileid = 1")
    assert one.count() == 7 and len(one.inputFiles()) < 20
    tables.write_bucketed(df, "bucketed_a", 4)
    tables.write_bucketed(df, "bucketed_b", 4)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = spark.table("bucketed_a").join(spark.table("bucketed_b"), "tileid")
        assert "Exchange" not in joined._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_sql_functions(spark):
    names = sql.register(spark)
    assert len(names) >= 38
    a = "tgeompointseq_from_tpoint_list(array(named_struct('us', 10L, 'x', 0D, 'y', 0D), named_struct('us', 0L, 'x', 4D, 'y', 0D), named_struct('us', 10L, 'x', 9D, 'y', 9D)))"
    b = "tgeompointseq_from_instant_list(array(named_struct('us', 0L, 'x', 0D, 'y', 3D), named_struct('us', 10L, 'x', 4D, 'y', 3D)))"
    box = "bounds_as_box(1D, 2D, -1D, 1D, NULL, NULL, NULL, NULL)"
    got = spark.sql(
        f"SELECT num_instants({a}) n, trip_length({a}) l, tpoint_at({a}, 5L).x x, tpoint_at({a}, 10L) e, min_distance({a}, {b}) d, nearest_approach_instant({a}, {b}).us us, "
        f"ever_intersects({a}, {box}) i, ever_touches({a}, {box}) t, size(at_period({a}, tstzspan_from_values(2L, 4L))) p, tstzspan_from_values(4L, 4L) z, "
        f"contains_stbox_stbox(point_to_stbox({a}), {box}) c, spatial_values({a}, 'x') v, spatial_values({a}, 'z') w, tgeompointseq_from_tpoint_list(array()) nothing"
    ).first()
    assert (got.n, got.l, got.x, got.e, got.d, got.us, got.i, got.t, got.p, got.z, got.c) == (2, 4.0, 2.0, None, 3.0, 5, True, True, 1, None, False)
    assert got.v == [4.0, 0.0] and got.w is None and got.nothing is None
    geom = "geometry_from_wkt('POLYGON ((1 -1, 3 -1, 3 1, 1 1, 1 -1))')"
    at = spark.sql(f"SELECT at_geom({a}, {geom}) g, ever_intersects_geom({a}, {geom}) i, ever_intersects_geom({a}, geometry_from_wkt('POINT(2 0)')) p, min_distance_geom({a}, geometry_from_wkt('POINT(2 3)')) d").first()
    assert [(i.us, i.x) for z in at.g for i in z.inst] == [(3, 3.0), (8, 1.0)] and (at.i, at.p, at.d) == (True, True, 3.0)
    plan = spark.sql("SELECT trip_length(t) FROM (SELECT named_struct('inst', array(named_struct('us', id, 'x', 1D, 'y', 2D)), 'lower_inc', true, 'upper_inc', true, 'interp', 'LINEAR') t FROM range(9))")._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan


def test_streamed_sessions_equal_batch(spark, tmp_path):
    rows = [(1, f"2024-01-01 00:{m:02d}:00", float(m), 0.0) for m in (0, 5, 30, 34)] + [(2, "2024-01-01 00:10:00", 1.0, 1.0), (9, "2024-01-09 00:00:00", 0.0, 0.0)]
    df = spark.createDataFrame(rows, "vehid long, t string, x double, y double").select("vehid", F.to_timestamp("t").alias("ts"), "x", "y")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    batch = {tuple(r) for r in trips.sessions(df, "10 minutes").collect()}
    assert len(batch) == 4
    stream = trips.sessions(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")), "10 minutes", "1 hour")
    q = stream.writeStream.format("memory").queryName("closed").outputMode("append").option("checkpointLocation", str(tmp_path / "ck")).start()
    q.processAllAvailable()
    q.stop()
    assert {tuple(r) for r in spark.table("closed").collect()} == {r for r in batch if r[0] != 9}  # the last is still open


@pytest.mark.parametrize("n", [1])
def test_windowed_counts(spark, n):
    df = spark.createDataFrame([(1, "2024-01-01 00:10:00"), (2, "2024-01-01 00:20:00"), (1, "2024-01-01 01:20:00")], "vehid long, t string").select("vehid", F.to_timestamp("t").alias("ts"))
    assert sorted(r["n"] for r in trips.windowed_counts(df).collect()) == [1, 2]


def binary_trip(sequences, interp=3, srid=None, z=False, subtype=3):
    """A trip in binary, written independently of the reader."""
    flags = subtype | interp << 2 | (0x10 if z else 0) | (0x40 if srid is not None else 0)
    out = struct.pack("<BHB", 1, 46, flags) + (struct.pack("<i", srid) if srid is not None else b"")
    out += struct.pack("<I", len(sequences)) if subtype == 3 else b""
    for inst, ends in sequences:
        out += struct.pack("<IB", len(inst), ends)
        for us, x, y in inst:
            out += struct.pack("<2d", x, y) + (struct.pack("<d", 7.0) if z else b"") + struct.pack("<q", us - 946_684_800_000_000)
    return out.hex().upper()


def test_binary_trips():
    one, two = [(1_700_000_000_000_000, 1.0, 2.0), (1_700_000_060_000_000, 3.0, 4.5)], [(1_700_000_900_000_000, 0.0, 0.0)]
    want = [(one, True, False, "LINEAR"), (two, True, True, "LINEAR")]
    for srid in (None, 3857):
        for z in (False, True):
            assert wkb.decode_trip(binary_trip([(one, 1), (two, 3)], srid=srid, z=z)) == want
            assert wkb.decode_trip(binary_trip([(one, 1)], srid=srid, z=z, subtype=2)) == want[:1]
    assert [wkb.decode_trip(x) for x in (None, "", "zz", "01", "012E000F02000000")] == [None] * 5


def test_load_all_registers_views_and_tiles_trips(spark, tmp_path):
    (tmp_path / "trips.csv").write_text("tripid,vehid,day,seqno,sourcenode,targetnode,trip,trajectory,licence\n" + f"1,5,2024-01-01,1,7,8,{binary_trip([([(0, 0.0, 0.0), (10, 10.0, 0.0)], 3)])},,L-5\n2,6,,,,,broken,,\n")
    (tmp_path / "vehicles.csv").write_text("vehid,licence,type,model\n5,L-5,truck,M\n")
    paths = {n: str(tmp_path / f"{n}.csv") for n in ("trips", "vehicles")}
    whole = tables.load_all(spark, paths)
    assert set(whole) == {"trips", "vehicles", "querylicences1", "querylicences2"}
    assert [(r["movingobjectid"], r["tileid"], r["n"]) for r in spark.sql("SELECT movingobjectid, tileid, size(movingobject) n FROM trips ORDER BY 1").collect()] == [(1, -1, 1), (2, -1, None)]
    grid = spark.createDataFrame([(0, 0.0, 4.0, -1.0, 1.0, 0, 10), (1, 4.0, 10.0, -1.0, 1.0, 0, 10)], "tileid long, xmin double, xmax double, ymin double, ymax double, tmin long, tmax long")
    rows = tables.load_trips(spark, paths["trips"], grid).orderBy("tileid").collect()
    assert [(r["tileid"], r["licence"], [(i["us"], i["x"]) for i in r["movingobject"][0]["inst"]]) for r in rows] == [(0, "L-5", [(0, 0.0), (4, 4.0)]), (1, "L-5", [(4, 4.0), (10, 10.0)])]
    for df in whole.values():
        df.unpersist()
