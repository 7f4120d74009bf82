"""Kernels against plain Python on random segments."""

import math
import random

import duckdb
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tracewise.functions import kernels as K
from tracewise.operators import distance as D
from tracewise.operators import restrict as R
from tracewise.operators import tiling
from tracewise.operators import trajectory as T
from tracewise.operators.partitioners import AdaptiveBins, BisectingKMeans, Grid, KdTree

S = 1_000_000


def one(sql, **cols):
    """Value of a kernel in an engine of plain arithmetic."""
    con = duckdb.connect()
    row = ", ".join(f"CAST({v!r} AS {'BIGINT' if isinstance(v, int) and not isinstance(v, bool) else 'BOOLEAN' if isinstance(v, bool) else 'DOUBLE'}) AS {k}" for k, v in cols.items())
    return con.execute(f"SELECT {sql} FROM (SELECT {row})").fetchone()[0]


coord = st.integers(-20, 20).map(float)


@settings(max_examples=60, deadline=None)
@given(coord, coord, coord, coord, coord, coord)
def test_point_distance(x0, y0, x1, y1, px, py):
    got = one(K.point_distance("px", "py"), x0=x0, y0=y0, x1=x1, y1=y1, px=px, py=py)
    steps = [(x0 + (x1 - x0) * i / 2000, y0 + (y1 - y0) * i / 2000) for i in range(2001)]
    want = min(math.hypot(px - x, py - y) for x, y in steps)
    assert got <= want + 1e-9 and got >= want - 0.02


@settings(max_examples=60, deadline=None)
@given(coord, coord, coord, coord, coord, coord, st.integers(0, 10), st.integers(0, 10))
def test_clip_stays_in_box_and_is_maximal(x0, y0, x1, y1, xmin, ymin, w, h):
    lo, hi = K.clip("xy")
    cols = dict(x0=x0, y0=y0, x1=x1, y1=y1, xmin=xmin, xmax=xmin + w, ymin=ymin, ymax=ymin + h)
    a, b = one(lo, **cols), one(hi, **cols)
    for i in range(101):
        lam = i / 100
        x, y = x0 + (x1 - x0) * lam, y0 + (y1 - y0) * lam
        if a + 1e-9 < lam < b - 1e-9:
            assert xmin - 1e-6 <= x <= xmin + w + 1e-6 and ymin - 1e-6 <= y <= ymin + h + 1e-6
        elif a <= b and not a - 1e-9 <= lam <= b + 1e-9:
            assert not (xmin + 1e-6 < x < xmin + w - 1e-6 and ymin + 1e-6 < y < ymin + h - 1e-6)


def seg(t0, x0, y0, t1, x1, y1, upper=False, mo=1, veh=1):
    return (mo, veh, t0, float(x0), float(y0), t1, float(x1), float(y1), upper)


SCHEMA = "mo_id long, vehid long, t0 long, x0 double, y0 double, t1 long, x1 double, y1 double, upper_inc boolean"


def test_nearest_approach_matches_sampling_and_is_symmetric(spark):
    rng = random.Random(5)
    rows = []
    for mo in range(1, 9):
        t = rng.randrange(0, 50)
        for _ in range(4):
            n = t + rng.randrange(1, 40)
            rows.append(seg(t * S, rng.uniform(0, 9), rng.uniform(0, 9), n * S, rng.uniform(0, 9), rng.uniform(0, 9), mo=mo, veh=mo))
            t = n
    df = spark.createDataFrame(rows, SCHEMA)
    got = {(r["a_mo_id"], r["b_mo_id"]): r["nad"] for r in D.nearest_approach(df, df, "a.mo_id <> b.mo_id").collect()}

    def at(r, t):
        f = (t - r[2]) / (r[5] - r[2])
        return r[3] + (r[6] - r[3]) * f, r[4] + (r[7] - r[4]) * f

    want = {}
    for a in rows:
        for b in rows:
            s, e = max(a[2], b[2]), min(a[5], b[5])
            if a[0] != b[0] and s < e:
                d = min(math.dist(at(a, s + (e - s) * i / 500), at(b, s + (e - s) * i / 500)) for i in range(501))
                want[a[0], b[0]] = min(want.get((a[0], b[0]), math.inf), d)
    assert set(got) == set(want)
    for k, d in want.items():
        assert d - 0.05 <= got[k] <= d + 1e-9
        assert got[k] == pytest.approx(got[k[1], k[0]], abs=1e-9)


def test_clip_at_time_border_gives_one_instant_in_common(spark):
    """Tiles are closed: both hold the border instant; the exclusive end stays exclusive."""
    s = spark.createDataFrame([seg(0, 8.388679504394531, 47.56517028808594, 10 * S, 8.3642578125, 47.57606118412341)], SCHEMA)
    grid = spark.createDataFrame([(2, 0, 5 * S), (3, 5 * S, 10 * S)], "tileid long, tmin long, tmax long")
    rows = {r["tileid"]: r for r in tiling.tile_segments(s, grid, "t").collect()}
    assert (rows[2]["x1"], rows[2]["y1"], rows[2]["t1"], rows[2]["upper_inc"]) == (8.376468658447266, pytest.approx(47.57061573610467, abs=1e-12), 5 * S, True)
    assert (rows[3]["x0"], rows[3]["t0"], rows[3]["upper_inc"]) == (8.376468658447266, 5 * S, False)


def test_exclusive_end_is_nowhere(spark):
    s = spark.createDataFrame([seg(0, 0, 0, 10, 10, 0), seg(20, 5, 5, 20, 5, 5, True, mo=2)], SCHEMA)
    at = spark.createDataFrame([(1, 0), (2, 5), (3, 10), (4, 20)], "instantid long, us long")
    assert {(r["mo_id"], r["instantid"], r["x"]) for r in R.positions_at(s, at).collect()} == {(1, 1, 0.0), (1, 2, 5.0), (2, 4, 5.0)}


def test_polygon_share(spark):
    box = [(0, 0, 4, 0), (4, 0, 4, 4), (4, 4, 0, 4), (0, 4, 0, 0)]
    p = spark.createDataFrame([(1, [tuple(map(float, e)) for e in box])], "regionid long, edges array<struct<ax:double,ay:double,bx:double,by:double>>")
    s = spark.createDataFrame([seg(0, -4, 2, 8, 4, 2), seg(0, 9, 9, 8, 12, 9, mo=2), seg(0, 1, 1, 8, 3, 3, mo=3)], SCHEMA)
    assert {r["mo_id"]: r["share"] for r in R.in_polygons(s, p, "regionid").collect()} == {1: 0.5, 3: 1.0}


@pytest.fixture(scope="module")
def points(spark):
    rng = random.Random(9)
    rows = [(v * 10, i * 1000 + v, v, rng.uniform(0, 100), float(rng.randrange(40)), v * 1000 + i) for v in range(1, 8) for i in range(60)]
    rows += [(999, i, 99, 50.0, 50.0, 90_000 + i) for i in range(400)]  # one key with half of the rows, in one place
    return spark.createDataFrame(rows, "mo_id long, us long, vehid long, x double, y double, event_id long").cache()


def test_bucketed_segments_equal_plain(points):
    plain = sorted(map(tuple, T.to_segments(points).collect()))
    assert sorted(map(tuple, T.to_segments(points, bucket_us=97).collect())) == plain
    assert sorted(map(tuple, T.sequences_to_segments(T.to_sequences(points)).select(*T.to_segments(points).columns).collect())) == plain


def test_first_of_repeated_times_stays(spark):
    df = spark.createDataFrame([(1, 5, 2, 7), (1, 5, 1, 8), (1, 6, 3, 9)], "mo_id long, us long, event_id long, x long")
    assert sorted(map(tuple, T.dedup_points(df, keep=("x",)).collect())) == [(1, 5, 8), (1, 6, 9)]


@pytest.mark.parametrize("maker", [Grid(3), KdTree(4), AdaptiveBins(3), AdaptiveBins(3, exact=False)])
def test_tiles_cover_points_and_lengths_add_up(points, maker):
    grid = maker.grid(points).cache()
    placed = tiling.tile_of_points(points, grid)
    assert placed.count() == points.count()
    assert placed.where("tileid = -1").count() == 0
    if not isinstance(maker, AdaptiveBins):  # bins may be of no width, and then share their border
        whole = T.lengths(T.to_segments(points)).agg(F.sum("length")).first()[0]
        pieces = tiling.tile_segments(T.to_segments(points), grid)
        got = pieces.agg(F.sum(F.expr(K.length()))).first()[0]
        assert got == pytest.approx(whole, rel=0.03) and got >= whole - 1e-6


def test_kd_leaves_are_balanced_and_deterministic(points):
    counts = [r["count"] for r in KdTree(4).leaves(points).groupBy("node").count().collect()]
    assert sum(counts) == points.count() and max(counts) - min(counts) <= 1
    a = sorted((r["event_id"], r["node"]) for r in KdTree(3).leaves(points).collect())
    assert a == sorted((r["event_id"], r["node"]) for r in KdTree(3).leaves(points.repartition(7)).collect())


def test_kmeans_tiles(points):
    assert 1 < BisectingKMeans(4).grid(points).count() <= 4


def test_results_do_not_depend_on_tiles(points):
    s = T.to_segments(points)
    at = points.select(F.col("event_id").alias("instantid"), "us").where("event_id % 50 = 0").cache()
    direct = {tuple(r) for r in R.positions_at(s, at).select("mo_id", "instantid").collect()}
    for maker in (Grid(2), KdTree(3), AdaptiveBins(2)):
        grid = maker.grid(points)
        tiled = tiling.tile_segments(s, grid).drop("tileid")
        assert {tuple(r) for r in R.positions_at(tiled, at).select("mo_id", "instantid").distinct().collect()} == direct


def test_empty_tables(spark):
    none = spark.createDataFrame([], "mo_id long, us long, vehid long, x double, y double, event_id long")
    s = T.to_segments(none, 10)
    assert s.count() == 0 and KdTree(2).leaves(none).count() == 0
    assert D.nearest_approach(s, s).count() == 0


def test_box_distance_and_touch_against_dense_sampling(spark):
    """Independent of the kernels: many points along each segment, plain distance to the rectangle."""
    import numpy as np
    from pyspark.sql import functions as F

    from tracewise.functions import kernels as K
    from tracewise.operators import restrict as R

    rng = np.random.default_rng(12)
    ends, boxes = rng.uniform(-10, 10, (120, 4)), [(1, -3.0, 2.0, -1.0, 4.0), (2, 5.0, 6.0, 5.0, 6.0)]
    segs = spark.createDataFrame([(i, i, 0, *map(float, e[:2]), 10, *map(float, e[2:]), True) for i, e in enumerate(ends)], "mo_id long, vehid long, t0 long, x0 double, y0 double, t1 long, x1 double, y1 double, upper_inc boolean")
    rect = spark.createDataFrame(boxes, "regionid long, xmin double, xmax double, ymin double, ymax double")
    got = {(r["mo_id"], r["regionid"]): r["d"] for r in segs.crossJoin(rect).select("mo_id", "regionid", F.expr(K.box_distance()).alias("d")).collect()}
    lam = np.linspace(0, 1, 4001)[:, None]
    meets, touches = set(), set()
    for i, e in enumerate(ends):
        p = e[:2] + (e[2:] - e[:2]) * lam
        for b, x0, x1, y0, y1 in boxes:
            gap = np.hypot(np.maximum(0, np.maximum(x0 - p[:, 0], p[:, 0] - x1)), np.maximum(0, np.maximum(y0 - p[:, 1], p[:, 1] - y1)))
            assert abs(gap.min() - got[(i, b)]) < 0.02, (i, b)
            inside = gap == 0
            if inside.any():
                meets.add((i, b))
                if not inside.all():
                    touches.add((i, b))
    assert {(r["mo_id"], r["regionid"]) for r in R.ever_intersects_boxes(segs, rect, "regionid").collect()} >= meets
    assert {(r["mo_id"], r["regionid"]) for r in R.ever_touches_boxes(segs, rect, "regionid").collect()} >= touches
    assert all(got[k] == 0 for k in meets) and sum(v == 0 for v in got.values()) <= len(meets) + 3


def test_piece_of_a_period_keeps_the_end_of_its_sequence(spark):
    """An end within the segment is in; the segment's own end is in only if the sequence's is (SQL and operator alike)."""
    from tracewise.plans.benchmark import _PIECES

    rows = [seg(0, 0, 0, 10 * S, 10, 0, mo=1), seg(0, 0, 0, 10 * S, 10, 0, True, mo=2)]
    periods = [(0, 0, 20 * S), (1, 2 * S, 10 * S), (2, 2 * S, 5 * S), (3, 10 * S, 20 * S)]
    found = R.at_periods(spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(periods, "periodid long, tmin long, tmax long"))
    got = {(r.mo_id, r.periodid): (r.t0 // S, r.t1 // S, r.x1, r.upper_inc) for r in found.collect()}
    assert got == {
        (1, 0): (0, 10, 10.0, False), (1, 1): (2, 10, 10.0, False), (1, 2): (2, 5, 5.0, True),
        (2, 0): (0, 10, 10.0, True), (2, 1): (2, 10, 10.0, True), (2, 2): (2, 5, 5.0, True), (2, 3): (10, 10, 10.0, True),
    }
    con = duckdb.connect()
    con.execute("CREATE TABLE segs (mo_id BIGINT, vehid BIGINT, t0 BIGINT, x0 DOUBLE, y0 DOUBLE, t1 BIGINT, x1 DOUBLE, y1 DOUBLE, upper_inc BOOLEAN)")
    con.executemany("INSERT INTO segs VALUES (?, ?, ?, ?, ?, ?, ?, ?, ?)", rows)
    con.execute("CREATE TABLE periods (periodid BIGINT, tmin BIGINT, tmax BIGINT)")
    con.executemany("INSERT INTO periods VALUES (?, ?, ?)", periods)
    assert {(m, p): (x, inc) for m, p, x, inc in con.execute(f"SELECT mo_id, periodid, x1, upper_inc FROM ({_PIECES})").fetchall()} == {k: v[2:] for k, v in got.items()}
