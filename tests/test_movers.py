"""Pairs of movers: each pair in one cell, whatever the tiles and blocks, and nothing shuffled per pair."""

import random

import pytest
from pyspark.sql import functions as F

from tracewise.operators import distance as D
from tracewise.operators import movers
from tracewise.operators import restrict as R
from tracewise.plans import benchmark as _benchmark  # noqa: F401  registers its queries
from tracewise.plans.queries import QUERIES

from .conftest import SF

SCHEMA = "mo_id long, vehid long, t0 long, x0 double, y0 double, t1 long, x1 double, y1 double, upper_inc boolean"
NAMES = ["nearest_approach_distance", "nearest_approach_instant", "temporal_distance"]


def traces(n: int, seed: int):
    """Movers of very different durations and extents, on whole numbers (so that some only touch, at tile borders too)."""
    rng, rows = random.Random(seed), []
    for mo in range(n):
        t, x, y = rng.randrange(0, 60), float(rng.randrange(-20, 20)), float(rng.randrange(-20, 20))
        if mo % 9 == 0:
            rows.append((mo, mo, t, x, y, t, x, y, True))
            continue
        for _ in range(rng.choice((1, 3, 12))):
            u, p, q = t + rng.randrange(1, 12), x + rng.randrange(-9, 9), y + rng.randrange(-9, 9)
            rows.append((mo, mo, t, x, y, u, p, q, False))
            t, x, y = u, p, q
    return rows


@pytest.mark.parametrize("name", ["bench_06_close_trucks", "ever_intersects_mover", *NAMES, *(f"{n}_of_all" for n in NAMES)])
def test_pairs_are_not_shuffled(spark, name):
    plan = QUERIES[name](spark, SF)._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("simple"))
    assert [line for line in plan.splitlines() if "Exchange" in line and ("a_mo_id" in line or "b_mo_id" in line)] == []
    assert plan.count("SortMergeJoin") == 1 and plan.count("- Exchange ") == plan.count("REPARTITION_BY_NUM") == 2


@pytest.mark.parametrize("width, side", [(1, 3), (7, 5), (10, 1), (1000, 4)])
def test_distances_do_not_depend_on_tiles_and_blocks(spark, monkeypatch, width, side):
    rows = traces(40, 7)
    df = spark.createDataFrame(rows, SCHEMA)

    def of(width):
        found = D.approaches(df, df, "a.mo_id < b.mo_id", width=width)
        sums = F.count("*").alias("n"), F.min("dist").alias("d"), F.min(F.struct("dist", "us")).alias("u")
        return sorted(map(tuple, D.of_pairs(found, ("a_mo_id", "b_mo_id"), *sums).collect()))

    whole = of(10_000)  # one tile and one block
    monkeypatch.setattr(movers, "SIDE", side)
    assert of(width) == whole
    want = {}
    for a in rows:
        for b in rows:
            s, e = max(a[2], b[2]), min(a[5], b[5])
            if a[0] < b[0] and (s < e or s == e and (s < a[5] or a[8]) and (s < b[5] or b[8])):
                want[a[0], b[0]] = want.get((a[0], b[0]), 0) + 1
    assert {(r[0], r[1]): r[2] for r in whole} == want


@pytest.mark.parametrize("cell, side", [(1.0, 3), (6.0, 5), (64.0, 2)])
def test_crossings_against_brute_force(spark, monkeypatch, cell, side):
    left, right = traces(25, 1), traces(30, 2)

    def turn(s, px, py):
        v = (s[6] - s[3]) * (py - s[4]) - (s[7] - s[4]) * (px - s[3])
        return (v > 0) - (v < 0)

    def cross(a, b):
        boxes = all(min(a[i], a[i + 3]) <= max(b[i], b[i + 3]) and min(b[i], b[i + 3]) <= max(a[i], a[i + 3]) for i in (3, 4))
        return boxes and turn(a, b[3], b[4]) * turn(a, b[6], b[7]) <= 0 and turn(b, a[3], a[4]) * turn(b, a[6], a[7]) <= 0

    want = sorted({(a[0], b[0]) for a in left for b in right if a[1] != b[1] and cross(a, b)})
    monkeypatch.setattr(movers, "SIDE", side)
    got = R.ever_intersects_movers(*(spark.createDataFrame(x, SCHEMA) for x in (left, right)), "a.vehid <> b.vehid", cell)
    assert sorted(map(tuple, got.collect())) == want and want


def test_no_movers(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert D.nearest_distance(none, none).count() == 0 and R.ever_intersects_movers(none, none).count() == 0
