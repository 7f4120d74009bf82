"""Pairs of movers in packed blocks: as the row by row joins, as the SQL on odd values, and no work by rows or pairs in Spark."""

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tracewise.operators import distance as D
from tracewise.operators import movers
from tracewise.operators import restrict as R
from tracewise.operators import traces as arrays
from tracewise.plans.queries import ORACLES, QUERIES
from tracewise.plans.world import TRIPS

from .conftest import SF
from .test_movers import SCHEMA, traces


def rounded(rows):
    return sorted(tuple(v if v is None else round(v, 9) if isinstance(v, float) else v for v in r) for r in rows)


@pytest.mark.parametrize("width, side", [(7, 60), (1000, 30), (10_000, 65_536)])
@pytest.mark.parametrize("both", [False, True])
def test_distances_of_blocks(spark, monkeypatch, width, side, both):
    df = spark.createDataFrame([(r[0], r[1] // 2, *r[2:]) for r in traces(40, 7)], SCHEMA)
    found = D.approaches(df, df, "a.vehid <> b.vehid" if both else "a.mo_id < b.mo_id", width=10_000)
    first = F.min(F.struct("dist", "us"))["us"]
    want = D.of_pairs(found, ("a_mo_id", "b_mo_id"), F.min("dist").alias("near"), first.alias("us"), F.count("*").alias("parts"), F.max(F.expr("sqrt(ax * ax + ay * ay)")).alias("most"))
    monkeypatch.setattr(movers, "MOST", side)
    got = D.of_all_pairs(df, ("near", "us", "parts", "most"), both, width)
    assert got.columns == want.columns
    assert rounded(got.collect()) == rounded(want.collect()) != []


@pytest.mark.parametrize("cell, side", [(6.0, 50), (64.0, 20), (1000.0, 65_536)])
def test_crossings_of_blocks(spark, monkeypatch, cell, side):
    left, right = (spark.createDataFrame(traces(n, n), SCHEMA) for n in (25, 30))
    want = R.ever_intersects_movers(left, right, "a.vehid <> b.vehid")
    monkeypatch.setattr(movers, "MOST", side)
    got = R.ever_intersects_vehicles(left, right, cell)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) != []


def test_crossings_do_not_depend_on_the_order_of_tests(monkeypatch):
    names = SCHEMA.replace(" long", "").replace(" double", "").replace(" boolean", "").split(", ")
    a, b = (arrays.Block({c: np.array(v) for c, v in zip([*names, "at"], zip(*((*r, 1) for r in sorted(traces(n, n)))))}) for n in (25, 60))
    keep = np.arange(60) % 7 > 0
    found = []
    for rest in (0, 30, 300, 10**6):
        monkeypatch.setattr(arrays, "REST", rest)
        found.append([sorted(arrays.crossing(a, m, b, keep)) for m in range(25)])
    assert found[0] == found[1] == found[2] == found[3] and any(found[0])


def odd_events(folder):
    """Vehicles with few and many points, two without a place at first, one with infinite and undefined places, standing ones."""
    rows = []
    for v in range(8):
        for i in range((1, 2, 5, 9, 14, 3, 4, 6)[v]):
            hours = (i * (7 + 5 * v) + v) % 290
            x = "NULL" if v in (0, 3) and i == 0 else ("'nan'::DOUBLE", "'inf'::DOUBLE", "4.5")[i % 3] if v == 5 else "12.25" if v == 6 else str((i * 37 + v * 11) % 100 / 4)
            rows.append(f"({len(rows)}, TIMESTAMP '2024-01-01' + INTERVAL {hours} HOUR, {v * 50}, {x}, '{{\"k\": {i * v % 9}}}')")
    duckdb.execute(f"COPY (SELECT CAST(a AS BIGINT) AS event_id, b AS ts, CAST(c AS BIGINT) AS user_id, 'view' AS event_type, CAST(d AS DOUBLE) AS value, e AS props FROM (VALUES {', '.join(rows)}) v(a, b, c, d, e)) TO '{folder}/events.parquet' (FORMAT parquet)")
    return str(folder)


BLOCKS = ["nearest_approach_instant_of_all", "nearest_approach_distance_of_all", "temporal_distance_of_all", "ever_intersects_mover", "nearest_approach_instant", "temporal_distance"]


@pytest.mark.parametrize("name", [n for n in BLOCKS if "instant" in n])
def test_odd_values_as_in_sql(spark, tmp_path, name):
    """Instants only: of a distance that isn't finite, Spark's rounding makes a number."""
    folder = odd_events(tmp_path)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM read_parquet('{folder}/events.parquet')")
    found = con.execute(ORACLES[name])
    df = QUERIES[name](spark, folder).select([d[0] for d in found.description])
    got, want = (sorted(map(repr, map(tuple, rows))) for rows in (df.collect(), found.fetchall()))
    assert got == want and want


@pytest.mark.parametrize("name", BLOCKS)
def test_spark_has_no_rows_of_segments_or_pairs(spark, name):
    plan = QUERIES[name](spark, SF)._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("simple"))
    assert "MapInArrow" in plan and "Aggregate" not in plan
    assert all("_segments" in line for line in plan.splitlines() if "FileScan" in line and "blocks-" in line)


def test_two_blocks_meet_once(spark, monkeypatch):
    monkeypatch.setattr(movers, "MOST", 10)
    df = spark.createDataFrame(traces(40, 7), SCHEMA)
    met = movers.meet_blocks(df, df, ("mo_id", "vehid", "t0", "t1"), {"t": 10_000.0}).select("same", "a", "b").collect()
    blocks = {frozenset(s.mo_id for s in r.a) for r in met} | {frozenset(s.mo_id for s in r.b) for r in met}
    assert len(blocks) > 3 and len(met) == len(blocks) * (len(blocks) + 1) // 2
    assert sum(r.same for r in met) == len(blocks) and sum(map(len, blocks)) == 40


@pytest.mark.parametrize("name", ["nearest_approach_instant", "temporal_distance"])
def test_all_vehicles_are_asked(spark, name):
    """Both ways, and as often as pairs of movers of different vehicles meet."""
    pairs = {tuple(r) for r in QUERIES[name](spark, SF).select("a_mo_id", "b_mo_id").collect()}
    met = {tuple(r) for r in QUERIES[f"{name}_of_all"](spark, SF).select("a_mo_id", "b_mo_id").collect()}
    assert pairs == {p for a, b in met if a // TRIPS != b // TRIPS for p in ((a, b), (b, a))}
    assert len({a // TRIPS for a, _ in pairs}) == 15
