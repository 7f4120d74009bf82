"""Every registered tracking query against its SQL in an independent engine."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry_module
from tracewise.plans.world import TRIPS
from tracewise.plans.queries import ORACLES, QUERIES

from .conftest import SF


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM read_parquet('{SF}/{f}')")
    return con


def clean(v):
    return None if isinstance(v, float) and math.isnan(v) else v


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, duck, name):
    df = QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted((tuple(clean(r[c]) for c in cols) for r in df.collect()), key=repr)
    found = duck.execute(ORACLES[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == cols
    want = sorted((tuple(clean(dict(zip(names, r))[c]) for c in cols) for r in found.fetchall()), key=repr)
    assert got == want


def test_queries_without_sql_give_rows(spark):
    for name in set(QUERIES) - set(ORACLES):
        assert QUERIES[name](spark, SF).count() > 0, name


def test_entry_and_names(spark):
    assert entry_module.entry(spark).count() > 0
    assert set(entry_module.oracle_sql()) <= set(entry_module.queries())
    assert set(QUERIES) <= set(entry_module.queries())


@pytest.mark.parametrize("name", ["nearest_approach_distance", "nearest_approach_instant", "temporal_distance"])
def test_distances_of_all_have_pairs_of_every_two_types(spark, name):
    kind = {0: "truck", 1: "bus"}
    pairs = QUERIES[f"{name}_of_all"](spark, SF).select("a_mo_id", "b_mo_id").collect()
    found = {frozenset(kind.get(m // TRIPS % 10, "passenger") for m in p) for p in pairs}
    assert found == {frozenset(x) for x in (["truck"], ["bus"], ["passenger"], ["truck", "bus"], ["truck", "passenger"], ["bus", "passenger"])}
