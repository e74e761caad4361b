"""Every registered query with SQL against DuckDB at the smallest scale, and joins against brute force."""

import os

import duckdb
import pandas as pd
import pytest

from geoledger.operators.components import connected_components
from geoledger.operators.spatial import grid_join, self_pairs
from geoledger.plans.registry import ORACLES, QUERIES
from geoledger.sources.views import view

SF = "/root/testdata/sf0.001"


def rows(df):
    df = df[sorted(df.columns)]
    tidy = lambda v: None if pd.isna(v) else round(float(v), 9) if isinstance(v, (int, float)) else v
    return sorted(str([tidy(v) for v in r]) for r in df.astype(object).values)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_as_sql(spark, name):
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.sql(f"create view {f.split('.')[0]} as select * from '{SF}/{f}'")
    assert rows(QUERIES[name](spark, SF).toPandas()) == rows(con.sql(ORACLES[name]).df())


@pytest.mark.parametrize(("within", "cell"), [(0, 50), (300, 100), (300, 5000), (1000, None)])
def test_grid_join_is_the_cross_join(spark, within, cell):
    b = view(spark, SF, "building").select("id", "xmin", "ymin", "xmax", "ymax")
    got = {(r.l.id, r.r.id, r.d2) for r in grid_join(b, b, within, cell).collect()}
    assert len(got) == grid_join(b, b, within, cell).count()
    want, all_ = set(), b.collect()
    for x in all_:
        for y in all_:
            d = max(0, x.xmin - y.xmax, y.xmin - x.xmax) ** 2 + max(0, x.ymin - y.ymax, y.ymin - x.ymax) ** 2
            if d <= within * within:
                want.add((x.id, y.id, d))
    assert got == want


def test_components(spark):
    edges = [(1, 2), (2, 3), (9, 8), (5, 5), (None, 1), (4, 3), *[(100 + k, 101 + k) for k in range(60)], *[(500, 501 + k) for k in range(40)]]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "u bigint, v bigint")).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 1, 8: 8, 9: 8, **{100 + k: 100 for k in range(61)}, **{500 + k: 500 for k in range(41)}}
    assert connected_components(spark.createDataFrame([], "u bigint, v bigint")).count() == 0


def test_sets_complement(spark):
    ids = lambda name: {r.id for r in QUERIES[name](spark, SF).select("id").collect()}
    assert ids("permitted_facilities") | ids("unpermitted_facilities") == ids("confirmed_facilities")
    assert not ids("permitted_facilities") & ids("unpermitted_facilities")
    assert not ids("permits_with_facility") & ids("permits_without_facility")


def test_self_pairs_have_an_order(spark):
    b = view(spark, SF, "building").select("id", "xmin", "ymin", "xmax", "ymax")
    assert self_pairs(b, 500).where("id_a >= id_b").count() == 0
