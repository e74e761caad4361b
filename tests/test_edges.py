"""Edges at the borders of their ranges, against the query's SQL on rows made for it."""

import duckdb
import pyarrow.parquet as pq

from geoledger.plans.registry import ORACLES, QUERIES
from geoledger.sources.views import view_sql

CUSTOMERS = "/root/testdata/sf0.1/customer.parquet"


def test_edges_in_range_has_distances_that_are_rounded_down(spark, tmp_path):
    con = duckdb.connect()
    con.sql(f"create view customer as select * from '{CUSTOMERS}'")
    gap = "sqrt(pow(greatest(0, a.xmin - b.xmax, b.xmin - a.xmax), 2) + pow(greatest(0, a.ymin - b.ymax, b.ymin - a.ymax), 2))"
    pairs = con.sql(f"with {view_sql('building')} select a.id, b.id from building a join building b on a.xmin between b.xmin - 500 and b.xmin + 500 and a.id < b.id and {gap} > 400 and {gap} < 401 where a.id >= 0").fetchall()
    assert pairs
    keys = sorted({k for p in pairs for k in p})
    customers = pq.read_table(CUSTOMERS).to_pandas()
    customers[customers.c_custkey.isin(keys)].to_parquet(tmp_path / "customer.parquet")
    con.sql(f"create or replace view customer as select * from '{tmp_path}/customer.parquet'")
    got = sorted(tuple(r) for r in QUERIES["edges_in_range"](spark, str(tmp_path)).collect())
    assert got == sorted(con.sql(ORACLES["edges_in_range"]).fetchall())
    assert set(pairs) <= set(got) and {(b, a) for a, b in pairs} <= set(got)
