"""No side that grows with the data goes through the driver: Spark takes sizes from compressed files, before boxes and edges are dealt to cells."""

import re

import pytest
from pyspark.sql.readwriter import DataFrameWriter

from geoledger.plans.registry import QUERIES

SF = "/root/testdata/sf0.001"
#: Keys of joins whose sides are dealt to cells or strips; at this scale Spark broadcasts every side that it may.
GROWING = r"BroadcastHashJoin \[(cx|shape)#\d+L?, (cy|slab)#"


@pytest.mark.parametrize(
    "name",
    [
        "closest_unless_tied",
        "best_permits",
        "facilities_by_best_permit",
        "buildings_on_parcel_polygons",
        "completeness_checks",
        "estimate_headlines",
        "facility_attributes",
        "facility_tile_ratio",
        "initial_tiles_by_positive",
        "match_set_algebra",
        "lone_cluster_nearest",
        "facility_feature_values",
        "nearest_facility",
        "parcel_points_within_hull",
        "parcel_site_else_closest",
        "permit_match_by_points",
        "permit_parcel_polygons",
        "unlabeled_next_to_positive_tiles",
        "staged_match",
        "site_permits_by_polygon",
    ],
)
def test_cells_are_not_broadcast(spark, monkeypatch, name):
    plans = []
    plan = lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString())
    write = DataFrameWriter.parquet
    monkeypatch.setattr(DataFrameWriter, "parquet", lambda self, *a, **b: (plan(self._df), write(self, *a, **b))[1])
    plan(QUERIES[name](spark, SF))
    assert any("SortMergeJoin" in p for p in plans)
    assert not [m[0] for p in plans for m in re.finditer(GROWING, p)]
