"""Feature texts and collections, and sweeps and nested clusterings against one run per threshold."""

import json
import os

from pyspark.sql import functions as F

from geoledger.operators.components import connected_components
from geoledger.plans import features, nested
from geoledger.plans.library import components
from geoledger.sources.views import view

SF = "/root/testdata/sf0.001"


def document(path):
    return "".join(open(f"{path}/{n}").read() for n in sorted(os.listdir(path)) if n.startswith("part-"))


def test_collection_of_facilities_is_one_document(spark, tmp_path):
    made = features.facility_features(spark, SF)
    features.write_collection(made, str(tmp_path / "f"), "facility", "feature")
    whole = json.loads(document(tmp_path / "f"))
    assert whole["type"] == "FeatureCollection" and len(whole["features"]) == made.count() > 100
    ids = [f["properties"]["id"] for f in whole["features"]]
    assert ids == sorted(set(ids))
    for f in whole["features"]:
        assert f["type"] == "Feature" and f["id"] == f["properties"]["hash"] and f["geometry"]["type"] == "MultiPolygon"
        x, y = f["properties"]["x"], f["properties"]["y"]
        assert f["bbox"][0] <= x <= f["bbox"][2] and f["bbox"][1] <= y <= f["bbox"][3]
        assert all(r[0] == r[-1] for g in f["geometry"]["coordinates"] for r in g)
        assert {p["owner"] for p in f["properties"]["parcels"]} <= {features.REDACTED} and len({p["id"] for p in f["properties"]["parcels"]}) == len(f["properties"]["parcels"])
    owners = {r.owner for r in view(spark, SF, "parcel").where("owner <> ''").select("owner").collect()}
    assert not any(o in json.dumps(whole) for o in list(owners)[:50])


def test_empty_and_single_collections(spark, tmp_path):
    one = spark.createDataFrame([(5, '{"type":"Feature"}')], "k bigint, t string")
    features.write_collection(one, str(tmp_path / "one"), "k", "t")
    assert json.loads(document(tmp_path / "one")) == {"type": "FeatureCollection", "features": [{"type": "Feature"}]}
    features.write_collection(one.where("k < 0"), str(tmp_path / "none"), "k", "t")
    assert json.loads(document(tmp_path / "none")) == {"type": "FeatureCollection", "features": []}


def test_sweeps_equal_one_run_per_threshold(spark):
    got = {r.within: r.clusters for r in nested.forest_distance_sweep(spark, SF).collect()}
    for within in (0, 200, 400):
        assert got[within] == components(spark, SF, within).select("component").distinct().count()
    scored = nested.scored_pairs(spark, SF).where("not excluded")
    swept = {r.threshold: r.clusters for r in nested.score_sweep(spark, SF, "fuzzy", [0, 600, 1000]).collect()}
    live = view(spark, SF, "building").where("not excluded").select("id", "parcel_id")
    parcel = live.toDF("u", "parcel_id").join(live.toDF("v", "parcel_id"), "parcel_id").where("u < v").select("u", "v")
    for t in swept:
        keep = nested._KEEP.replace("fuzzy >= 600", f"fuzzy >= {t}")
        found = connected_components(scored.where(f"coalesce({keep}, false)").select(F.col("id_a").alias("u"), F.col("id_b").alias("v")).union(parcel))
        alone = live.join(found.select(F.col("node").alias("id")), "id", "left_anti").count()
        assert swept[t] == alone + found.select("component").distinct().count()
