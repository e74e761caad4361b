"""Clusterings at every threshold from one weight-ordered forest: sweeps, groups that differ from a reference, nested clusters."""

from __future__ import annotations

from pyspark.sql import functions as F

from geoledger.operators.forest import cluster_counts, clusters_at, differing_groups, minimum_forest
from geoledger.operators.names import fuzzy_pairs
from geoledger.operators.spatial import self_pairs
from geoledger.operators.storage import materialize
from geoledger.plans.library import _D2, query
from geoledger.plans.linkage import _BOX, _KEEP, _SCORED, _V, scored_pairs
from geoledger.sources.views import view

_WITHIN = tuple(range(0, 401, 50))
_SQUARES = ", ".join(f"({k})" for k in _WITHIN)
#: SQL: c(within, node, component) of live buildings, linked within each of the distances.
_NESTED = f""", live as (select * from building where not excluded), pair as (select a.id as u, b.id as v, {_D2} as d2 from live a join live b on a.id <> b.id and {_D2} <= 160000),
    reach(within, node, root) as (select cast(w as bigint), id, id from live, (values {_SQUARES}) t(w)
        union select r.within, p.v, r.root from reach r join pair p on p.u = r.node and p.d2 <= r.within * r.within),
    c as (select within, node, min(root) as component from reach group by 1, 2)"""


def live_forest(spark, d: str):
    """(buildings that are not excluded, the forest of their pairs within 400 m by squared distance)."""
    live = view(spark, d, "building").where("not excluded")
    pairs = self_pairs(live.select(*_BOX), max(_WITHIN)).select(F.col("id_a").alias("u"), F.col("id_b").alias("v"), F.col("d2").cast("long").alias("w"))
    return live, materialize(minimum_forest(pairs), "live-forest")


@query("forest_distance_sweep", ["building"], _NESTED + " select within, count(distinct component) as clusters from c group by within", True)
def forest_distance_sweep(spark, d):
    """Clusters at every linking distance: buildings less the forest edges up to it."""
    live, forest = live_forest(spark, d)
    return cluster_counts(live.select("id"), forest, [k * k for k in _WITHIN]).select(F.sqrt("threshold").cast("long").alias("within"), "clusters")


_LONE = f""", live as (select * from building where not excluded), base as (select a.id as u, b.id as v from live a join live b on a.parcel_id = b.parcel_id and a.id <> b.id),
    pair as (select u, v, 0 as d2 from base union all select a.id, b.id, {_D2} from live a join live b on a.id <> b.id and {_D2} <= 160000 and (a.id not in (select u from base) or b.id not in (select u from base))),
    reach(within, node, root) as (select cast(w as bigint), id, id from live, (values {_SQUARES}) t(w)
        union select r.within, p.v, r.root from reach r join pair p on p.u = r.node and p.d2 <= r.within * r.within),
    c as (select within, node, min(root) as component from reach group by 1, 2) select within, count(distinct component) as clusters from c group by within"""


@query("forest_lone_sweep", ["building"], _LONE, True)
def forest_lone_sweep(spark, d):
    """Clusters by the distance within which buildings that no parcel links are joined: fixed edges weigh 0."""
    live = view(spark, d, "building").where("not excluded")
    # a parcel's buildings are all linked to its first one, which makes the same clusters as all pairs
    first = live.where("parcel_id is not null").groupBy("parcel_id").agg(F.min("id").alias("v"))
    base = materialize(live.select(F.col("id").alias("u"), "parcel_id").join(first, "parcel_id").where("u <> v").select("u", "v"), "fixed")
    linked = base.select(F.col("u").alias("id")).union(base.select("v")).distinct().withColumn("linked", F.lit(True))
    pairs = self_pairs(live.select(*_BOX), max(_WITHIN))
    pairs = pairs.join(linked.toDF("id_a", "la"), "id_a", "left").join(linked.toDF("id_b", "lb"), "id_b", "left").where("la is null or lb is null")
    edges = base.withColumn("w", F.lit(0).cast("long")).union(pairs.select("id_a", "id_b", F.col("d2").cast("long")))
    return cluster_counts(live.select("id"), minimum_forest(edges), [k * k for k in _WITHIN]).select(F.sqrt("threshold").cast("long").alias("within"), "clusters")


def score_sweep(spark, d: str, score: str, thresholds: list[int]):
    """(threshold, clusters) by the least ``score`` ("fuzzy" or "tfidf") that an edge within 400 m needs, the other threshold as usual.

    Edges that stand on verdicts, blank owners or parcels hold at every threshold.
    """
    other = {"fuzzy": "tfidf >= 700", "tfidf": "fuzzy >= 600"}[score]
    least = {"fuzzy": "fuzzy >= 600", "tfidf": "tfidf >= 700"}[score]
    scored = scored_pairs(spark, d).where("not excluded")
    fixed = f"coalesce({_KEEP.replace(least, 'false')}, false)"
    edges = scored.where(f"{fixed} or coalesce(distance >= 600 and {other} and {score} is not null, false)").select(F.col("id_a").alias("u"), F.col("id_b").alias("v"), F.expr(f"if({fixed}, -100000, -{score})").cast("long").alias("w"))
    live = view(spark, d, "building").where("not excluded")
    first = live.where("parcel_id is not null").groupBy("parcel_id").agg(F.min("id").alias("v"))
    base = live.select(F.col("id").alias("u"), "parcel_id").join(first, "parcel_id").where("u <> v").select("u", "v", F.lit(-100000).cast("long").alias("w"))
    got = cluster_counts(live.select("id"), minimum_forest(edges.union(base)), [-t for t in thresholds])
    return got.select((-F.col("threshold")).alias("threshold"), "clusters")


@query("score_sweeps")
def score_sweeps(spark, d):
    """Both owner-name scores, from 0 to 1000."""
    steps = list(range(0, 1001, 100))
    one = lambda s: score_sweep(spark, d, s, steps).select(F.lit(s).alias("score"), "threshold", "clusters")
    return one("fuzzy").union(one("tfidf"))


@query("groups_differing_from_parcels", ["building"], _NESTED + """, g as (select node, component from c where within = 400),
    p as (select g.component, c.within, c.component as own, coalesce(cast(l.parcel_id as varchar), 'own ' || cast(l.id as varchar)) as label from c join g using (node) join live l on l.id = c.node)
    select within, component, count(distinct own) as clusters, count(distinct label) as reference_clusters, not (count(distinct own) = count(distinct label) and count(distinct label) = count(distinct (own, label))) as differs from p group by 1, 2""", True)
def groups_differing(spark, d):
    """For each 400 m group and linking distance: whether the group's clusters there are those that parcels make."""
    live, forest = live_forest(spark, d)
    out = differing_groups(live.select("id"), forest, live.select(F.col("id").alias("node"), F.col("parcel_id").alias("label")), [k * k for k in _WITHIN])
    return out.select(F.sqrt("threshold").cast("long").alias("within"), "component", "clusters", "reference_clusters", "differs")


def nested_owners(spark, d: str, narrow: int = 100, wide: int = 400):
    """(component, name_a, name_b): owners of different narrow clusters of one wide cluster, each unordered pair once."""
    live, forest = live_forest(spark, d)
    label = lambda within, name: live.select(F.col("id").alias("node")).join(clusters_at(forest, within * within), "node", "left").select("node", F.coalesce("component", "node").alias(name))
    parcels = view(spark, d, "parcel").select(F.col("id").alias("parcel_id"), "owner")
    own = live.select(F.col("id").alias("node"), "parcel_id").join(parcels, "parcel_id").where("trim(owner) <> ''").select("node", "owner")
    all_ = label(wide, "component").join(label(narrow, "part"), "node").join(own, "node").select("component", "part", "owner").distinct()
    several = all_.groupBy("component").agg(F.count_distinct("part").alias("parts")).where("parts > 1").select("component")
    all_ = materialize(all_.join(several, "component", "left_semi"), "nested")
    pairs = all_.toDF("component", "pa", "name_a").join(all_.toDF("component", "pb", "name_b"), "component").where("pa <> pb and name_a < name_b")
    return pairs.select("component", "name_a", "name_b").distinct()


@query("nested_cluster_owners", ["building", "parcel"], _NESTED + """, o as (select distinct w.component, n.component as part, p.owner from c w join c n on n.node = w.node and n.within = 100 and w.within = 400 join live l on l.id = w.node join parcel p on p.id = l.parcel_id where trim(p.owner) <> '')
    select distinct a.component, a.owner as name_a, b.owner as name_b from o a join o b on a.component = b.component and a.part <> b.part and a.owner < b.owner""", True)
def nested_cluster_owners(spark, d):
    return nested_owners(spark, d)


@query("nested_cluster_candidates")
def nested_candidates(spark, d):
    """Owner pairs of nested clusters whose names are alike (fuzzy over 350)."""
    pairs = materialize(nested_owners(spark, d), "nested-pairs")
    return pairs.join(fuzzy_pairs(pairs.select("name_a", "name_b").distinct()), ["name_a", "name_b"]).where("fuzzy > 350").select("component", "name_a", "name_b", "fuzzy")


@query("tfidf_bin_examples", _V, _SCORED + """, t as (select distinct name_a, name_b, tfidf, cast(floor(least(tfidf, 999) / 100.0) as bigint) as bin from scored where tfidf is not null and not excluded),
    r as (select bin, row_number() over (partition by bin order by md5(concat_ws('|', name_a, name_b)), name_a, name_b) as k, name_a, name_b, tfidf from t) select * from r where k <= 3""")
def tfidf_bins(spark, d):
    """Three owner pairs of each bin of 100 of the word score, in a fixed random order."""
    from pyspark.sql import Window as W

    scored = scored_pairs(spark, d).where("tfidf is not null and not excluded").select("name_a", "name_b", "tfidf").distinct()
    binned = scored.withColumn("bin", F.floor(F.least("tfidf", F.lit(999)) / 100))
    k = F.row_number().over(W.partitionBy("bin").orderBy(F.md5(F.concat_ws("|", "name_a", "name_b")), "name_a", "name_b"))
    return binned.withColumn("k", k).where("k <= 3").select("bin", F.col("k").cast("long").alias("k"), "name_a", "name_b", "tfidf")
