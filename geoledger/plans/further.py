"""Further relations of tiles, clusters and survey sources; each reads whole views."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from geoledger.operators.components import connected_components, member_digest
from geoledger.operators.spatial import boxes_of_points, grid_join
from geoledger.operators.storage import materialize
from geoledger.plans.estimates import _TC, _TILES, survey, tile_status
from geoledger.plans.library import _ADJ, _CONFIRMED, _D2, _EX_ANTE, _V, components, ex_ante, query
from geoledger.plans.linkage import _SCORED, scored_pairs
from geoledger.plans.linkage import _V as _LINKED
from geoledger.plans.matching import _COMP
from geoledger.plans.quality import ex_ante_positive
from geoledger.plans.reports import _ANY, _BOX, _ON, on_tile
from geoledger.sources.views import view

_BASE = _CONFIRMED + _ON + f""", first as (select id from tile where {_EX_ANTE}), e as (select distinct t.* from on_tile o join tile t on t.id = o.tile where {_EX_ANTE.replace('bucket', 't.bucket')}),
    base as (select id from first union select b.id from e a join tile b on {_ADJ} where b.bucket is not null)"""
_TILED = [*_V, "tile", "tile_annotation"]


@query("initial_tiles_by_positive", _TILED, _BASE + " select id from base")
def initial_by_positive(spark, d):
    """Ex-ante tiles, and the neighbours of those with a confirmed site."""
    t = view(spark, d, "tile")
    e = t.join(ex_ante_positive(spark, d).select(F.col("tile").alias("id")).distinct(), "id", "left_semi")
    near = grid_join(e.select(*_BOX), t.where("bucket is not null").select(*_BOX), 0, 2002).where("l.id <> r.id").select("r.id")
    return ex_ante(spark, d).select("id").union(near).distinct()


@query("initial_by_positive_needing_labels", _TILED, _BASE + " select id from base where id not in (select tile_id from tile_annotation)")
def initial_unlabeled(spark, d):
    return initial_by_positive(spark, d).join(view(spark, d, "tile_annotation").select(F.col("tile_id").alias("id")), "id", "left_anti")


#: SQL: weight(tile, w), the sites of a tile, each counted as 1/k where k tiles report it.
_WEIGHT = _CONFIRMED + _ON + _TILES + """, reported as (select site, count(distinct tile) as k from on_tile group by site),
    weight as (select tile, sum(1.0 / k) as w from (select distinct tile, site from on_tile) join reported using (site) group by tile)"""
_WEIGHED = [*_TILED, "county"]


def weights(spark, d: str) -> DataFrame:
    o = materialize(on_tile(spark, d).distinct(), "on")
    k = o.groupBy("site").agg(F.count("*").alias("k"))
    return o.join(k, "site").groupBy(F.col("tile").alias("id")).agg(F.expr("sum(1.0D / k)").alias("w"))


@query("multiplicity_by_stratum", _WEIGHED, _WEIGHT + """ select s.stratum, s.total, s.labeled as sampled, s.total / cast(s.labeled as double) * sum(coalesce(w.w, 0)) as estimate
    from strata s join status t on t.stratum = s.stratum and t.labeled left join weight w on w.tile = t.id group by s.stratum, s.total, s.labeled""")
def multiplicity_by_stratum(spark, d):
    """Sites on sampled tiles, each 1/k where k tiles show it, expanded by tiles over sampled tiles. Strata without a label have no row."""
    t = tile_status(spark, d).where("stratum is not null").join(weights(spark, d), "id", "left")
    g = t.groupBy("stratum").agg(F.count("*").alias("total"), F.count_if("labeled").alias("sampled"), F.sum(F.when(F.col("labeled"), F.coalesce("w", F.lit(0.0)))).alias("x"))
    return g.where("sampled > 0").select("stratum", "total", "sampled", F.expr("total / cast(sampled as double) * x").alias("estimate"))


_BIN = "cast(floor(coalesce(w, 0) / 0.25 + 1e-9) as bigint)"


@query("source_weight_histogram", _WEIGHED, _WEIGHT + f", h as (select t.status, {_BIN} as bin from status t left join weight w on w.tile = t.id where t.labeled and t.bucket is not null) select 'sampled' as part, bin, count(*) as tiles from h where status = 'labeled' group by bin union all select 'full', bin, count(*) from h group by bin")
def weight_histogram(spark, d):
    """Labeled tiles by the weight of the sites they show, in steps of 1/4: the sampled ones and all."""
    h = tile_status(spark, d).where("labeled and bucket is not null").join(weights(spark, d), "id", "left").withColumn("part", F.expr("explode(if(status = 'labeled', array('sampled', 'full'), array('full')))"))
    return h.groupBy("part", F.expr(_BIN).alias("bin")).agg(F.count("*").alias("tiles"))


_SHRUNK = "{0}(rate * total, 0)"
_KEPT = "{0}(rate * total * (positive / cast(labeled as double)), 0)"


def _sums(r: str) -> list[str]:
    s, k = (f"cast({x.format(r)} as bigint)" for x in (_SHRUNK, _KEPT))
    parts = {"labeled": s, "positive": k, "unlabeled": f"total - {s}", "surplus": f"positive - {k}"}
    return [f"cast(sum({e}) as bigint) as {n}" for n, e in parts.items()]


@query("aggregated_strata", _TC, _TILES + f", p as (select *, split_part(stratum, ':', 1) as part from strata where stratum <> 'completed' and labeled > 0), r as (select *, min(labeled / cast(total as double)) over (partition by part) as rate from p) select part, {', '.join(_sums('round_even'))} from r where unlabeled > 0 group by part")
def aggregated_strata(spark, d):
    """Strata of a bucket shrunk to its lowest sampling rate and merged; surplus positives are to be added as found.

    Halves round to even. Strata without a label are left out, those fully labeled take part in the rate only.
    """
    p = survey(spark, d).where("stratum <> 'completed' and labeled > 0").withColumn("part", F.substring_index("stratum", ":", 1))
    r = p.withColumn("rate", F.min(F.expr("labeled / cast(total as double)")).over(W.partitionBy("part"))).where("unlabeled > 0")
    return r.groupBy("part").agg(*[F.expr(e) for e in _sums("bround")])


@query("least_labeled_strata", _TC, _TILES + " select stratum, labeled / cast(total as double) as rate, row_number() over (order by labeled / cast(total as double), stratum) as turn from strata where unlabeled > 0")
def least_labeled(spark, d):
    """In which order the strata (a few dozen) would be labeled next, lowest sampling rate first."""
    s = survey(spark, d).where("unlabeled > 0").select("stratum", F.expr("labeled / cast(total as double)").alias("rate"))
    return s.withColumn("turn", F.row_number().over(W.orderBy("rate", "stratum")).cast("long"))


@query("tile_group_buckets", ["tile", "building"], _ANY + f""", h as (select t.* from tile t join hit using (id)), e as (select a.id as u, b.id as v from h a join h b on {_ADJ}),
    reach(node, root) as (select u, u from e union select e.v, r.root from reach r join e on e.u = r.node), c as (select node, min(root) as component from reach group by node),
    g as (select component, coalesce(bucket, 'none') as bucket, count(*) as n from c join tile on id = node group by 1, 2), s as (select component, string_agg(concat(bucket, ' x ', n), ', ' order by bucket) as buckets from g group by 1)
    select buckets, count(*) as groups from s group by buckets""", True)
def tile_group_buckets(spark, d):
    """Groups of two or more adjacent tiles with a building, by the multiset of their buckets (as bucket x count)."""
    t = view(spark, d, "tile")
    hit = materialize(t.join(on_tile(spark, d, view(spark, d, "building")).select(F.col("tile").alias("id")), "id", "left_semi"), "hit")
    near = grid_join(hit.select(*_BOX), hit.select(*_BOX), 0, 2002).where("l.id < r.id").select(F.col("l.id").alias("u"), F.col("r.id").alias("v"))
    g = connected_components(near).withColumnRenamed("node", "id").join(hit.select("id", F.coalesce("bucket", F.lit("none")).alias("bucket")), "id").groupBy("component", "bucket").agg(F.count("*").alias("n"))
    each = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("bucket", "n"))), lambda s: F.concat_ws(" x ", s.bucket, s.n.cast("string"))), ", ")  # at most one entry a bucket
    return g.groupBy("component").agg(each.alias("buckets")).groupBy("buckets").agg(F.count("*").alias("groups"))


@query("cluster_parts", ["building", "tile"], _COMP + """, m as (select c.component, b.* from c join building b on b.id = c.node) select component, 'building' as kind, id from m
    union all select distinct component, 'parcel', parcel_id from m where parcel_id is not null
    union all select distinct component, 'tile', t.id from m join tile t on t.xmin <= m.xmax and m.xmin <= t.xmax and t.ymin <= m.ymax and m.ymin <= t.ymax""", True)
def cluster_parts(spark, d):
    """The active buildings, distinct parcels and distinct tiles of every cluster, one row each."""
    m = materialize(components(spark, d).withColumnRenamed("node", "id").join(view(spark, d, "building"), "id"), "members")
    part = lambda df, kind, c: df.select("component", F.lit(kind).alias("kind"), F.col(c).alias("id")).distinct()
    tiles = on_tile(spark, d, m).join(m.select(F.col("id").alias("site"), "component"), "site")
    return part(m, "building", "id").union(part(m.where("parcel_id is not null"), "parcel", "parcel_id")).union(part(tiles, "tile", "tile"))


@query("permits_in_cluster_extents", ["building", "permit"], _COMP + """, x as (select component, min(xmin) as xmin, min(ymin) as ymin, max(xmax) as xmax, max(ymax) as ymax from c join building b on b.id = c.node group by 1)
    select component, p.id as permit from x join permit p on p.rx between xmin and xmax and p.ry between ymin and ymax""", True)
def permits_in_extents(spark, d):
    b = view(spark, d, "building").withColumnRenamed("id", "node")
    x = components(spark, d).join(b, "node").groupBy(F.col("component").alias("id")).agg(*[F.min(c).alias(c) for c in _BOX[1:3]], *[F.max(c).alias(c) for c in _BOX[3:]])
    p = boxes_of_points(view(spark, d, "permit").select("id", "rx", "ry"), "rx", "ry").select(*_BOX)
    return grid_join(x, p, 0, 1000).select(F.col("l.id").alias("component"), F.col("r.id").alias("permit"))


@query("permit_locations", ["permit"], ", loc as (select rx, ry, min(id) as location, count(*) as permits from permit group by 1, 2) select p.id, l.location, l.permits from permit p left join loc l on l.rx = p.rx and l.ry = p.ry")
def permit_locations(spark, d):
    """Permits joined on both coordinates to a table of distinct places, named by their smallest permit."""
    p = view(spark, d, "permit").select("id", "rx", "ry")
    loc = p.groupBy("rx", "ry").agg(F.min("id").alias("location"), F.count("*").alias("permits"))
    return p.join(loc, ["rx", "ry"], "left").select("id", "location", "permits")


@query("neighbouring_clusters", ["building"], _COMP + f""", m as (select c.component, b.* from c join building b on b.id = c.node)
    select a.component, b.component as other, 'distance' as reason, count(*) as edges from m a join m b on a.component < b.component and {_D2} <= 1000000 group by 1, 2
    union all select a.component, b.component, 'parcel', count(*) from m a join m b on a.component < b.component and a.parcel_id = b.parcel_id group by 1, 2""", True)
def neighbouring_clusters(spark, d):
    """Pairs of clusters with edges between their buildings, by reason. Parcels pair clusters, not buildings."""
    m = materialize(components(spark, d).withColumnRenamed("node", "id").join(view(spark, d, "building"), "id"), "members")
    near = grid_join(m.select(*_BOX, "component"), m.select(*_BOX, "component"), 1000).where("l.component < r.component")
    near = near.groupBy(F.col("l.component").alias("component"), F.col("r.component").alias("other")).agg(F.count("*").alias("edges"))
    on = m.where("parcel_id is not null").groupBy("parcel_id", "component").agg(F.count("*").alias("n"))
    same = on.join(on.toDF("parcel_id", "other", "k"), "parcel_id").where("component < other").groupBy("component", "other").agg(F.sum(F.col("n") * F.col("k")).alias("edges"))
    tag = lambda df, why: df.select("component", "other", F.lit(why).alias("reason"), "edges")
    return tag(near, "distance").union(tag(same, "parcel"))


@query("carried_cluster_ids", ["building"], f""", pair as (select a.id as u, b.id as v, {_D2} as d2 from building a join building b on a.id <> b.id and not a.excluded and not b.excluded and {_D2} <= 160000),
    reach(within, node, root) as (select cast(w as bigint), id, id from building, (values (200), (400)) t(w) where not excluded union select r.within, p.v, r.root from reach r join pair p on p.u = r.node and p.d2 <= r.within * r.within),
    c as (select within, node, min(root) as component from reach group by 1, 2), k as (select within, component, md5(string_agg(node, ',' order by node)) as members from c group by 1, 2)
    select n.component, case when o.component is null then concat('new:', n.component) else concat('old:', o.component) end as id from k n left join k o on o.within = 200 and o.members = n.members where n.within = 400""", True)
def carried_ids(spark, d):
    """Clusters at 400 m; one with the members of a cluster at 200 m carries that one's id on."""
    keys = lambda w: components(spark, d, w).groupBy("component").agg(member_digest("node").alias("members"), F.count("*").alias("n"))
    old = keys(200).withColumnRenamed("component", "was")
    return keys(400).join(old, ["members", "n"], "left").select("component", F.expr("case when was is null then concat('new:', component) else concat('old:', was) end").alias("id"))


_UNLIKE = "tfidf >= 700 and fuzzy < 600"


@query("clusters_by_words_alone", _LINKED, _SCORED + f""", e as (select id_a as u, id_b as v from scored where {_UNLIKE}), s as (select u, v from e union all select v, u from e),
    reach(node, root) as (select u, u from s union select s.v, r.root from reach r join s on s.u = r.node), c as (select node, min(root) as component from reach group by node)
    select distinct c.component, p.owner from c join building b on b.id = c.node join parcel p on p.id = b.parcel_id""", True)
def clusters_by_words_alone(spark, d):
    """Clusters whose owners share rare words but differ in spelling: one row for each owner."""
    e = scored_pairs(spark, d).where(_UNLIKE).select(F.col("id_a").alias("u"), F.col("id_b").alias("v"))
    b = view(spark, d, "building").select(F.col("id").alias("node"), "parcel_id").where("parcel_id is not null")
    own = view(spark, d, "parcel").select(F.col("id").alias("parcel_id"), "owner")
    return connected_components(e).join(b, "node").join(own, "parcel_id").select("component", "owner").distinct()
