"""Link scores, thresholded edges, clusterings and their comparison."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from geoledger.operators.bridges import bridges
from geoledger.operators.components import connected_components, member_digest
from geoledger.operators.names import clean_name, fuzzy_pairs, tfidf_pairs
from geoledger.operators.spatial import self_pairs
from geoledger.operators.storage import materialize
from geoledger.plans.library import _D2, query
from geoledger.sources.views import view

_V = ["building", "parcel", "owner_verdict"]
_BOX = ["id", "xmin", "ymin", "xmax", "ymax"]

#: SQL: half = unordered distance pairs with both owners (null without a parcel, '' blank).
_HALF = f""", half as (select a.id as id_a, b.id as id_b, a.parcel_id as parcel_a, b.parcel_id as parcel_b, a.excluded or b.excluded as excluded, pa.owner as name_a, pb.owner as name_b,
    1000 - cast(floor(sqrt({_D2})) as bigint) as distance from building a join building b on a.id < b.id and {_D2} <= 1000000
    left join parcel pa on pa.id = a.parcel_id left join parcel pb on pb.id = b.parcel_id)"""
_CLEAN = clean_name("{0}", r"'[^\p{{L}}\p{{N}}_\s]'", r"'\s+'", ", 'g'")
_FUZZY = f""", np as (select distinct name_a, name_b, {_CLEAN.format('name_a')} as ca, {_CLEAN.format('name_b')} as cb from half where name_a is not null and name_b is not null),
    cp as (select distinct ca, cb from np),
    lcs as (select ca, cb, case when ca = '' or cb = '' then 0 else list_max(list_reduce(list_transform(string_split(ca, ''), lambda ch: list_transform(string_split(cb, ''), lambda o: case when o = ch then 1 else 0 end)),
        lambda prev, m: list_transform(range(1, len(cb) + 1), lambda j: list_max(list_transform(range(1, j + 1), lambda i: greatest(prev[i], coalesce(prev[i - 1], 0) + m[i])))),
        list_transform(range(1, len(cb) + 1), lambda z: 0))) end as n from cp),
    fz as (select name_a, name_b, case when ca = '' and cb = '' then 1000 else cast(round_even(200.0 * n / (len(ca) + len(cb)), 0) as bigint) * 10 end as fuzzy from np join lcs using (ca, cb))"""
_TFIDF = r""", corpus as (select distinct owner as name from parcel), n as (select count(*) as docs from corpus),
    tf as (select name, word, count(*) as tf from (select name, unnest(regexp_extract_all(lower(name), '[\p{L}\p{N}_]{2,}')) as word from corpus) group by 1, 2),
    df as (select word, count(*) as df from tf group by word), w as (select name, word, tf * (ln((1 + docs) / (1 + df)) + 1) as w from tf join df using (word), n),
    norm as (select name, sqrt(sum(w * w)) as norm from w group by name),
    tp as (select distinct name_a, name_b from half where name_a is not null and name_b is not null),
    ti as (select p.name_a, p.name_b, coalesce(cast(floor(sum(x.w * y.w) / any_value(nx.norm) / any_value(ny.norm) * 1000 + 1e-7) as bigint), 0) as tfidf from tp p
        left join w x on x.name = p.name_a left join w y on y.name = p.name_b and y.word = x.word left join norm nx on nx.name = p.name_a left join norm ny on ny.name = p.name_b group by 1, 2)"""
_VERDICT = """, sym as (select lower(trim(name)) as a, lower(trim(related)) as b from owner_verdict where matched union select lower(trim(related)), lower(trim(name)) from owner_verdict where matched),
    hv as (select h.*, case when h.name_a is null or h.name_b is null then null when lower(trim(h.name_a)) = lower(trim(h.name_b)) or s.a is not null then 1000 else 0 end as verdict from half h
        left join sym s on s.a = lower(trim(h.name_a)) and s.b = lower(trim(h.name_b)))"""
_SCORED = f"""{_HALF}{_FUZZY}{_TFIDF}{_VERDICT}, scored as (select hv.*, fz.fuzzy, ti.tfidf from hv left join fz using (name_a, name_b) left join ti using (name_a, name_b))"""
_BLANK = "(name_a is null or trim(name_a) = '' or name_b is null or trim(name_b) = '')"
_KEEP = f"coalesce(distance >= 600 and tfidf >= 700 and fuzzy >= 600, false) or coalesce(distance >= 600 and verdict >= 999, false) or (distance >= 800 and {_BLANK})"
#: SQL: kept = unordered edges under the default thresholds, the lone-building rule included.
_KEPT = f""", base as (select id_a, id_b from scored where {_KEEP} union select a.id, b.id from building a join building b on a.parcel_id = b.parcel_id and a.id < b.id),
    linked as (select id_a as id from base union select id_b from base),
    kept as (select id_a, id_b from base union select id_a, id_b from scored where distance >= 950 and (id_a not in (select id from linked) or id_b not in (select id from linked)))"""
_REACH = """, e as (select k.id_a as u, k.id_b as v from kept k), both_ways as (select u, v from e union select v, u from e),
    live as (select id from building where not excluded),
    reach(node, root) as (select id, id from live union select b.v, r.root from reach r join both_ways b on b.u = r.node join live l on l.id = b.v),
    cluster as (select node, min(root) as component from reach group by node)"""


def half_pairs(spark, d: str) -> DataFrame:
    """Unordered building pairs within 1000 m with parcels and owners."""
    b = view(spark, d, "building")
    own = b.select("id", "parcel_id", "excluded").join(view(spark, d, "parcel").select(F.col("id").alias("parcel_id"), F.col("owner").alias("name")), "parcel_id", "left")
    half = self_pairs(b.select(*_BOX), 1000).select("id_a", "id_b", (1000 - F.floor(F.sqrt("d2"))).alias("distance"))
    a, c = own.toDF("parcel_a", "id_a", "ex_a", "name_a"), own.toDF("parcel_b", "id_b", "ex_b", "name_b")
    return half.join(a, "id_a").join(c, "id_b").withColumn("excluded", F.expr("ex_a or ex_b")).drop("ex_a", "ex_b")


def verdict_scores(spark, d: str, half: DataFrame) -> DataFrame:
    v = view(spark, d, "owner_verdict").where("matched").selectExpr("lower(trim(name)) as va", "lower(trim(related)) as vb")
    sym = v.union(v.select("vb", "va")).distinct().withColumn("hit", F.lit(True))
    keyed = half.withColumns({"va": F.expr("lower(trim(name_a))"), "vb": F.expr("lower(trim(name_b))")}).join(sym, ["va", "vb"], "left")
    return keyed.withColumn("verdict", F.expr("case when va is null or vb is null then null when va = vb or hit then 1000 else 0 end")).drop("va", "vb", "hit")


def scored_pairs(spark, d: str) -> DataFrame:
    """Distance pairs with all scores, written once; names are scored once per distinct pair."""
    half = materialize(half_pairs(spark, d), "half")
    names = half.select("name_a", "name_b").where("name_a is not null and name_b is not null").distinct()
    corpus = view(spark, d, "parcel").select(F.col("owner").alias("name"))
    scores = fuzzy_pairs(names).join(tfidf_pairs(corpus, names), ["name_a", "name_b"])
    return materialize(verdict_scores(spark, d, half).join(scores, ["name_a", "name_b"], "left"), "scored")


def parcel_half(spark, d: str) -> DataFrame:
    b = view(spark, d, "building").where("parcel_id is not null").select("id", "parcel_id")
    return b.toDF("id_a", "parcel_id").join(b.toDF("id_b", "parcel_id"), "parcel_id").where("id_a < id_b").select("id_a", "id_b")


def cluster_edges(spark, d: str, scored: DataFrame | None = None, keep: str = _KEEP, lone: int = 50) -> DataFrame:
    """Unordered edges that the thresholds keep; buildings left alone are joined within ``lone`` metres."""
    scored = scored if scored is not None else scored_pairs(spark, d)
    base = materialize(scored.where(keep).select("id_a", "id_b").union(parcel_half(spark, d)).distinct(), "edges")
    linked = base.select(F.col("id_a").alias("id")).union(base.select("id_b")).distinct().withColumn("linked", F.lit(True))
    near = scored.where(f"distance >= {1000 - lone}").select("id_a", "id_b")
    near = near.join(linked.toDF("id_a", "la"), "id_a", "left").join(linked.toDF("id_b", "lb"), "id_b", "left").where("la is null or lb is null")
    return base.union(near.select("id_a", "id_b")).distinct()


def clusters(spark, d: str, edges: DataFrame) -> DataFrame:
    """(node, component) over live buildings; one that is in no edge stands alone."""
    live = view(spark, d, "building").where("not excluded").select(F.col("id").alias("node"))
    e = edges.join(live.toDF("id_a"), "id_a", "left_semi").join(live.toDF("id_b"), "id_b", "left_semi")
    found = connected_components(e.select(F.col("id_a").alias("u"), F.col("id_b").alias("v")))
    return live.join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))


@query("cleaned_owner_names", ["parcel"], f" select distinct owner, {_CLEAN.format('owner')} as cleaned from parcel")
def cleaned(spark, d):
    return view(spark, d, "parcel").select("owner", F.expr(clean_name("owner")).alias("cleaned")).distinct()


@query("link_scores", _V, _SCORED + " select id_a, id_b, distance, cast(tfidf as bigint) as tfidf, cast(fuzzy as bigint) as fuzzy, cast(verdict as bigint) as verdict from scored")
def link_scores(spark, d):
    return scored_pairs(spark, d).select("id_a", "id_b", "distance", "tfidf", "fuzzy", F.col("verdict").cast("long").alias("verdict"))


_KINDS = ["distance", "tfidf", "fuzzy", "verdict"]


@query("edge_kinds", _V, _SCORED + "".join(f" {'union all' if i else ''} select '{k}' as reason, 2 * count({k}) as edges, cast(min({k}) as bigint) as lowest, cast(max({k}) as bigint) as highest from scored" for i, k in enumerate(_KINDS))
       + " union all select 'matching parcel', 2 * count(*), 1000, 1000 from building a join building b on a.parcel_id = b.parcel_id and a.id < b.id")
def edge_kinds(spark, d):
    long = scored_pairs(spark, d).unpivot(["id_a", "id_b"], [F.col(k).cast("long").alias(k) for k in _KINDS], "reason", "weight").where("weight is not null")
    rest = parcel_half(spark, d).select("id_a", "id_b", F.lit("matching parcel").alias("reason"), F.lit(1000).cast("long").alias("weight"))
    return long.union(rest).groupBy("reason").agg((2 * F.count("*")).alias("edges"), F.min("weight").alias("lowest"), F.max("weight").alias("highest"))


@query("edges_in_range", ["building"], f"{_HALF.replace('left join parcel pa on pa.id = a.parcel_id left join parcel pb on pb.id = b.parcel_id', '').replace('pa.owner', 'null').replace('pb.owner', 'null')} select id_a, id_b from half where distance >= 600 and distance < 800 union all select id_b, id_a from half where distance >= 600 and distance < 800")
def edges_in_range(spark, d):
    # the distance is rounded down, so 400 stands for all below 401
    half = self_pairs(view(spark, d, "building").select(*_BOX), 401).where("1000 - floor(sqrt(d2)) >= 600 and 1000 - floor(sqrt(d2)) < 800")
    return half.select("id_a", "id_b").union(half.select("id_b", "id_a"))


@query("no_owner_buildings", ["building", "parcel"], " select b.id from building b left join parcel p on p.id = b.parcel_id where not b.excluded and (p.owner is null or trim(p.owner) = '')")
def no_owner(spark, d):
    p = view(spark, d, "parcel").select(F.col("id").alias("parcel_id"), "owner")
    return view(spark, d, "building").join(p, "parcel_id", "left").where("not excluded and (owner is null or trim(owner) = '')").select("id")


@query("cluster_edges", _V, _SCORED + _KEPT + " select id_a, id_b from kept")
def kept_edges(spark, d):
    return cluster_edges(spark, d)


@query("owner_clusters", _V, _SCORED + _KEPT + _REACH + " select node, component from cluster", True)
def owner_clusters(spark, d):
    return clusters(spark, d, cluster_edges(spark, d))


@query("owners_of_wide_clusters", _V, _SCORED + _KEPT + _REACH + """, m as (select component, parcel_id from cluster join building on id = node), s as (select component, count(distinct parcel_id) as parcels from m group by component having count(distinct parcel_id) > 2)
    select distinct s.component, s.parcels, p.owner from s join m using (component) join parcel p on p.id = m.parcel_id where trim(p.owner) <> ''""", True)
def owners_of_wide_clusters(spark, d):
    """One row for each owner of a cluster with more than two parcels."""
    b = view(spark, d, "building").select(F.col("id").alias("node"), "parcel_id")
    m = materialize(clusters(spark, d, cluster_edges(spark, d)).join(b, "node").where("parcel_id is not null").select("component", "parcel_id").distinct(), "parcels")
    wide = m.groupBy("component").agg(F.count("*").alias("parcels")).where("parcels > 2")
    own = view(spark, d, "parcel").where("trim(owner) <> ''").select(F.col("id").alias("parcel_id"), "owner")
    return m.join(wide, "component").join(own, "parcel_id").select("component", "parcels", "owner").distinct()


@query("parcels_per_cluster", _V, _SCORED + _KEPT + _REACH + ", s as (select component, count(distinct parcel_id) as parcels from cluster join building on id = node group by component) select parcels, count(*) as clusters from s group by parcels", True)
def parcels_per_cluster(spark, d):
    b = view(spark, d, "building").select(F.col("id").alias("node"), "parcel_id")
    per = clusters(spark, d, cluster_edges(spark, d)).join(b, "node").groupBy("component").agg(F.count_distinct("parcel_id").alias("parcels"))
    return per.groupBy("parcels").agg(F.count("*").alias("clusters"))


@query("score_bin_examples", _V, _SCORED + """, b as (select cast(floor(fuzzy / 50) as bigint) * 50 as bin, name_a, name_b, fuzzy, row_number() over (partition by floor(fuzzy / 50) order by fuzzy desc, name_a, name_b) as k
    from (select distinct name_a, name_b, fuzzy from scored where fuzzy is not null and len(name_a) < 30 and len(name_b) < 30)) select bin, name_a, name_b, cast(fuzzy as bigint) as fuzzy from b where k = 1""")
def bin_examples(spark, d):
    s = scored_pairs(spark, d).where("fuzzy is not null and length(name_a) < 30 and length(name_b) < 30").select("name_a", "name_b", "fuzzy")
    best = s.groupBy((F.floor(F.col("fuzzy") / 50) * 50).alias("bin")).agg(F.min(F.struct((-F.col("fuzzy")).alias("low"), "name_a", "name_b")).alias("t"))
    return best.select("bin", "t.name_a", "t.name_b", (-F.col("t.low")).alias("fuzzy"))


@query("verdict_pairs", ["owner_verdict"], " select distinct least(name, related) as name_a, greatest(name, related) as name_b, matched from owner_verdict")
def verdict_pairs(spark, d):
    return view(spark, d, "owner_verdict").select(F.least("name", "related").alias("name_a"), F.greatest("name", "related").alias("name_b"), "matched").distinct()


_STEPS = (0, 50, 100, 200, 300, 400)


@query("cluster_sweep", ["building"], f""", pair as (select a.id as u, b.id as v, {_D2} as d2 from building a join building b on a.id <> b.id and not a.excluded and not b.excluded and {_D2} <= 160000),
    reach(within, node, root) as (select cast(w as bigint), id, id from building, (values {', '.join(f'({k})' for k in _STEPS)}) t(w) where not excluded
        union select r.within, p.v, r.root from reach r join pair p on p.u = r.node and p.d2 <= r.within * r.within),
    c as (select within, node, min(root) as component from reach group by 1, 2) select within, count(distinct component) as clusters from c group by within""", True)
def cluster_sweep(spark, d):
    """One components run for the whole sweep: a node is (distance, building) as text."""
    live = view(spark, d, "building").where("not excluded").select(*_BOX)
    steps = F.explode(F.array(*[F.lit(k).cast("long") for k in _STEPS])).alias("within")
    pairs = self_pairs(live, max(_STEPS)).select("*", steps).where("d2 <= within * within")
    node = lambda c: F.concat_ws(":", "within", c)
    found = connected_components(pairs.select(node("id_a").alias("u"), node("id_b").alias("v")))
    nodes = live.select("id", steps).select("within", node("id").alias("node"))
    return nodes.join(found, "node", "left").groupBy("within").agg(F.count_distinct(F.coalesce("component", "node")).alias("clusters"))


@query("clustering_difference", ["building"], f""", pair as (select a.id as u, b.id as v, {_D2} as d2 from building a join building b on a.id <> b.id and not a.excluded and not b.excluded and {_D2} <= 160000),
    reach(within, node, root) as (select cast(w as bigint), id, id from building, (values (200), (400)) t(w) where not excluded
        union select r.within, p.v, r.root from reach r join pair p on p.u = r.node and p.d2 <= r.within * r.within),
    c as (select within, node, min(root) as component from reach group by 1, 2), k as (select within, component, md5(string_agg(node, ',' order by node)) as members, count(*) as n from c group by 1, 2)
    select coalesce(a.component, b.component) as component, coalesce(a.n, b.n) as n, case when a.members is null then 'only 400' else 'only 200' end as side
    from (select * from k where within = 200) a full join (select * from k where within = 400) b on a.members = b.members where a.members is null or b.members is null""", True)
def clustering_difference(spark, d):
    """Clusters (as member sets, keyed by digest) in one of two clusterings but not in the other."""
    from geoledger.plans.library import components

    keys = lambda w: components(spark, d, w).groupBy("component").agg(member_digest("node").alias("members"), F.count("*").alias("n"))
    a, b = keys(200), keys(400)
    only = lambda l, r, side: l.join(r, ["members", "n"], "left_anti").select("component", "n", F.lit(side).alias("side"))
    return only(a, b, "only 200").union(only(b, a, "only 400"))


@query("closest_pairs_with_owners", ["building", "parcel"], f""", p as (select a.id as id_a, b.id as id_b, a.parcel_id as pa, b.parcel_id as pb, {_D2} as d2, row_number() over (partition by a.id order by {_D2}, b.id) as k from building a join building b on a.id <> b.id and {_D2} <= 160000),
    u as (select distinct least(id_a, id_b) as id_a, greatest(id_a, id_b) as id_b, d2, case when id_a < id_b then pa else pb end as pa, case when id_a < id_b then pb else pa end as pb from p where k = 1)
    select id_a, id_b, sqrt(d2) as distance, x.owner as owner_a, y.owner as owner_b from u left join parcel x on x.id = pa left join parcel y on y.id = pb""")
def closest_pairs(spark, d):
    b = view(spark, d, "building")
    half = self_pairs(b.select(*_BOX), 400)
    best = half.union(half.select("id_b", "id_a", "d2")).groupBy("id_a").agg(F.min(F.struct("d2", "id_b")).alias("t")).select("id_a", "t.id_b", "t.d2")
    best = best.select(F.least("id_a", "id_b").alias("id_a"), F.greatest("id_a", "id_b").alias("id_b"), "d2").distinct()
    own = b.select("id", "parcel_id").join(view(spark, d, "parcel").select(F.col("id").alias("parcel_id"), "owner"), "parcel_id", "left").select("id", "owner")
    return best.join(own.toDF("id_a", "owner_a"), "id_a").join(own.toDF("id_b", "owner_b"), "id_b").select("id_a", "id_b", F.sqrt("d2").alias("distance"), "owner_a", "owner_b")


@query("parcels_sharing_number", ["parcel"], " select number, count(*) as n, min(id) as first_id, string_agg(distinct owner, '; ' order by owner) as owners from parcel where owner <> '' group by number having count(*) > 1")
def sharing(spark, d):
    g = view(spark, d, "parcel").where("owner <> ''").groupBy("number").agg(F.count("*").alias("n"), F.min("id").alias("first_id"), F.array_join(F.sort_array(F.collect_set("owner")), "; ").alias("owners"))
    return g.where("n > 1")


@query("cluster_bridges", ["building"], f""", e as (select a.id as u, b.id as v from building a join building b on a.id < b.id and not a.excluded and not b.excluded and {_D2} <= 160000),
    s as (select u, v from e union all select v, u from e), reach(u, v, node) as (select u, v, u from e union select r.u, r.v, s.v from reach r join s on s.u = r.node and not (r.u = s.u and r.v = s.v) and not (r.u = s.v and r.v = s.u))
    select u, v from e where not exists (select 1 from reach r where r.u = e.u and r.v = e.v and r.node = e.v)""", True)
def cluster_bridges(spark, d):
    """Edges of the 400 m graph that alone hold their cluster together."""
    kept = view(spark, d, "building").where("not excluded").select(*_BOX)
    return bridges(self_pairs(kept, 400).select(F.col("id_a").alias("u"), F.col("id_b").alias("v"))).select("u", "v")
