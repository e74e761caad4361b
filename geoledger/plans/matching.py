"""Permits, parcels, tiles and masks matched to sites, and attributes of clusters."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window as W, functions as F

from geoledger.operators.components import member_digest
from geoledger.operators.spatial import boxes_of_points, grid_join, nearest
from geoledger.operators.storage import materialize
from geoledger.plans.library import _CC, _CONFIRMED, _V, _point, components, query, site_permits, sites
from geoledger.sources.views import county_of, view

_BOX = ["id", "xmin", "ymin", "xmax", "ymax"]
_IN = "p.{0} >= c.xmin and p.{0} <= c.xmax and p.{1} >= c.ymin and p.{1} <= c.ymax"
_REG, _GEO = _point("rx", "ry"), f"(case when p.gx is not null then {_point('gx', 'gy')} end)"  # SQL takes greatest() of a null as 0


def points(spark, d: str, x: str, y: str) -> DataFrame:
    return boxes_of_points(view(spark, d, "permit"), x, y).select(*_BOX)


def parcel_of(spark, d: str, x: str, y: str) -> DataFrame:
    """(permit, parcel): the parcel with the lowest id that holds the point."""
    got = grid_join(points(spark, d, x, y), view(spark, d, "parcel").select(*_BOX), 0, 600)
    return got.groupBy(F.col("l.id").alias("permit")).agg(F.min("r.id").alias("parcel"))


_PARCELS = f""", reg as (select p.id as permit, min(c.id) as parcel from permit p join parcel c on {_IN.format('rx', 'ry')} group by p.id),
    geo as (select p.id as permit, min(c.id) as parcel from permit p join parcel c on {_IN.format('gx', 'gy')} group by p.id)"""


@query("permit_parcels", ["permit", "parcel"], _PARCELS + " select p.id as permit, reg.parcel as registered, geo.parcel as geocoded from permit p left join reg on reg.permit = p.id left join geo on geo.permit = p.id")
def permit_parcels(spark, d):
    p = view(spark, d, "permit").select(F.col("id").alias("permit"))
    reg, geo = parcel_of(spark, d, "rx", "ry"), parcel_of(spark, d, "gx", "gy")
    return p.join(reg.withColumnRenamed("parcel", "registered"), "permit", "left").join(geo.withColumnRenamed("parcel", "geocoded"), "permit", "left")


_MEETS = "a.xmin <= c.xmax and c.xmin <= a.xmax and a.ymin <= c.ymax and c.ymin <= a.ymax"


@query("buildings_on_parcels", ["building", "parcel"], f" select a.id as building, count(*) as parcels, min(c.id) as first_parcel, case when count(*) = 1 then max(c.id) end as only_parcel from building a join parcel c on {_MEETS} group by a.id")
def on_parcels(spark, d):
    got = grid_join(view(spark, d, "building").select(*_BOX), view(spark, d, "parcel").select(*_BOX), 0, 600).groupBy(F.col("l.id").alias("building"))
    return got.agg(F.count("*").alias("parcels"), F.min("r.id").alias("first_parcel"), F.when(F.count("*") == 1, F.max("r.id")).alias("only_parcel"))


_COVERED = "greatest(0, least(t.xmax, m.xmax) - greatest(t.xmin, m.xmin)) * greatest(0, least(t.ymax, m.ymax) - greatest(t.ymin, m.ymin))"
_MASKED = f""", cover as (select t.id, sum({_COVERED}) / cast(any_value((t.xmax - t.xmin) * (t.ymax - t.ymin)) as double) as share,
    bool_or(t.xmin >= m.xmin and t.xmax <= m.xmax and t.ymin >= m.ymin and t.ymax <= m.ymax) as within from tile t join urban_mask m on {_COVERED} > 0 group by t.id)"""


def mask_cover(spark, d: str) -> DataFrame:
    """(id, share, within) of tiles that a mask covers in part; masks are disjoint."""
    got = grid_join(view(spark, d, "tile").select(*_BOX), view(spark, d, "urban_mask"), 0, 2002, few=True)
    t = got.select(F.col("l").alias("t"), F.col("r").alias("m")).where(f"{_COVERED} > 0").groupBy("t.id")
    area = "any_value((t.xmax - t.xmin) * (t.ymax - t.ymin))"
    return t.agg(F.expr(f"sum({_COVERED}) / {area} as share"), F.expr("bool_or(t.xmin >= m.xmin and t.xmax <= m.xmax and t.ymin >= m.ymin and t.ymax <= m.ymax) as within"))


@query("tiles_under_mask", ["tile", "urban_mask"], _MASKED + " select t.id, c.share, c.within, case when c.within then null else t.bucket end as bucket from tile t join cover c using (id)")
def under_mask(spark, d):
    return view(spark, d, "tile").select("id", "bucket").join(mask_cover(spark, d), "id").select("id", "share", "within", F.expr("case when within then null else bucket end as bucket"))


@query("mostly_masked_positive_tiles", ["tile", "urban_mask", "tile_annotation"], _MASKED + " select c.id, c.share from cover c where share > 0.7 and exists (select 1 from tile_annotation a where a.tile_id = c.id and a.label = 'purchase')")
def mostly_masked(spark, d):
    pos = view(spark, d, "tile_annotation").where("label = 'purchase'").select(F.col("tile_id").alias("id"))
    return mask_cover(spark, d).where("share > 0.7").join(pos, "id", "left_semi").select("id", "share")


_NEAREST = f""", n as (select p.id as permit, f.id as site, {_REG} as d2, pow(p.rx - (f.xmin + f.xmax) / 2.0, 2) + pow(p.ry - (f.ymin + f.ymax) / 2.0, 2) as c2,
    row_number() over (partition by p.id order by {_REG}, f.id) as k from permit p, site f)"""


def nearest_site(spark, d: str, pts: DataFrame) -> DataFrame:
    """(permit, site, d2, c2): nearest by polygon; c2 is the squared distance to that site's centre."""
    s = sites(spark, d).select(*_BOX)
    near = nearest(pts, s, 1000).toDF("permit", "site", "d2")
    at = pts.select(F.col("id").alias("permit"), F.col("xmin").alias("x"), F.col("ymin").alias("y"))
    boxed = near.join(s.withColumnRenamed("id", "site").hint("merge"), "site").join(at.hint("merge"), "permit")
    return boxed.selectExpr("permit", "site", "d2", "pow(x - (xmin + xmax) / 2.0D, 2) + pow(y - (ymin + ymax) / 2.0D, 2) as c2")


@query("nearest_facility", _V, _CONFIRMED + _NEAREST + " select permit, site, sqrt(d2) as distance, c2 < 1000000 as accepted from n where k = 1")
def nearest_facility(spark, d):
    return nearest_site(spark, d, points(spark, d, "rx", "ry")).select("permit", "site", F.sqrt("d2").alias("distance"), (F.col("c2") < 1000000).alias("accepted"))


@query("k_nearest_permits", _V, _CONFIRMED + f", n as (select f.id as site, p.id as permit, {_REG} as d2, row_number() over (partition by f.id order by {_REG}, p.id) as k from site f join permit p on {_REG} <= 4000000) select site, permit, sqrt(d2) as distance, k from n where k <= 500")
def k_nearest(spark, d, most: int = 500):
    """Up to ``most`` nearest permits of each site within 2000 m."""
    got = grid_join(sites(spark, d).select(*_BOX), points(spark, d, "rx", "ry"), 2000).select(F.col("l.id").alias("site"), F.col("r.id").alias("permit"), "d2")
    k = F.row_number().over(W.partitionBy("site").orderBy("d2", "permit"))
    return got.withColumn("k", k).where(F.col("k") <= most).select("site", "permit", F.sqrt("d2").alias("distance"), F.col("k").cast("long").alias("k"))


@query("staged_match", _V, _CONFIRMED + _NEAREST + f""", t1 as (select p.id as permit, f.id as site, 1 as tier from permit p join site f on f.id = p.id where p.status = 'Historical'),
    t2 as (select p.id as permit, min(f.id) as site, 2 as tier from permit p join site f on {_REG} = 0 where p.id not in (select permit from t1) group by p.id),
    t3 as (select permit, site, 3 as tier from n where k = 1 and c2 < 1000000 and permit not in (select permit from t1) and permit not in (select permit from t2))
    select * from t1 union all select * from t2 union all select * from t3""")
def staged(spark, d):
    """Key equality, then point in polygon, then the gated nearest; each tier sees what the last left."""
    s, pts = sites(spark, d).select(*_BOX), points(spark, d, "rx", "ry")
    old = view(spark, d, "permit").where("status = 'Historical'").select("id")
    t1 = old.join(s, "id", "left_semi").select(F.col("id").alias("permit"), F.col("id").alias("site"), F.lit(1).alias("tier"))
    left = pts.join(t1.select(F.col("permit").alias("id")), "id", "left_anti")
    t2 = grid_join(left, s, 0, 200).groupBy(F.col("l.id").alias("permit")).agg(F.min("r.id").alias("site"), F.lit(2).alias("tier"))
    left = left.join(t2.select(F.col("permit").alias("id")), "id", "left_anti")
    t3 = nearest_site(spark, d, left).where("c2 < 1000000").select("permit", "site", F.lit(3).alias("tier"))
    return reduce(DataFrame.union, [t1, t2, t3])


_BEST = _PARCELS + f""", both_parcels as (select reg.permit, min(f.id) as site from reg join geo on reg.permit = geo.permit and reg.parcel = geo.parcel join site f on f.parcel_id = reg.parcel group by reg.permit),
    both_points as (select p.id as permit, max(f.id) as site from permit p join site f on {_REG} <= 40000 and {_GEO} <= 40000 group by p.id having count(*) = 1)"""


def by_parcels(spark, d: str) -> DataFrame:
    both = parcel_of(spark, d, "rx", "ry").join(parcel_of(spark, d, "gx", "gy"), ["permit", "parcel"])
    return both.join(sites(spark, d).select(F.col("id").alias("site"), F.col("parcel_id").alias("parcel")), "parcel").groupBy("permit").agg(F.min("site").alias("site"))


def within(spark, d: str, x: str, y: str, reach: int) -> DataFrame:
    got = grid_join(points(spark, d, x, y), sites(spark, d).select(*_BOX), reach)
    return got.select(F.col("l.id").alias("permit"), F.col("r.id").alias("site"))


def by_points(spark, d: str, reach: int = 200) -> DataFrame:
    both = within(spark, d, "rx", "ry", reach).join(within(spark, d, "gx", "gy", reach), ["permit", "site"])
    return both.groupBy("permit").agg(F.count("*").alias("n"), F.max("site").alias("site")).where("n = 1").select("permit", "site")


@query("permit_match_by_parcels", [*_V, "parcel"], _CONFIRMED + _BEST + " select permit, site from both_parcels")
def match_parcels(spark, d):
    return by_parcels(spark, d)


@query("permit_match_by_points", [*_V, "parcel"], _CONFIRMED + _BEST + " select permit, site from both_points")
def match_points(spark, d):
    return by_points(spark, d)


@query("best_permits", [*_V, "parcel"], _CONFIRMED + _BEST + " select permit, site, 'parcel' as source from both_parcels union all select permit, site, 'points' from both_points where permit not in (select permit from both_parcels)")
def best_permits(spark, d):
    a = by_parcels(spark, d)
    return a.withColumn("source", F.lit("parcel")).union(by_points(spark, d).join(a, "permit", "left_anti").withColumn("source", F.lit("points")))


@query("closest_unless_tied", _V, _CONFIRMED + f""", n as (select p.id as permit, f.id as site, sqrt({_REG}) as d, row_number() over (partition by p.id order by {_REG}, f.id) as k from permit p join site f on {_REG} <= 1000000),
    w as (select *, lead(d) over (partition by permit order by k) - d as gap from n) select permit, site, d as distance, coalesce(gap >= 20, true) as resolved from w where k = 1""")
def closest_unless_tied(spark, d):
    got = grid_join(points(spark, d, "rx", "ry"), sites(spark, d).select(*_BOX), 1000).select(F.col("l.id").alias("permit"), F.col("r.id").alias("site"), F.sqrt("d2").alias("d"))
    w = W.partitionBy("permit").orderBy("d", "site")
    ranked = got.withColumns({"k": F.row_number().over(w), "gap": F.lead("d").over(w) - F.col("d")}).where("k = 1")
    return ranked.select("permit", "site", F.col("d").alias("distance"), F.coalesce(F.col("gap") >= 20, F.lit(True)).alias("resolved"))


@query("match_set_algebra", _V, _CONFIRMED + f""", x as (select p.id as permit, f.id as site, {_REG} <= 250000 as reg, coalesce({_GEO} <= 250000, false) as geo from permit p, site f),
    u as (select * from x where reg or geo) select permit, site, reg and geo as in_both, count(*) over (partition by site) = 1 as lone_site, count(*) over (partition by permit) = 1 as lone_permit from u""")
def set_algebra(spark, d):
    """Union of two key-to-set maps in long form, with intersection and uniqueness in each direction."""
    mark = lambda df, c: df.withColumn(c, F.lit(1))
    both = mark(within(spark, d, "rx", "ry", 500), "reg").join(mark(within(spark, d, "gx", "gy", 500), "geo"), ["permit", "site"], "full")
    lone = lambda c: F.count("*").over(W.partitionBy(c)) == 1
    return both.select("permit", "site", F.expr("reg is not null and geo is not null").alias("in_both"), lone("site").alias("lone_site"), lone("permit").alias("lone_permit"))


@query("permit_distance_bridge", _V, _CONFIRMED + f", x as (select f.id as site, p.id as permit, least({_REG}, coalesce({_GEO}, 1e18)) as d2 from site f, permit p) select site, permit, sqrt(d2) as distance from x where d2 <= 1000000")
def distance_bridge(spark, d):
    return site_permits(spark, d).select("site", "permit", F.sqrt("d2").alias("distance"))


@query("tiles_with_permit", ["tile", "permit"], f" select c.id from tile c where exists (select 1 from permit p where {_IN.format('rx', 'ry')})")
def tiles_with_permit(spark, d):
    got = grid_join(points(spark, d, "rx", "ry"), view(spark, d, "tile").select(*_BOX), 0, 2002)
    return got.select(F.col("r.id").alias("id")).distinct()


@query("permits_with_two_locations", ["permit"], " select id, cast(abs(gx - rx) as bigint) as apart from permit where sqrt(pow(gx - rx, 2) + pow(gy - ry, 2)) > 100")
def two_locations(spark, d):
    return view(spark, d, "permit").where("sqrt(pow(gx - rx, 2) + pow(gy - ry, 2)) > 100").select("id", F.expr("cast(abs(gx - rx) as bigint)").alias("apart"))


_COMP = _CC + ", c as (select node, min(root) as component from reach group by node)"


@query("lone_cluster_nearest", ["building"], _COMP + """, lone as (select min(node) as id from c group by component having count(*) = 1),
    n as (select a.id, b.id as other, pow(greatest(0, a.xmin - b.xmax, b.xmin - a.xmax), 2) + pow(greatest(0, a.ymin - b.ymax, b.ymin - a.ymax), 2) as d2 from building a join lone using (id), building b where a.id <> b.id and not b.excluded)
    select id, other, sqrt(d2) as distance from (select *, row_number() over (partition by id order by d2, other) as k from n) where k = 1""", True)
def lone_nearest(spark, d):
    b = view(spark, d, "building").where("not excluded").select(*_BOX)
    lone = components(spark, d).groupBy("component").agg(F.count("*").alias("n"), F.min("node").alias("id")).where("n = 1").select("id")
    return nearest(materialize(b.join(lone, "id", "left_semi"), "lone"), b, 1000, "l.id <> r.id").select("id", "other", F.sqrt("d2").alias("distance"))


_XC = county_of("(b.xmin + b.xmax) / 2.0", "(b.ymin + b.ymax) / 2.0")


@query("cluster_counties", ["building"], _COMP + f""", v as (select component, {_XC} as county, count(*) as n from c join building b on b.id = c.node group by 1, 2)
    select component, county, n, tied from (select *, row_number() over (partition by component order by n desc, county) as k, count(*) over (partition by component, n) > 1 as tied from v) where k = 1""", True)
def cluster_counties(spark, d):
    """County by majority of a cluster's buildings, ties flagged and given to the lowest id."""
    b = view(spark, d, "building").alias("b").select(F.col("id").alias("node"), F.expr(_XC).alias("county"))
    votes = components(spark, d).join(b, "node").groupBy("component", "county").agg(F.count("*").alias("n"))
    best = votes.withColumn("k", F.row_number().over(W.partitionBy("component").orderBy(F.desc("n"), "county")))
    return best.withColumn("tied", F.count("*").over(W.partitionBy("component", "n")) > 1).where("k = 1").select("component", "county", "n", "tied")


@query("cluster_extents", ["building"], _COMP + """ select component, count(*) as buildings, min(b.xmin) as xmin, min(b.ymin) as ymin, max(b.xmax) as xmax, max(b.ymax) as ymax,
    sum((b.xmax - b.xmin) * (b.ymax - b.ymin) * (b.xmin + b.xmax) / 2.0) / sum((b.xmax - b.xmin) * (b.ymax - b.ymin)) as cx, cast(sum((b.xmax - b.xmin) * (b.ymax - b.ymin)) as bigint) as area,
    md5(concat_ws(':', cast(sum(cast('0x' || substr(md5(cast(b.id as varchar)), 1, 15) as bigint)) as varchar), cast(sum(cast('0x' || substr(md5(cast(b.id as varchar)), 17, 15) as bigint)) as varchar))) as hash from c join building b on b.id = c.node group by component""", True)
def cluster_extents(spark, d):
    """Assembled entities: extent, area, area-weighted centre and an order-free digest of the members."""
    b = view(spark, d, "building").withColumn("area", F.expr("(xmax - xmin) * (ymax - ymin)")).withColumnRenamed("id", "node")
    g = components(spark, d).join(b, "node").groupBy("component")
    return g.agg(
        F.count("*").alias("buildings"), F.min("xmin").alias("xmin"), F.min("ymin").alias("ymin"), F.max("xmax").alias("xmax"), F.max("ymax").alias("ymax"),
        F.expr("sum(area * (xmin + xmax) / 2.0D) / sum(area) as cx"), F.sum("area").alias("area"), member_digest("node").alias("hash"),
    )


_TYPES = """, last as (select building_id, max(annotated) as annotated from type_annotation group by 1),
    t as (select a.building_id, string_agg(distinct a.animal_type, ',' order by a.animal_type) as types, count(distinct a.animal_type) as n from type_annotation a join last using (building_id, annotated) group by 1),
    near as (select b.id, bool_and(contains(p.program, 'ECONOMY')) as cow from building b join permit p on p.id = b.parcel_id group by b.id)"""


@query("animal_types", ["building", "type_annotation", "permit"], _TYPES + """ select b.id, coalesce(t.types, case when near.cow then 'cattle' else '' end) as types,
    case when t.n = 1 then t.types when t.types = 'cattle,dairy' then 'dairy' when t.n is null and near.cow then 'cattle' else 'two or more' end as animal_type,
    case when t.n is not null then 'annotation' when near.cow then 'permit' end as source from building b left join t on t.building_id = b.id left join near using (id)""")
def animal_types(spark, d):
    """Labels of the latest annotation, else cattle when every permit of the parcel is of that program."""
    a = view(spark, d, "type_annotation")
    last = a.groupBy("building_id").agg(F.max("annotated").alias("annotated"))
    t = a.join(last, ["building_id", "annotated"]).groupBy(F.col("building_id").alias("id")).agg(F.sort_array(F.collect_set("animal_type")).alias("set"))
    p = view(spark, d, "permit").select(F.col("id").alias("parcel_id"), F.contains("program", F.lit("ECONOMY")).alias("cow"))
    b = view(spark, d, "building").select("id", "parcel_id")
    near = b.join(p, "parcel_id").groupBy("id").agg(F.bool_and("cow").alias("cow"))
    out = b.select("id").join(t, "id", "left").join(near, "id", "left").withColumn("types", F.array_join("set", ","))
    return out.selectExpr(
        "id", "coalesce(types, case when cow then 'cattle' else '' end) as types",
        "case when size(set) = 1 then types when types = 'cattle,dairy' then 'dairy' when set is null and cow then 'cattle' else 'two or more' end as animal_type",
        "case when set is not null then 'annotation' when cow then 'permit' end as source",
    )


@query("type_set_distribution", ["type_annotation"], ", s as (select building_id, string_agg(distinct animal_type, ', ' order by animal_type) as types from type_annotation group by 1) select types, count(*) as n from s group by types")
def type_sets(spark, d):
    s = view(spark, d, "type_annotation").groupBy("building_id").agg(F.array_join(F.sort_array(F.collect_set("animal_type")), ", ").alias("types"))
    return s.groupBy("types").agg(F.count("*").alias("n"))


@query("latest_construction", ["construction_annotation"], " select building_id, max_by(built, annotated) as built, arg_max_null(destroyed, annotated) as destroyed, count(*) as n from construction_annotation group by building_id")
def latest_construction(spark, d):
    return view(spark, d, "construction_annotation").groupBy("building_id").agg(F.max_by("built", "annotated").alias("built"), F.max_by("destroyed", "annotated").alias("destroyed"), F.count("*").alias("n"))


@query("construction_stock", ["construction_annotation"], """, y as (select cast(unnest(range(1995, 2021)) as int) as year), k as (select building_id, min(built) as built, max(destroyed) as gone from construction_annotation group by 1)
    select year, count(case when built <= year and (gone is null or gone > year) then 1 end) as standing, count(case when built = year then 1 end) as built, count(case when gone = year then 1 end) as gone from y, k group by year""")
def stock(spark, d):
    """Stock by year from +1/-1 events and a running sum over the year spine; no range join.

    What happened before the spine is in its first year's stock.
    """
    k = view(spark, d, "construction_annotation").groupBy("building_id").agg(F.min("built").alias("built"), F.max("destroyed").alias("gone"))
    ev = k.select(F.explode(F.array(F.struct(F.col("built").alias("year"), F.lit(1).alias("up"), F.lit(0).alias("down")), F.struct(F.col("gone").alias("year"), F.lit(0).alias("up"), F.lit(1).alias("down")))).alias("e"))
    per = ev.select("e.*").where("year is not null").groupBy("year").agg(F.sum("up").alias("built"), F.sum("down").alias("gone"))
    return _standing(spark, k.select(F.col("built").alias("first"), F.col("gone").alias("until")), "standing").join(per, "year", "left").na.fill(0).select("year", "standing", "built", "gone")


def _standing(spark, spans, name):
    """(year, name) of the spine: how many of ``spans(first, until)`` have first <= year < until; no ``until`` is for ever."""
    at = lambda c, n: F.struct(F.when(F.col(c).isNotNull(), F.greatest(F.col(c), F.lit(1995))).alias("year"), F.lit(n).alias("n"))
    ev = spans.where("first is not null and (until is null or until > first)").select(F.explode(F.array(at("first", 1), at("until", -1))).alias("e"))
    per = ev.select("e.*").where("year is not null").groupBy("year").agg(F.sum("n").alias("n"))
    y = spark.range(1995, 2021).select(F.col("id").cast("int").alias("year")).join(per, "year", "left").na.fill(0)
    return y.select("year", F.sum("n").over(W.orderBy("year")).alias(name))


@query("construction_stock_bounds", ["construction_annotation"], """, y as (select cast(unnest(range(1995, 2021)) as int) as year),
    k as (select building_id, min(built) as b0, max(built) as b1, min(destroyed) as g0, max(destroyed) as g1 from construction_annotation group by 1)
    select year, count(case when (b1 <= year or b0 is null) and (g0 >= year or g0 is null) then 1 end) as strict, count(case when (b0 <= year or b0 is null) and (g1 >= year or g1 is null) then 1 end) as loose from y, k group by year""")
def stock_bounds(spark, d):
    """Buildings that stood in a year for certain (latest building, earliest loss) and possibly (the other way round)."""
    k = view(spark, d, "construction_annotation").groupBy("building_id").agg(F.min("built").alias("b0"), F.max("built").alias("b1"), F.min("destroyed").alias("g0"), F.max("destroyed").alias("g1"))
    spans = lambda built, gone: k.selectExpr(f"coalesce({built}, 0) as first", f"{gone} + 1 as until")
    return _standing(spark, spans("b1", "g0"), "strict").join(_standing(spark, spans("b0", "g1"), "loose"), "year")
