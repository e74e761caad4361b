"""Named queries over footprints, permits, tiles, annotations and ratings, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from geoledger.operators.components import connected_components
from geoledger.operators.spatial import boxes_of_points, grid_join, self_pairs
from geoledger.operators.storage import materialize
from geoledger.sources.views import county_of, view, with_views

QUERIES: dict = {}
ORACLES: dict = {}

#: SQL: squared distance of boxes a and b, and of a box f and a point.
_D2 = "(pow(greatest(0, a.xmin - b.xmax, b.xmin - a.xmax), 2) + pow(greatest(0, a.ymin - b.ymax, b.ymin - a.ymax), 2))"


def _point(x: str, y: str) -> str:
    return f"(pow(greatest(0, f.xmin - p.{x}, p.{x} - f.xmax), 2) + pow(greatest(0, f.ymin - p.{y}, p.{y} - f.ymax), 2))"


_NEAR = f"({_point('rx', 'ry')} <= 1000000 or (p.gx is not null and {_point('gx', 'gy')} <= 1000000))"
#: Confirmed sites: every label true or no label, and not known to be gone by the end of 2017.
_CONFIRMED = """, site as (select b.* from building b where not b.excluded and b.id >= 0
    and not exists (select 1 from cafo_annotation c where c.building_id = b.id and not c.is_cafo)
    and not exists (select building_id from construction_annotation k where k.building_id = b.id group by building_id having max(k.destroyed) <= 2017))"""
_V = ["building", "cafo_annotation", "construction_annotation", "permit"]


def query(name: str, views: list[str] | None = None, sql: str | None = None, recursive: bool = False):
    def keep(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = with_views(views, sql, recursive)
        return f

    return keep


def sites(spark, d: str) -> DataFrame:
    """Two anti joins on aggregated keys; the fan-out of labels times dates never arises."""
    labels = view(spark, d, "cafo_annotation").where("not is_cafo").select(F.col("building_id").alias("id"))
    gone = view(spark, d, "construction_annotation").groupBy(F.col("building_id").alias("id")).agg(F.max("destroyed").alias("destroyed")).where("destroyed <= 2017")
    return view(spark, d, "building").where("not excluded and id >= 0").join(labels, "id", "left_anti").join(gone, "id", "left_anti")


def permit_points(permits: DataFrame) -> DataFrame:
    """Both candidate points of each permit as rows, so that an OR becomes an equi join."""
    cols = ["id", "status", "population"]
    registered = boxes_of_points(permits, "rx", "ry").select(*cols, "xmin", "xmax", "ymin", "ymax", F.lit("registered").alias("point"))
    geocoded = boxes_of_points(permits, "gx", "gy").select(*cols, "xmin", "xmax", "ymin", "ymax", F.lit("geocoded").alias("point"))
    return registered.union(geocoded)


def site_permits(spark, d: str, within: int = 1000, which: str = "true") -> DataFrame:
    """(site, permit, d2): smallest squared distance of each pair within reach."""
    found = grid_join(sites(spark, d).select("id", "xmin", "ymin", "xmax", "ymax"), permit_points(view(spark, d, "permit").where(which)), within)
    return found.groupBy(F.col("l.id").alias("site"), F.col("r.id").alias("permit")).agg(F.min("d2").alias("d2"))


@query("confirmed_facilities", _V, _CONFIRMED + " select id, parcel_id, xmin, ymin, xmax, ymax from site")
def confirmed(spark, d):
    return sites(spark, d).select("id", "parcel_id", "xmin", "ymin", "xmax", "ymax")


@query("permitted_facilities", _V, _CONFIRMED + f" select id from site f where exists (select 1 from permit p where {_NEAR})")
def permitted(spark, d):
    near = site_permits(spark, d).select(F.col("site").alias("id")).distinct()
    return sites(spark, d).join(near, "id", "left_semi").select("id")


@query("unpermitted_facilities", _V, _CONFIRMED + f" select id from site f where not exists (select 1 from permit p where {_NEAR})")
def unpermitted(spark, d):
    return sites(spark, d).join(site_permits(spark, d).select(F.col("site").alias("id")), "id", "left_anti").select("id")


@query("permitted_active_only", _V, _CONFIRMED + f" select id from site f where exists (select 1 from permit p where p.status = 'Active' and {_NEAR})")
def permitted_active(spark, d):
    return sites(spark, d).join(site_permits(spark, d, which="status = 'Active'").select(F.col("site").alias("id")), "id", "left_semi").select("id")


@query("historical_only_facilities", _V, _CONFIRMED + f" select id from site f where exists (select 1 from permit p where p.status = 'Historical' and {_NEAR}) and not exists (select 1 from permit p where p.status = 'Active' and {_NEAR})")
def historical_only(spark, d):
    near = lambda s: site_permits(spark, d, which=f"status = '{s}'").select(F.col("site").alias("id"))
    return sites(spark, d).join(near("Historical"), "id", "left_semi").join(near("Active"), "id", "left_anti").select("id")


@query("permits_without_facility", _V, _CONFIRMED + f" select id, status, population from permit p where not exists (select 1 from site f where {_NEAR})")
def permits_without(spark, d):
    return view(spark, d, "permit").join(site_permits(spark, d).select(F.col("permit").alias("id")), "id", "left_anti").select("id", "status", "population")


@query("permits_with_facility", _V, _CONFIRMED + f" select id, status, population from permit p where exists (select 1 from site f where {_NEAR})")
def permits_with(spark, d):
    return view(spark, d, "permit").join(site_permits(spark, d).select(F.col("permit").alias("id")), "id", "left_semi").select("id", "status", "population")


@query("facility_expanded_permits", _V, _CONFIRMED + f" select f.id as site, count(p.id) as n_permits, coalesce(min(p.id), -1) as first_permit from site f left join permit p on {_NEAR} group by f.id")
def expanded(spark, d):
    near = site_permits(spark, d).groupBy(F.col("site").alias("id")).agg(F.count("*").alias("n_permits"), F.min("permit").alias("first_permit"))
    out = sites(spark, d).select("id").join(near, "id", "left")
    return out.select(F.col("id").alias("site"), F.coalesce("n_permits", F.lit(0)).alias("n_permits"), F.coalesce("first_permit", F.lit(-1)).alias("first_permit"))


_COUNTY = county_of("(xmin + xmax) / 2.0", "(ymin + ymax) / 2.0")


@query(
    "facilities_by_county", [*_V, "county"],
    _CONFIRMED + f""", f2 as (select {_COUNTY} as county, exists (select 1 from permit p where {_NEAR}) as permitted from site f)
    select c.name, c.county_group, count(f2.county) as total, count(case when f2.permitted then 1 end) as permitted, count(case when not f2.permitted then 1 end) as unpermitted
    from county c left join f2 on f2.county = c.id group by c.name, c.county_group""",
)
def by_county(spark, d):
    near = site_permits(spark, d).select(F.col("site").alias("id")).distinct().withColumn("permitted", F.lit(True))
    f = sites(spark, d).withColumn("county", F.expr(_COUNTY)).join(near, "id", "left").groupBy("county")
    f = f.agg(F.count("*").alias("total"), F.count_if("permitted").alias("permitted"))
    zero = lambda c: F.coalesce(c, F.lit(0))
    out = view(spark, d, "county").join(f, F.col("id") == F.col("county"), "left")
    return out.select("name", "county_group", zero("total").alias("total"), zero("permitted").alias("permitted"), (zero("total") - zero("permitted")).alias("unpermitted"))


@query("building_distance_edges", ["building"], f" select a.id as id_a, b.id as id_b, 1000 - cast(floor(sqrt({_D2})) as bigint) as weight from building a join building b on a.id <> b.id and {_D2} <= 1000000")
def distance_edges(spark, d):
    half = self_pairs(view(spark, d, "building").select("id", "xmin", "ymin", "xmax", "ymax"), 1000)
    weight = (1000 - F.floor(F.sqrt("d2"))).alias("weight")
    return half.select("id_a", "id_b", weight).union(half.select("id_b", "id_a", weight))


@query("matching_parcel_edges", ["building"], " select a.id as id_a, b.id as id_b, cast(1000 as bigint) as weight from building a join building b on a.parcel_id = b.parcel_id and a.id <> b.id")
def parcel_edges(spark, d):
    b = view(spark, d, "building").where("parcel_id is not null").select("id", "parcel_id")
    pairs = b.toDF("id_a", "parcel_id").join(b.toDF("id_b", "parcel_id"), "parcel_id").where("id_a <> id_b")
    return pairs.select("id_a", "id_b", F.lit(1000).cast("long").alias("weight"))


_CC = f""", edge as (select a.id as u, b.id as v from building a join building b on a.id <> b.id and not a.excluded and not b.excluded and {_D2} <= 160000),
    reach(node, root) as (select id, id from building where not excluded union select e.v, r.root from reach r join edge e on e.u = r.node)"""


def components(spark, d: str, within: int = 400) -> DataFrame:
    """(node, component) of every building that is not excluded; lone ones are their own."""
    kept = view(spark, d, "building").where("not excluded").select("id", "xmin", "ymin", "xmax", "ymax")
    found = connected_components(self_pairs(kept, within).select(F.col("id_a").alias("u"), F.col("id_b").alias("v")))
    return kept.select(F.col("id").alias("node")).join(found.hint("merge"), "node", "left").withColumn("component", F.coalesce("component", "node"))


@query("building_components", ["building"], _CC + " select node, min(root) as component from reach group by node", True)
def building_components(spark, d):
    return components(spark, d)


@query("component_sizes", ["building"], _CC + ", c as (select node, min(root) as component from reach group by node), s as (select component, count(*) as n from c group by component) select n, count(*) as components from s group by n", True)
def component_sizes(spark, d):
    return components(spark, d).groupBy("component").agg(F.count("*").alias("n")).groupBy("n").agg(F.count("*").alias("components"))


@query("nearest_other_building", ["building"], f""", p as (select a.id as id_a, b.id as id_b, {_D2} as d2 from building a join building b on a.id <> b.id and {_D2} <= 1000000)
    select id_a, id_b, sqrt(d2) as distance from (select *, row_number() over (partition by id_a order by d2, id_b) as k from p) where k = 1""")
def nearest_other(spark, d):
    half = self_pairs(view(spark, d, "building").select("id", "xmin", "ymin", "xmax", "ymax"), 1000)
    both = half.union(half.select("id_b", "id_a", "d2")).groupBy("id_a").agg(F.min(F.struct("d2", "id_b")).alias("best"))
    return both.select("id_a", "best.id_b", F.sqrt("best.d2").alias("distance"))


_SHARED = "greatest(0, least(a.xmax, b.xmax) - greatest(a.xmin, b.xmin)) * greatest(0, least(a.ymax, b.ymax) - greatest(a.ymin, b.ymin))"
_AREA = "(({0}.xmax - {0}.xmin) * ({0}.ymax - {0}.ymin))"


@query("overlap_exclusion", ["building"], f""" select a.id, min(b.id) as covered_by from building a join building b on a.id <> b.id and {_SHARED} > 0.9 * {_AREA.format('a')}
    and ({_AREA.format('a')} < {_AREA.format('b')} or ({_AREA.format('a')} = {_AREA.format('b')} and a.id > b.id)) group by a.id""")
def overlap_exclusion(spark, d):
    b = view(spark, d, "building").select("id", "xmin", "ymin", "xmax", "ymax")
    pairs = grid_join(b, b, 0, 200).where("l.id <> r.id").select(F.col("l").alias("a"), F.col("r").alias("b"))
    smaller = f"{_SHARED} > 0.9 * {_AREA.format('a')} and ({_AREA.format('a')} < {_AREA.format('b')} or ({_AREA.format('a')} = {_AREA.format('b')} and a.id > b.id))"
    return pairs.where(smaller).groupBy("a.id").agg(F.min("b.id").alias("covered_by"))




@query("permit_sensitivity", _V, _CONFIRMED + f""", n as (select f.id, min(least({_point('rx', 'ry')}, case when p.gx is null then 1e18 else {_point('gx', 'gy')} end)) as d2 from site f, permit p group by f.id)
    select cast(k * 50 as bigint) as reach, count(case when n.d2 <= k * 50.0 * k * 50.0 then 1 end) as permitted from range(0, 21) t(k), n group by k""")
def permit_sensitivity(spark, d):
    closest = site_permits(spark, d).groupBy("site").agg(F.min("d2").alias("d2"))
    steps = closest.groupBy(F.ceil(F.sqrt("d2") / 50).cast("long").alias("k")).agg(F.count("*").alias("n"))
    spine = spark.range(0, 21).select(F.col("id").alias("k")).join(steps, "k", "left")
    return spine.select((F.col("k") * 50).alias("reach"), F.coalesce(F.sum("n").over(W.orderBy("k")), F.lit(0)).alias("permitted"))


_ADJ = "a.id <> b.id and a.xmin <= b.xmax and b.xmin <= a.xmax and a.ymin <= b.ymax and b.ymin <= a.ymax"
_EX_ANTE = "bucket is not null and bucket not in ('0', '1')"


@query("ex_ante_tiles", ["tile"], f" select id, bucket from tile where {_EX_ANTE}")
def ex_ante(spark, d):
    return view(spark, d, "tile").where(_EX_ANTE).select("id", "bucket")


@query("adjacent_tiles", ["tile"], f" select a.id, b.id as neighbour from tile a join tile b on {_ADJ} where b.bucket is not null and a.bucket = 'ex ante permit'")
def adjacent(spark, d):
    t = view(spark, d, "tile")
    got = grid_join(t.where("bucket = 'ex ante permit'"), t.where("bucket is not null"), 0, 2002).where("l.id <> r.id")
    return got.select("l.id", F.col("r.id").alias("neighbour"))


@query("initially_labeled_tiles", ["tile"], f" select id from tile where {_EX_ANTE} union select b.id from tile a join tile b on {_ADJ} where b.bucket is not null and a.bucket = 'ex ante permit'")
def initially_labeled(spark, d):
    return ex_ante(spark, d).select("id").union(adjacent(spark, d).select("neighbour")).distinct()


@query("unlabeled_tiles", ["tile", "tile_annotation"], " select id from tile t where not exists (select 1 from tile_annotation a where a.tile_id = t.id)")
def unlabeled(spark, d):
    return view(spark, d, "tile").join(view(spark, d, "tile_annotation").select(F.col("tile_id").alias("id")), "id", "left_anti").select("id")


_STRATA = """, s as (select coalesce(t.bucket, 'removed') as bucket, t.id, count(a.tile_id) > 0 as labeled, coalesce(bool_or(a.label = 'purchase'), false) as positive
    from tile t left join tile_annotation a on a.tile_id = t.id group by 1, 2),
    c as (select bucket, count(*) as n, count(case when labeled then 1 end) as labeled, count(case when positive then 1 end) as positive from s group by bucket)"""


def strata(spark, d: str) -> DataFrame:
    a = view(spark, d, "tile_annotation").groupBy(F.col("tile_id").alias("id")).agg(F.bool_or(F.col("label") == "purchase").alias("positive"))
    s = view(spark, d, "tile").join(a, "id", "left").groupBy(F.coalesce("bucket", F.lit("removed")).alias("bucket"))
    return s.agg(F.count("*").alias("n"), F.count("positive").alias("labeled"), F.count_if("positive").alias("positive"))


@query("strata_counts", ["tile", "tile_annotation"], _STRATA + " select * from c")
def strata_counts(spark, d):
    return strata(spark, d)


_Z = 1.959963984540054


@query("prevalence_wilson", ["tile", "tile_annotation"], _STRATA + f""", p as (select bucket, n, labeled, positive, positive / cast(labeled as double) as p from c where labeled > 0)
    select bucket, p as prevalence, (p + {_Z * _Z} / (2 * labeled) - {_Z} * sqrt(p * (1 - p) / labeled + {_Z * _Z} / (4.0 * labeled * labeled))) / (1 + {_Z * _Z} / labeled) as lower,
    (p + {_Z * _Z} / (2 * labeled) + {_Z} * sqrt(p * (1 - p) / labeled + {_Z * _Z} / (4.0 * labeled * labeled))) / (1 + {_Z * _Z} / labeled) as upper, p * (n - labeled) + positive as population from p""")
def wilson(spark, d):
    s = strata(spark, d).where("labeled > 0").withColumn("p", F.col("positive") / F.col("labeled"))
    half = f"{_Z}D * sqrt(p * (1 - p) / labeled + {_Z * _Z}D / (4.0D * labeled * labeled))"
    mid, scale = f"p + {_Z * _Z}D / (2 * labeled)", f"(1 + {_Z * _Z}D / labeled)"
    return s.selectExpr("bucket", "p as prevalence", f"({mid} - {half}) / {scale} as lower", f"({mid} + {half}) / {scale} as upper", "p * (n - labeled) + positive as population")


_KAPPA = "case when pe = 1 then 1.0 else (po - pe) / (1 - pe) end"
_TABLE = "count(*) as n, count(case when a and b then 1 end) as both_true, count(case when not a and not b then 1 end) as both_false, count(case when a then 1 end) as a_true, count(case when b then 1 end) as b_true"
_SHARES = "(both_true + both_false) / cast(n as double) as po, (cast(a_true as double) * b_true + cast(n - a_true as double) * (n - b_true)) / (cast(n as double) * n) as pe"


@query("rater_agreement", ["rating"], f", t as (select {_TABLE} from rating), s as (select *, {_SHARES} from t) select n, both_true, both_false, n - both_true - both_false as disagree, po as agreement, {_KAPPA} as kappa from s where n > 0")
def agreement(spark, d):
    t = view(spark, d, "rating").agg(*[F.expr(x) for x in _TABLE.split(", ")]).where("n > 0").selectExpr("*", *_SHARES.split(", "))
    return t.selectExpr("n", "both_true", "both_false", "n - both_true - both_false as disagree", "po as agreement", f"{_KAPPA} as kappa")


_HEAD = "count(*) as total, count(case when population >= 200 then 1 end) as large, count(case when population < 200 then 1 end) as small, count(case when status = 'Active' then 1 end) as active, count(case when status = 'Historical' then 1 end) as historical"


@query("permits_by_county", ["permit", "county"], f", p as (select *, {county_of('rx', 'ry')} as county from permit) select c.name, {_HEAD} from p join county c on c.id = p.county group by c.name")
def permits_by_county(spark, d):
    p = view(spark, d, "permit").withColumn("county", F.expr(county_of("rx", "ry")))
    p = p.groupBy("county").agg(*[F.expr(x) for x in _HEAD.split(", ")])
    return p.join(view(spark, d, "county").select(F.col("id").alias("county"), "name"), "county").drop("county")


@query("permitted_by_type_pivot", _V, _CONFIRMED + f""", f2 as (select animal_type, exists (select 1 from permit p where {_NEAR}) as permitted from site f)
    select case when grouping(animal_type) = 1 then 'Total' else animal_type end as animal_type, count(case when permitted then 1 end) as permitted, count(case when not permitted then 1 end) as unpermitted, count(*) as total from f2 group by rollup(animal_type)""")
def type_pivot(spark, d):
    near = site_permits(spark, d).select(F.col("site").alias("id")).distinct().withColumn("permitted", F.lit(True))
    f = sites(spark, d).join(near, "id", "left").select("animal_type", F.coalesce("permitted", F.lit(False)).alias("permitted"))
    out = f.rollup("animal_type").agg(F.grouping("animal_type").alias("g"), F.count_if("permitted").alias("permitted"), F.count_if(~F.col("permitted")).alias("unpermitted"), F.count("*").alias("total"))
    return out.withColumn("animal_type", F.when(F.col("g") == 1, "Total").otherwise(F.col("animal_type"))).drop("g")


@query("small_groups_folded", ["permit"], """, g as (select program, count(*) as n from permit group by program)
    select case when n < 4 then 'All other' else program end as program, cast(sum(n) as bigint) as n from g group by 1""")
def folded(spark, d):
    g = view(spark, d, "permit").groupBy("program").agg(F.count("*").alias("n"))
    return g.groupBy(F.when(F.col("n") < 4, "All other").otherwise(F.col("program")).alias("program")).agg(F.sum("n").alias("n"))




@query("latest_annotation", ["cafo_annotation"], """ select building_id, strftime(max(annotated_on), '%Y-%m-%d') as latest, count(*) as n, bool_and(is_cafo) as all_cafo, count(case when phase = 1 then 1 end) as second_phase from cafo_annotation group by building_id""")
def latest(spark, d):
    a = view(spark, d, "cafo_annotation").groupBy("building_id")
    return a.agg(F.date_format(F.max("annotated_on"), "yyyy-MM-dd").alias("latest"), F.count("*").alias("n"), F.bool_and("is_cafo").alias("all_cafo"), F.count_if(F.col("phase") == 1).alias("second_phase"))


@query("checks", [*_V, "tile", "tile_annotation"], _CONFIRMED + f""" select 'confirmed facilities' as name, count(*) as value from site
    union all select 'facilities without parcel', count(*) from site where parcel_id is null
    union all select 'permits without facility', count(*) from permit p where not exists (select 1 from site f where {_NEAR})
    union all select 'large permits without facility', count(*) from permit p where population > 200 and not exists (select 1 from site f where {_NEAR})
    union all select 'kept tiles without annotation', count(*) from tile t where bucket is not null and not exists (select 1 from tile_annotation a where a.tile_id = t.id)""")
def checks(spark, d):
    lost = materialize(permits_without(spark, d), "lost")
    one = lambda name, df: df.agg(F.count("*").alias("value")).select(F.lit(name).alias("name"), "value")
    s = materialize(sites(spark, d), "sites")
    parts = [
        one("confirmed facilities", s), one("facilities without parcel", s.where("parcel_id is null")), one("permits without facility", lost),
        one("large permits without facility", lost.where("population > 200")),
        one("kept tiles without annotation", unlabeled(spark, d).join(view(spark, d, "tile").where("bucket is not null").select("id"), "id", "left_semi")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out
