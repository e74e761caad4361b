"""Joins and attributes on polygons of any form: parcels, counties, masks, hulls and facilities as multipolygons."""

from __future__ import annotations

from pyspark.sql import functions as F

from geoledger.operators import polygons as pg
from geoledger.operators.components import connected_components
from geoledger.operators.storage import materialize
from geoledger.plans.library import _CC, _CONFIRMED, _V, components, query, sites
from geoledger.sources.views import DISTRICT, SHAPES, edges_sql, shapes, view, with_views

#: SQL: whether edges e of one shape hold the point (x, y), as an aggregate over them.
_HOLDS = f"(bool_or({pg.on_edge('e', 'p.x', 'p.y')}) or count(case when {pg.crosses_ray('e', 'p.x', 'p.y')} then 1 end) % 2 = 1)"


def _with(names: list[str], shape_names: list[str], sql: str, recursive: bool = False) -> str:
    """SQL over views and the edges of shape views."""
    bases = list(dict.fromkeys([*names, *(SHAPES[s][0] for s in shape_names)]))
    return with_views(bases, "".join(f", {edges_sql(s)}" for s in shape_names) + sql, recursive)


def shape_query(name: str, names: list[str], shape_names: list[str], sql: str, recursive: bool = False):
    return query(name, [], _with(names, shape_names, sql, recursive))


def _box(of: str) -> str:
    return f"select id, min(least(x1, x2)) as xmin, max(greatest(x1, x2)) as xmax, min(least(y1, y2)) as ymin, max(greatest(y1, y2)) as ymax from {of}_edge group by id"


def _parcel_sql(x: str, y: str) -> str:
    return f"""select permit, min(parcel) as parcel from (select p.id as permit, b.id as parcel from (select id, cast({x} as double) as x, cast({y} as double) as y from permit where {x} is not null) p
        join ({_box('parcel')}) b on p.x between b.xmin and b.xmax and p.y between b.ymin and b.ymax join parcel_edge e on e.id = b.id group by p.id, b.id having {_HOLDS}) group by permit"""


def parcel_of_point(spark, d: str, x: str, y: str):
    """(permit, parcel): the lowest id of the parcels that hold the point."""
    p = view(spark, d, "permit").selectExpr("id", f"{x} as x", f"{y} as y")
    return pg.points_in(p, shapes(spark, d, "parcel_shape"), 600).groupBy(F.col("point").alias("permit")).agg(F.min("shape").alias("parcel"))


@shape_query("permit_parcel_polygons", ["permit"], ["parcel_shape"], f""", reg as ({_parcel_sql('rx', 'ry')}), geo as ({_parcel_sql('gx', 'gy')})
    select p.id as permit, reg.parcel as registered, geo.parcel as geocoded from permit p left join reg on reg.permit = p.id left join geo on geo.permit = p.id""")
def permit_parcels(spark, d):
    """Parcels of both points of every permit, by point in polygon."""
    reg, geo = parcel_of_point(spark, d, "rx", "ry"), parcel_of_point(spark, d, "gx", "gy")
    p = view(spark, d, "permit").select(F.col("id").alias("permit"))
    return p.join(reg.withColumnRenamed("parcel", "registered"), "permit", "left").join(geo.withColumnRenamed("parcel", "geocoded"), "permit", "left")


def _near_sql(a: str, b: str, within: int, where: str = "true") -> str:
    """(l, r, d2) of two shape views: least distance of edges, or one's first corner inside the other."""
    first = lambda of: f"select id, ring, min_by(x1, i) as x, min_by(y1, i) as y from (select *, row_number() over (partition by id, ring) as i from {of}_edge) group by id, ring"
    near = f"l.xmin <= r.xmax + {within} and r.xmin <= l.xmax + {within} and l.ymin <= r.ymax + {within} and r.ymin <= l.ymax + {within} and {where}"
    pairs = f"select l.id as l, r.id as r from ({_box(a)}) l join ({_box(b)}) r on {near}"
    held = lambda of, other, x, y: f"select c.l, c.r, 0e0 as d2 from c join ({first(of)}) p on p.id = c.{x} join {other}_edge e on e.id = c.{y} group by c.l, c.r, p.ring, p.x, p.y having {_HOLDS}"
    return f"""with c as materialized ({pairs}), m as (select c.l, c.r, min({pg.segment_d2('f', 'e')}) as d2 from c join {a}_edge f on f.id = c.l join {b}_edge e on e.id = c.r group by c.l, c.r
        union all {held(a, b, 'l', 'r')} union all {held(b, a, 'r', 'l')}) select l, r, min(d2) as d2 from m group by l, r having min(d2) <= {within * within}"""


@shape_query("buildings_on_parcel_polygons", [], ["building_shape", "parcel_shape"], f" select l as building, count(*) as parcels, min(r) as first_parcel, case when count(*) = 1 then max(r) end as only_parcel from ({_near_sql('building', 'parcel', 0)}) group by l")
def on_parcels(spark, d):
    """Parcels that a building meets: how many, the lowest, and the only one."""
    got = pg.near_shapes(shapes(spark, d, "building_shape"), shapes(spark, d, "parcel_shape"), 0, 600).groupBy(F.col("l").alias("building"))
    return got.agg(F.count("*").alias("parcels"), F.min("r").alias("first_parcel"), F.when(F.count("*") == 1, F.max("r")).alias("only_parcel"))


@shape_query("permit_county_polygons", ["permit", "county"], ["county_shape"], f""", p as (select id, cast(rx % {DISTRICT} as double) as x, cast(ry as double) as y from permit),
    h as (select p.id, b.id as county from p join ({_box('county')}) b on p.x between b.xmin and b.xmax and p.y between b.ymin and b.ymax join county_edge e on e.id = b.id group by p.id, b.id having {_HOLDS}),
    one as (select id, min(county) as county from h group by id)
    select p.id, one.county, c.name, one.county is null as unmatched from p left join one using (id) left join county c on c.id = one.county""")
def permit_counties(spark, d):
    """The county of every permit by point in polygon; on a border the lowest id; those outside are marked."""
    p = view(spark, d, "permit").selectExpr("id", f"rx % {DISTRICT} as x", "ry as y")
    one = pg.points_in(p, shapes(spark, d, "county_shape"), 4000, few=True).groupBy(F.col("point").alias("id")).agg(F.min("shape").alias("county"))
    names = view(spark, d, "county").select(F.col("id").alias("county"), "name")
    return p.select("id").join(one, "id", "left").join(names, "county", "left").select("id", "county", "name", F.col("county").isNull().alias("unmatched"))


@shape_query("polygon_distance_edges", [], ["building_shape"], f" select l as id_a, r as id_b, round(sqrt(d2), 6) as distance from ({_near_sql('building', 'building', 300, 'l.id <> r.id')})")
def distance_edges(spark, d):
    """Both directions of all pairs of buildings at most 300 m apart, by polygon."""
    b = shapes(spark, d, "building_shape")
    return pg.near_shapes(b, b, 300).where("l <> r").select(F.col("l").alias("id_a"), F.col("r").alias("id_b"), F.expr("round(sqrt(d2), 6) as distance"))


_POINTS = "select id, cast(rx as double) as x, cast(ry as double) as y from permit union all select id, cast(gx as double), cast(gy as double) from permit where gx is not null"


@shape_query("site_permits_by_polygon", _V, ["building_shape"], _CONFIRMED + f""", q as ({_POINTS}), b as ({_box('building')}),
    c as (select b.id, q.id as permit, q.x, q.y from b join site using (id) join q on q.x between b.xmin - 400 and b.xmax + 400 and q.y between b.ymin - 400 and b.ymax + 400),
    m as (select p.id as site, p.permit, case when {_HOLDS} then 0e0 else min({pg.point_segment_d2('p.x', 'p.y', 'e')}) end as d2 from c p join building_edge e on e.id = p.id group by p.id, p.permit, p.x, p.y)
    select site, permit, round(sqrt(min(d2)), 6) as distance from m group by site, permit having min(d2) <= 160000""")
def site_permits(spark, d):
    """Sites and permits one of whose points is at most 400 m from the site's polygon, inclusive."""
    place = lambda x, y: view(spark, d, "permit").where(f"{x} is not null").selectExpr("id", f"array(array(array(named_struct('x', double({x}), 'y', double({y}))))) as polys")
    b = materialize(shapes(spark, d, "building_shape").join(sites(spark, d).select("id").hint("merge"), "id", "left_semi"), "site-shapes")
    near = lambda x, y: materialize(pg.near_shapes(b, place(x, y), 400), "site-permits")  # noqa: E731  one after the other, which keeps the driver's plans small
    both = near("rx", "ry").union(near("gx", "gy"))
    return both.groupBy(F.col("l").alias("site"), F.col("r").alias("permit")).agg(F.expr("round(sqrt(min(d2)), 6) as distance"))


def _shared_sql(a: str, b: str, where: str = "true") -> str:
    """(l, r, shared) of two shape views whose boxes meet: signed areas below both of two edges."""
    lo, hi = "greatest(least(f.x1, f.x2), least(e.x1, e.x2))", "least(greatest(f.x1, f.x2), greatest(e.x1, e.x2))"
    return f"""select c.l, c.r, greatest(0, sum(sign(f.x1 - f.x2) * sign(e.x1 - e.x2) * {pg.area_below_both('f', 'e', lo, hi, 'c.base')})) as shared
        from (select l.id as l, r.id as r, least(l.ymin, r.ymin) as base from ({_box(a)}) l join ({_box(b)}) r on l.xmin <= r.xmax and r.xmin <= l.xmax and l.ymin <= r.ymax and r.ymin <= l.ymax and {where}) c
        join {a}_edge f on f.id = c.l and f.x1 <> f.x2 join {b}_edge e on e.id = c.r and e.x1 <> e.x2 where {lo} < {hi} group by c.l, c.r"""


_MEASURES = """select id, sum(t) / 2 as area, min(ox) + sum(t * (x1 + x2 - 2 * ox)) / (3 * sum(t)) as cx, min(oy) + sum(t * (y1 + y2 - 2 * oy)) / (3 * sum(t)) as cy
    from (select *, (x1 - ox) * (y2 - oy) - (x2 - ox) * (y1 - oy) as t from (select *, min(x1) over (partition by id) as ox, min(y1) over (partition by id) as oy from {}_edge)) group by id"""


@shape_query("polygon_measures", [], ["building_shape"], f" select id, area, round(cx, 6) as cx, round(cy, 6) as cy from ({_MEASURES.format('building')})")
def polygon_measures(spark, d):
    """Area and centroid of buildings with their courts left out."""
    return pg.measures(shapes(spark, d, "building_shape")).selectExpr("id", "area", "round(cx, 6) as cx", "round(cy, 6) as cy")


@shape_query("polygon_overlap_exclusion", [], ["building_shape"], f""", s as ({_shared_sql('building', 'building', 'l.id <> r.id')}), m as ({_MEASURES.format('building')})
    select s.l as id, min(s.r) as covered_by from s join m a on a.id = s.l join m b on b.id = s.r where s.shared > 0.9 * a.area and (a.area < b.area or (a.area = b.area and s.l > s.r)) group by s.l""")
def overlap_exclusion(spark, d):
    """Buildings over nine tenths of whose area lies in a larger one (of equal ones, in one with a lower id)."""
    b = shapes(spark, d, "building_shape")
    area = pg.measures(b)
    size = lambda x: area.select(F.col("id").alias(x), F.col("area").alias(f"a{x}"))
    got = pg.shared_area(b, b, 200).where("l <> r and shared > 0").join(size("l"), "l").join(size("r"), "r")
    return got.where("shared > 0.9D * al and (al < ar or (al = ar and l > r))").groupBy(F.col("l").alias("id")).agg(F.min("r").alias("covered_by"))


@shape_query("tiles_under_mask_polygons", [], ["tile_shape", "mask_shape"], f""", s as ({_shared_sql('tile', 'mask')}), c as (select l as id, sum(shared) / (2002e0 * 2002e0) as share, max(shared) >= 2002e0 * 2002e0 * (1 - {pg.EPS}) as within from s where shared > 0.001 group by l)
    select t.id, round(c.share, 9) as share, c.within, c.share > 0.7 as mostly, case when c.within then null else t.bucket end as bucket from c join tile t using (id)""")
def under_mask(spark, d):
    """Tiles that masks cover in part: the share, whether one holds the tile, and the bucket with such tiles removed."""
    tiles, masks = shapes(spark, d, "tile_shape"), shapes(spark, d, "mask_shape")
    met = pg.shared_area(tiles, masks, 2002, few=True).where("shared > 0.001").join(pg.measures(tiles).select(F.col("id").alias("l"), "area"), "l")
    c = met.groupBy(F.col("l").alias("id")).agg(F.expr("sum(shared) / any_value(area) as share"), F.expr(f"bool_or(shared >= area * (1 - {pg.EPS})) as within"))
    out = c.join(view(spark, d, "tile").select("id", "bucket"), "id")
    return out.selectExpr("id", "round(share, 9) as share", "within", "share > 0.7 as mostly", "if(within, null, bucket) as bucket")


_CORNERS = "select {0} as key, cast(xmin as double) as x, cast(ymin as double) as y from {1} union select {0}, xmax, ymin from {1} union select {0}, xmax, ymax from {1} union select {0}, xmin, ymax from {1}"
#: SQL: edges p -> q of the hulls of k(key, x, y): no point is right of them, and none beyond their ends on their line.
_HULL = """hull as (select p.key, p.x as x1, p.y as y1, q.x as x2, q.y as y2 from k p join k q on p.key = q.key and (p.x <> q.x or p.y <> q.y)
    where not exists (select 1 from k r where r.key = p.key and ((q.x - p.x) * (r.y - p.y) - (q.y - p.y) * (r.x - p.x) < 0
        or ((q.x - p.x) * (r.y - p.y) = (q.y - p.y) * (r.x - p.x) and ((r.x - p.x) * (q.x - p.x) + (r.y - p.y) * (q.y - p.y) < 0 or (r.x - q.x) * (q.x - p.x) + (r.y - q.y) * (q.y - p.y) > 0)))))"""


def corners(df, key: str):
    """(key, x, y): the corners of boxes."""
    return df.select(F.col(key).alias("key"), F.explode(F.expr("array(struct(xmin as x, ymin as y), struct(xmax as x, ymin as y), struct(xmax as x, ymax as y), struct(xmin as x, ymax as y))")).alias("p")).select("key", "p.x", "p.y")


@query("parcel_number_hulls", ["parcel"], f""", k as ({_CORNERS.format('number', 'parcel')}), {_HULL}
    select key as number, count(*) as vertices, sum((x1 - ox) * (y2 - oy) - (x2 - ox) * (y1 - oy)) / 2 as area from (select *, min(x1) over (partition by key) as ox, min(y1) over (partition by key) as oy from hull) group by key""")
def number_hulls(spark, d):
    """Convex hull of all places known for a parcel number: corners and area."""
    h = pg.hulls(corners(view(spark, d, "parcel"), "number"))
    return h.join(pg.measures(h), "id").select(F.col("id").alias("number"), F.expr("cast(size(polys[0][0]) as bigint) as vertices"), "area")


@query("parcel_points_within_hull", ["parcel"], " select number, count(*) as points, count(*) as within, true as valid from (select distinct number, cast(xmin as double) as x, cast(ymin as double) as y from parcel) group by number")
def points_within_hull(spark, d):
    """Of each parcel number the points, and those at most 5 m from the hull of all its points: the hull with a margin holds every one."""
    p = view(spark, d, "parcel").selectExpr("number as key", "double(xmin) as x", "double(ymin) as y").distinct()
    h = materialize(pg.hulls(p), "hulls")  # read several times below
    own = p.selectExpr("struct(key, x, y) as id", "array(array(array(struct(x, y)))) as polys")
    held = pg.near_shapes(own, h, 5).where("l.key = r").select(F.col("l.key").alias("key"), F.col("l").alias("held")).groupBy("key").agg(F.count_distinct("held").alias("within"))
    out = p.groupBy("key").agg(F.count("*").alias("points")).join(held, "key", "left")
    return out.select(F.col("key").alias("number"), "points", F.coalesce("within", F.lit(0)).alias("within"), (F.col("points") == F.coalesce("within", F.lit(0))).alias("valid"))


_FACILITY = """, cc as (select node, min(root) as component from reach group by node), fb as (select cc.component, b.* from cc join building b on b.id = cc.node)"""


def facility_boxes(spark, d: str):
    """Boxes of buildings with their component, written once."""
    cc = materialize(components(spark, d), "facility-parts")
    return view(spark, d, "building").join(cc.withColumnRenamed("node", "id"), "id")


@query("label_points_in_hulls", ["building", "label_point"], _CC + _FACILITY + f""", k as ({_CORNERS.format('component', 'fb')}), {_HULL},
    box as (select key, min(x1) as xmin, max(x1) as xmax, min(y1) as ymin, max(y1) as ymax from hull group by key),
    hit as (select p.id, b.key from label_point p join box b on p.x between b.xmin and b.xmax and p.y between b.ymin and b.ymax
        where not exists (select 1 from hull h where h.key = b.key and (h.x2 - h.x1) * (p.y - h.y1) - (h.y2 - h.y1) * (p.x - h.x1) < 0)),
    n as (select id, count(*) as n, min(key) as key from hit group by id)
    select p.id, case when n.n is null then 'missing' when n.n = 1 then 'matched' else 'ambiguous' end as outcome, case when n.n = 1 then n.key end as facility, coalesce(n.n, 0) as hulls from label_point p left join n using (id)""", True)
def label_points(spark, d):
    """Label points in the hulls of facilities: matched by exactly one, ambiguous, or missing."""
    h = pg.hulls(corners(facility_boxes(spark, d), "component"))
    p = view(spark, d, "label_point")
    n = pg.points_in(p, h, 500).groupBy(F.col("point").alias("id")).agg(F.count("*").alias("hulls"), F.min("shape").alias("key"))
    out = p.select("id").join(n, "id", "left").withColumn("hulls", F.coalesce("hulls", F.lit(0)))
    return out.selectExpr("id", "case when hulls = 0 then 'missing' when hulls = 1 then 'matched' else 'ambiguous' end as outcome", "if(hulls = 1, key, null) as facility", "hulls")


def facility_shapes(spark, d: str, parts=None):
    """``(facility, buildings, parts, polys, hash, buildings_ids)``: facilities as multipolygons.

    A facility is a component of buildings; its polygons stand in order of building id, and ``hash`` is the MD5 of their
    text in a fixed order, so that it doesn't depend on how they were found. ``parts`` counts the groups of mutually
    intersecting polygons (components inside the facility). A facility's polygons are gathered in its row. ``parts(node,
    component)`` are the facilities where they are known and written already.
    """
    cc = materialize(components(spark, d), "facility-parts") if parts is None else parts
    b = shapes(spark, d, "building_shape", "not excluded")
    own = b.join(cc.withColumnRenamed("node", "id").hint("merge"), "id")
    inside = lambda x: cc.select(F.col("node").alias(x), F.col("component").alias(f"f{x}")).hint("merge")
    met = pg.near_shapes(b, b, 0, 200).where("l < r").join(inside("l"), "l").join(inside("r"), "r").where("fl = fr")
    groups = connected_components(met.select(F.col("l").alias("u"), F.col("r").alias("v"))).withColumnRenamed("node", "id").withColumnRenamed("component", "part")
    own = own.join(groups.hint("merge"), "id", "left").withColumn("part", F.coalesce("part", "id"))
    out = own.groupBy(F.col("component").alias("facility")).agg(
        F.count("*").alias("buildings"), F.count_distinct("part").alias("parts"), F.sort_array(F.collect_list(F.struct("id", "polys"))).alias("all"),
    )
    out = out.select("facility", "buildings", "parts", F.expr("flatten(transform(all, b -> b.polys)) as polys"), F.expr("transform(all, b -> b.id) as building_ids"))
    return out.withColumn("hash", F.md5(F.expr(pg.wkt(pg.canonical("polys")))))


def _ring_sql(ring: list[tuple[str, str]], start: int) -> str:
    corner = lambda p: f"cast(cast({p[0]} as decimal(18, 3)) as varchar) || ' ' || cast(cast({p[1]} as decimal(18, 3)) as varchar)"
    return "'(' || " + " || ', ' || ".join(corner(p) for p in [*ring[start:], *ring[:start], ring[start]]) + " || ')'"


_WKT = "'(' || " + " || ', ' || ".join(_ring_sql(r, 0) for r in SHAPES["building_shape"][2]) + " || ')'"


@shape_query("facility_multipolygons", ["building"], ["building_shape"], _CC + f""", cc as (select node, min(root) as component from reach group by node),
    meet(u, v) as (select n.l, n.r from ({_near_sql('building', 'building', 0, 'l.id <> r.id')}) n join cc a on a.node = n.l join cc b on b.node = n.r and b.component = a.component),
    part(node, root) as (select node, node from cc union select m.v, p.root from part p join meet m on m.u = p.node),
    parts as (select node, min(root) as part from part group by node),
    w as (select id, x, y, {_WKT} as text from (select id, {', '.join(f'{e} as {c}' for c, e in SHAPES['building_shape'][1].items())} from building))
    select cc.component as facility, count(*) as buildings, count(distinct parts.part) as parts,
      md5('MULTIPOLYGON (' || string_agg(w.text, ', ' order by w.x, w.y, w.id) || ')') as hash from cc join parts using (node) join w on w.id = cc.node group by cc.component""", True)
def facility_multipolygons(spark, d):
    """Facilities as multipolygons, by the digest of their text."""
    return facility_shapes(spark, d).select("facility", "buildings", "parts", "hash")
