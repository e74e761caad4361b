"""Further checks, report tables and headline values; each reads whole views."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from geoledger.operators.spatial import grid_join
from geoledger.plans.estimates import _TILES, _TC, tile_status
from geoledger.plans.library import _ADJ, _CONFIRMED, _COUNTY, _EX_ANTE, _NEAR, _V, permits_without, query, site_permits, sites
from geoledger.plans.matching import _BEST, _MASKED, _TYPES, animal_types, best_permits, mask_cover
from geoledger.plans.reports import _BOX, _LOST, _ON, on_tile, positive_tiles
from geoledger.sources.views import DISTRICT, county_of, view

_MEET = "a.id <> b.id and a.xmin <= b.xmax and b.xmin <= a.xmax and a.ymin <= b.ymax and b.ymin <= a.ymax"
_COMMON = "(least({0}.xmax, {1}.xmax) - greatest({0}.xmin, {1}.xmin)) * (least({0}.ymax, {1}.ymax) - greatest({0}.ymin, {1}.ymin))"


def _ids(df: DataFrame, column: str, name: str = "id") -> DataFrame:
    return df.select(F.col(column).alias(name)).distinct()


def _listed(parts: list[tuple[str, DataFrame]]) -> DataFrame:
    """(name, value): the number of rows of each relation."""
    return reduce(DataFrame.union, [df.agg(F.count("*").alias("value")).select(F.lit(n).alias("name"), "value") for n, df in parts])


@query("facility_overlaps", _V, f"{_CONFIRMED} select a.id, b.id as other, {_COMMON.format('a', 'b')} as area from site a join site b on {_MEET}")
def facility_overlaps(spark, d):
    """Ordered pairs of confirmed sites whose boxes meet, with the common area."""
    s = sites(spark, d).select(*_BOX)
    return grid_join(s, s, 0, 500).where("l.id <> r.id").select("l.id", F.col("r.id").alias("other"), F.expr(_COMMON.format("l", "r")).alias("area"))


@query("parcel_overlaps", ["parcel"], f" select a.id, b.id as other, {_COMMON.format('a', 'b')} as area from parcel a join parcel b on {_MEET} and a.id < b.id")
def parcel_overlaps(spark, d):
    p = view(spark, d, "parcel").select(*_BOX)
    return grid_join(p, p, 0, 600).where("l.id < r.id").select("l.id", F.col("r.id").alias("other"), F.expr(_COMMON.format("l", "r")).alias("area"))


_KINDS = ["cafo_annotation", "type_annotation", "construction_annotation"]


@query("annotations_without_facility", [*_V, "type_annotation"], _CONFIRMED + " union all ".join(f" select '{k}' as name, count(*) as value from {k} where building_id not in (select id from site)" for k in _KINDS))
def annotations_without_facility(spark, d):
    s = _ids(sites(spark, d), "id", "building_id")
    return _listed([(k, view(spark, d, k).join(s, "building_id", "left_anti")) for k in _KINDS])


@query("facilities_dated_repeatedly", _V, _CONFIRMED + " select f.id, count(*) as dates from site f join construction_annotation k on k.building_id = f.id group by f.id having count(*) > 1")
def dated_repeatedly(spark, d):
    k = view(spark, d, "construction_annotation").groupBy(F.col("building_id").alias("id")).agg(F.count("*").alias("dates")).where("dates > 1")
    return k.join(sites(spark, d).select("id"), "id", "left_semi")


@query("facilities_by_best_permit", [*_V, "parcel"], _CONFIRMED + _BEST + """, best as (select permit, site from both_parcels union all select permit, site from both_points where permit not in (select permit from both_parcels)),
    t as (select id, id in (select site from best) as has from site) select has as has_best_permit, count(*) as facilities, count(*) / cast((select count(*) from site) as double) as share from t group by has""")
def by_best_permit(spark, d):
    """Confirmed sites with and without a best permit, and their shares."""
    best = _ids(best_permits(spark, d), "site").withColumn("has", F.lit(True))
    got = sites(spark, d).select("id").join(best, "id", "left").groupBy(F.coalesce("has", F.lit(False)).alias("has_best_permit")).agg(F.count("*").alias("facilities"))
    all_ = got.agg(F.sum("facilities").alias("n"))  # one row over at most two
    return got.join(F.broadcast(all_)).select("has_best_permit", "facilities", (F.col("facilities") / F.col("n")).alias("share"))


@query("kept_tiles_within_mask", ["tile", "urban_mask"], _MASKED + " select t.id, t.bucket from tile t join cover c using (id) where c.within and t.bucket is not null")
def kept_within(spark, d):
    return view(spark, d, "tile").where("bucket is not null").select("id", "bucket").join(mask_cover(spark, d).where("within").select("id"), "id", "left_semi")


@query("facilities_in_masked_tiles_only", [*_V, "tile", "tile_annotation", "urban_mask"], _CONFIRMED + _ON + _MASKED + " select o.site as id, count(*) as tiles from on_tile o left join cover c on c.id = o.tile group by o.site having bool_and(coalesce(c.share, 0) > 0.7)")
def masked_only(spark, d):
    c = mask_cover(spark, d).select(F.col("id").alias("tile"), "share")
    got = on_tile(spark, d).join(c, "tile", "left").groupBy(F.col("site").alias("id")).agg(F.count("*").alias("tiles"), F.bool_and(F.coalesce("share", F.lit(0.0)) > 0.7).alias("all"))
    return got.where("all").drop("all")


@query("masks_without_tile", ["tile", "urban_mask"], " select m.id from urban_mask m where not exists (select 1 from tile t where t.xmin >= m.xmin and t.xmax <= m.xmax and t.ymin >= m.ymin and t.ymax <= m.ymax)")
def masks_without_tile(spark, d):
    m = view(spark, d, "urban_mask").select(*_BOX)
    inside = grid_join(view(spark, d, "tile").select(*_BOX), m, 0, 2002, few=True).where("l.xmin >= r.xmin and l.xmax <= r.xmax and l.ymin >= r.ymin and l.ymax <= r.ymax")
    return m.select("id").join(inside.select(F.col("r.id").alias("id")), "id", "left_anti")


_IN_COUNTY = f"{{x}} % {DISTRICT} >= c.xmin and {{x}} % {DISTRICT} < c.xmin + 16020 and {{y}} >= c.ymin and {{y}} < c.ymin + 16020"


def located(points: DataFrame, counties: DataFrame, x: str, y: str) -> DataFrame:
    """Points left-joined to the county box that holds them: an equi join on the box's corner, since
    boxes are the cells of one grid. Points in no county keep null."""
    corner = lambda e: F.expr(f"cast(floor({e} / 16020) as bigint) * 16020")
    c = counties.select(F.col("xmin").alias("_cx"), F.col("ymin").alias("_cy"), F.col("name").alias("county"))
    return points.withColumn("_cx", corner(f"(({x}) % {DISTRICT})")).withColumn("_cy", corner(f"({y})")).join(c, ["_cx", "_cy"], "left").drop("_cx", "_cy")


@query("permit_counties", ["permit", "county"], f" select p.id, c.name as county from permit p left join county c on {_IN_COUNTY.format(x='p.rx', y='p.ry')}")
def permit_counties(spark, d):
    """Reverse geocoding of registered points by the counties' own boxes."""
    return located(view(spark, d, "permit"), view(spark, d, "county"), "rx", "ry").select("id", "county")


@query("buildings_without_county", ["building", "county"], f" select count(*) as buildings, count(case when c.id is null then 1 end) as without_county from building b left join county c on {_IN_COUNTY.format(x='((b.xmin + b.xmax) / 2.0)', y='((b.ymin + b.ymax) / 2.0)')}")
def without_county(spark, d):
    got = located(view(spark, d, "building"), view(spark, d, "county"), "(xmin + xmax) / 2.0D", "(ymin + ymax) / 2.0D")
    return got.agg(F.count("*").alias("buildings"), F.count_if(F.col("county").isNull()).alias("without_county"))


_AT = _TYPES + ", typed as (select b.id, case when t.n is not null then 'annotation' when near.cow then 'permit' else 'none' end as source from building b left join t on t.building_id = b.id left join near using (id))"


@query("type_source_counts", ["building", "type_annotation", "permit"], _AT + " select source, count(*) as buildings from typed group by source")
def type_sources(spark, d):
    return animal_types(spark, d).groupBy(F.coalesce("source", F.lit("none")).alias("source")).agg(F.count("*").alias("buildings"))


@query("typed_by_permit_only", ["building", "type_annotation", "permit"], _AT + " select id from typed where source = 'permit'")
def typed_by_permit(spark, d):
    return animal_types(spark, d).where("source = 'permit'").select("id")


_CLASS = "case when population is null then 'no count' when population < 200 then 'small' when population < 500 then 'medium' else 'large' end"


@query("permit_size_classes", ["permit"], f" select {_CLASS} as size_class, status, count(*) as permits, min(population) as least, max(population) as most from permit group by 1, 2")
def size_classes(spark, d):
    return view(spark, d, "permit").groupBy(F.expr(_CLASS).alias("size_class"), "status").agg(F.count("*").alias("permits"), F.min("population").alias("least"), F.max("population").alias("most"))


_PHASE = "bool_or(phase = 0 and not is_cafo) as typing, bool_or(phase = 1 and not is_cafo) as dating"
_SHARES = {"typing": "typing", "dating": "dating", "both": "typing and dating", "any": "typing or dating"}


@query("removal_shares", ["cafo_annotation"], f", r as (select building_id, {_PHASE} from cafo_annotation group by 1)" + " union all ".join(f" select '{n}' as name, count(case when {c} then 1 end) as removed, count(case when {c} then 1 end) / cast(count(*) as double) as share from r" for n, c in _SHARES.items()))
def removal_shares(spark, d):
    r = view(spark, d, "cafo_annotation").groupBy("building_id").agg(*[F.expr(x) for x in _PHASE.split(", ")])
    one = r.agg(F.count("*").alias("n"), *[F.count_if(F.expr(c)).alias(k) for k, c in _SHARES.items()])
    return one.unpivot(["n"], list(_SHARES), "name", "removed").select("name", "removed", (F.col("removed") / F.col("n")).alias("share"))


@query("facilities_without_parcel", _V, _CONFIRMED + f" select {_COUNTY} as county, count(*) as facilities, count(case when parcel_id is null then 1 end) as without_parcel from site group by 1")
def without_parcel(spark, d):
    return sites(spark, d).groupBy(F.expr(_COUNTY).alias("county")).agg(F.count("*").alias("facilities"), F.count_if(F.col("parcel_id").isNull()).alias("without_parcel"))


def _permits_by_place(spark, d: str) -> DataFrame:
    gone = permits_without(spark, d).select("id", F.lit(True).alias("lost"))
    p = view(spark, d, "permit").withColumn("county", F.expr(county_of("rx", "ry"))).join(gone, "id", "left").withColumn("lost", F.coalesce("lost", F.lit(False)))
    return p.join(view(spark, d, "county").select(F.col("id").alias("county"), "name"), "county")


_BY_FACILITY = "count(case when lost then 1 end) as without_facility, count(case when not lost then 1 end) as with_facility, count(case when lost and population >= 200 then 1 end) as large_without, count(case when population is null then 1 end) as no_count"


@query("permits_by_county_and_facility", [*_V, "county"], f"{_CONFIRMED}{_LOST} select c.name, {_BY_FACILITY} from lost l join county c on c.id = l.county group by c.name")
def by_facility(spark, d):
    return _permits_by_place(spark, d).groupBy("name").agg(*[F.expr(x) for x in _BY_FACILITY.split(", ")])


@query("permits_by_county_and_status", ["permit", "county"], f", p as (select *, {county_of('rx', 'ry')} as county from permit) select c.name, count(case when status = 'Active' then 1 end) as active, count(case when status = 'Historical' then 1 end) as historical, count(*) as total from p join county c on c.id = p.county group by rollup(c.name)")
def by_status(spark, d):
    p = view(spark, d, "permit").groupBy(F.expr(county_of("rx", "ry")).alias("county")).pivot("status", ["Active", "Historical"]).agg(F.count("id"))
    p = p.na.fill(0).join(view(spark, d, "county").select(F.col("id").alias("county"), "name"), "county")
    sums = [F.sum("Active").alias("active"), F.sum("Historical").alias("historical"), F.sum(F.expr("Active + Historical")).alias("total")]
    return p.rollup("name").agg(*sums)


@query("permitted_by_county_folded", [*_V, "county"], _CONFIRMED + f""", s as (select {_COUNTY} as county, exists (select 1 from permit p where {_NEAR}) as permitted from site f),
    g as (select c.name, count(*) as total, count(case when permitted then 1 end) as permitted from s join county c on c.id = s.county group by c.name)
    select case when total < 50 then 'All other' else name end as name, cast(sum(total) as bigint) as total, cast(sum(permitted) as bigint) as permitted, sum(permitted) / cast(sum(total) as double) as share from g group by 1""")
def permitted_folded(spark, d):
    near = _ids(site_permits(spark, d), "site").withColumn("permitted", F.lit(1))
    g = sites(spark, d).join(near, "id", "left").groupBy(F.expr(_COUNTY).alias("county")).agg(F.count("*").alias("total"), F.count("permitted").alias("permitted"))
    g = g.join(view(spark, d, "county").select(F.col("id").alias("county"), "name"), "county")
    out = g.groupBy(F.when(F.col("total") < 50, "All other").otherwise(F.col("name")).alias("name")).agg(F.sum("total").alias("total"), F.sum("permitted").alias("permitted"))
    return out.withColumn("share", F.col("permitted") / F.col("total"))


@query("permit_issues_by_county_and_program", [*_V, "county"], f"""{_CONFIRMED}{_LOST}, g as (select c.name, l.program, count(*) as total, count(case when lost then 1 end) as lost from lost l join county c on c.id = l.county group by 1, 2)
    select case when lost < 5 and total < 50 then 'All other' else name end as name, case when lost < 5 and total < 50 then 'All other' else program end as program, cast(sum(total) as bigint) as total, cast(sum(lost) as bigint) as lost from g group by 1, 2""")
def by_program_and_county(spark, d):
    g = _permits_by_place(spark, d).groupBy("name", "program").agg(F.count("*").alias("total"), F.count_if("lost").alias("lost"))
    fold = lambda c: F.when(F.expr("lost < 5 and total < 50"), "All other").otherwise(F.col(c)).alias(c)
    return g.groupBy(fold("name"), fold("program")).agg(F.sum("total").alias("total"), F.sum("lost").alias("lost"))


@query("ex_ante_positive_tiles", [*_V, "tile", "tile_annotation"], _CONFIRMED + _ON + f" select o.tile, o.site from on_tile o join tile t on t.id = o.tile where {_EX_ANTE.replace('bucket', 't.bucket')}")
def ex_ante_positive(spark, d):
    """One row for each pair of an ex-ante tile and a confirmed site on it."""
    return on_tile(spark, d).join(_ids(view(spark, d, "tile").where(_EX_ANTE), "id", "tile"), "tile", "left_semi").select("tile", "site")


@query("unlabeled_next_to_positive_tiles", [*_V, "tile", "tile_annotation"], _CONFIRMED + _ON + f""", e as (select distinct t.* from on_tile o join tile t on t.id = o.tile where {_EX_ANTE.replace('bucket', 't.bucket')})
    select distinct b.id from e a join tile b on {_ADJ} where b.bucket is not null and b.id not in (select tile_id from tile_annotation)""")
def unlabeled_next_to_positive(spark, d):
    t = view(spark, d, "tile")
    e = t.join(_ids(ex_ante_positive(spark, d), "tile"), "id", "left_semi")
    near = grid_join(e.select(*_BOX), t.where("bucket is not null").select(*_BOX), 0, 2002).where("l.id <> r.id").select(F.col("r.id").alias("id")).distinct()
    return near.join(_ids(view(spark, d, "tile_annotation"), "tile_id"), "id", "left_anti")


@query("missing_parts", [*_V, "type_annotation", "parcel"], _CONFIRMED + """ select 'permits without geocode' as name, count(*) as value from permit where gx is null
    union all select 'facilities without date', count(*) from site where id not in (select building_id from construction_annotation)
    union all select 'facilities without type', count(*) from site where id not in (select building_id from type_annotation)
    union all select 'facilities without known parcel', count(*) from site where parcel_id is null or parcel_id not in (select id from parcel)
    union all select 'parcels without facility', count(*) from parcel where id not in (select parcel_id from site where parcel_id is not null)""")
def missing_parts(spark, d):
    s = sites(spark, d).select("id", "parcel_id")
    parcels, used = _ids(view(spark, d, "parcel"), "id", "parcel_id"), _ids(s.where("parcel_id is not null"), "parcel_id", "parcel_id")
    without = lambda v: s.join(_ids(view(spark, d, v), "building_id"), "id", "left_anti")
    return _listed([
        ("permits without geocode", view(spark, d, "permit").where("gx is null")), ("facilities without date", without("construction_annotation")), ("facilities without type", without("type_annotation")),
        ("facilities without known parcel", s.join(parcels, "parcel_id", "left_anti")), ("parcels without facility", parcels.join(used, "parcel_id", "left_anti")),
    ])


@query("destroyed_before", ["construction_annotation"], " select building_id, max(destroyed) as destroyed from construction_annotation group by building_id having max(destroyed) < 2014")
def destroyed_before(spark, d):
    return view(spark, d, "construction_annotation").groupBy("building_id").agg(F.max("destroyed").alias("destroyed")).where("destroyed < 2014")


@query("permit_population_bins", ["permit"], " select cast(floor(population / 100) as bigint) as bin, count(*) as permits, avg(population) as mean from permit where population is not null group by 1")
def population_bins(spark, d):
    p = view(spark, d, "permit").where("population is not null")
    return p.groupBy(F.floor(F.col("population") / 100).alias("bin")).agg(F.count("*").alias("permits"), F.avg("population").alias("mean"))


@query("type_multisets", ["type_annotation"], ", s as (select building_id, string_agg(animal_type, ', ' order by animal_type) as types from type_annotation group by 1) select types, count(*) as n from s group by types")
def type_multisets(spark, d):
    """A building's labels with repeats, from counts by kind of label, so that no list of rows is gathered."""
    n = view(spark, d, "type_annotation").groupBy("building_id", "animal_type").agg(F.count("*").alias("n"))
    each = F.array_sort(F.collect_list(F.struct("animal_type", "n")))
    spread = F.flatten(F.transform(each, lambda x: F.array_repeat(x["animal_type"], x["n"].cast("int"))))
    return n.groupBy("building_id").agg(F.array_join(spread, ", ").alias("types")).groupBy("types").agg(F.count("*").alias("n"))


@query("largest_permits", ["permit"], " select id, program, population from permit order by population desc nulls last, program, id limit 20")
def largest_permits(spark, d):
    return view(spark, d, "permit").select("id", "program", "population").orderBy(F.col("population").desc_nulls_last(), "program", "id").limit(20)


@query("tile_set_overlaps", [*_V, "tile", "tile_annotation"], _CONFIRMED + _ON + """, tagged as (select distinct tile as id, 'positive' as part from on_tile where tile in (select tile from f3)
    union all select id, 'unlabeled' from tile where id not in (select tile_id from tile_annotation) union all select id, 'removed' from tile where bucket is null),
    k as (select id, count(*) as n from tagged group by id) select n as sets, count(*) as tiles from k group by n""")
def set_overlaps(spark, d):
    """In how many of the sets positive, unlabeled and removed tiles stand; 1 throughout if they are disjoint."""
    t = view(spark, d, "tile")
    unlabeled = t.select("id").join(_ids(view(spark, d, "tile_annotation"), "tile_id"), "id", "left_anti")
    tagged = positive_tiles(spark, d).union(unlabeled).union(t.where("bucket is null").select("id"))
    return tagged.groupBy("id").agg(F.count("*").alias("sets")).groupBy("sets").agg(F.count("*").alias("tiles"))


@query("facility_tile_ratio", [*_V, "tile", "tile_annotation"], _CONFIRMED + _ON + """ select (select count(distinct tile) from on_tile where tile in (select tile from f3)) / cast((select count(*) from site) as double) as tiles_per_facility,
    count(distinct site) / cast(count(distinct tile) as double) as facilities_per_tile from on_tile""")
def facility_tile_ratio(spark, d):
    """Two ratios of distinct counts; one row each."""
    pairs = on_tile(spark, d)
    count = lambda df, name: df.distinct().agg(F.count("*").alias(name))
    parts = [count(positive_tiles(spark, d), "p"), count(sites(spark, d).select("id"), "s"), count(pairs.select("site"), "f"), count(pairs.select("tile"), "t")]
    one = reduce(DataFrame.union, [p.unpivot([], p.columns, "k", "v") for p in parts]).groupBy().pivot("k", ["p", "s", "f", "t"]).agg(F.first("v"))
    return one.select((F.col("p") / F.col("s")).alias("tiles_per_facility"), (F.col("f") / F.col("t")).alias("facilities_per_tile"))


@query("facility_is_cafo", ["building", "cafo_annotation"], " select b.id, coalesce(bool_and(c.is_cafo), true) as is_cafo, count(c.building_id) as labels from building b left join cafo_annotation c on c.building_id = b.id where not b.excluded group by b.id")
def facility_is_cafo(spark, d):
    """All labels of a building agree that it is one; true without labels."""
    a = view(spark, d, "cafo_annotation").groupBy(F.col("building_id").alias("id")).agg(F.bool_and("is_cafo").alias("is_cafo"), F.count("*").alias("labels"))
    out = view(spark, d, "building").where("not excluded").select("id").join(a, "id", "left")
    return out.select("id", F.coalesce("is_cafo", F.lit(True)).alias("is_cafo"), F.coalesce("labels", F.lit(0)).alias("labels"))


_AREA = "xmin <= 30000 and xmax >= 10000 and ymin <= 42000 and ymax >= 12000"


@query("tiles_in_area", ["tile"], f" select id, bucket from tile where {_AREA} and bucket is not null")
def tiles_in_area(spark, d):
    return view(spark, d, "tile").where(f"{_AREA} and bucket is not null").select("id", "bucket")


@query("facility_map_points", [*_V, "county"], _CONFIRMED + f" select f.id, (xmin + xmax) / 2.0 as x, (ymin + ymax) / 2.0 as y, {_COUNTY} as county, exists (select 1 from permit p where {_NEAR}) as permitted from site f")
def map_points(spark, d):
    near = _ids(site_permits(spark, d), "site").withColumn("permitted", F.lit(True))
    s = sites(spark, d).join(near, "id", "left")
    return s.select("id", F.expr("(xmin + xmax) / 2.0D").alias("x"), F.expr("(ymin + ymax) / 2.0D").alias("y"), F.expr(_COUNTY).alias("county"), F.coalesce("permitted", F.lit(False)).alias("permitted"))


@query("labeled_totals", _TC, _TILES + " select status, count(*) as tiles, count(case when positive then 1 end) as positive, count(*) / cast((select count(*) from status) as double) as share from status group by status")
def labeled_totals(spark, d):
    g = tile_status(spark, d).groupBy("status").agg(F.count("*").alias("tiles"), F.count_if("positive").alias("positive"))
    return g.join(F.broadcast(g.agg(F.sum("tiles").alias("n")))).select("status", "tiles", "positive", (F.col("tiles") / F.col("n")).alias("share"))
