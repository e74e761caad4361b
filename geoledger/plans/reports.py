"""Tile relations, checks, report tables and headline values."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from geoledger.operators.spatial import grid_join
from geoledger.operators.storage import materialize
from geoledger.plans.estimates import _TILES, _TC, tile_status
from geoledger.plans.library import _ADJ, _CONFIRMED, _COUNTY, _EX_ANTE, _NEAR, _V, adjacent, initially_labeled, permits_without, query, site_permits, sites
from geoledger.sources.views import county_of, view

_BOX = ["id", "xmin", "ymin", "xmax", "ymax"]
#: SQL: on(tile, site) of all sites whose box meets a tile.
_ON = ", f3 as (select a.tile_id as tile, 1 as x from tile_annotation a), on_tile as (select t.id as tile, f.id as site from tile t join site f on t.xmin <= f.xmax and f.xmin <= t.xmax and t.ymin <= f.ymax and f.ymin <= t.ymax)"


def on_tile(spark, d: str, which: DataFrame | None = None) -> DataFrame:
    s = which if which is not None else sites(spark, d)
    got = grid_join(s.select(*_BOX), view(spark, d, "tile").select(*_BOX), 0, 2002)
    return got.select(F.col("r.id").alias("tile"), F.col("l.id").alias("site"))


@query("positive_tiles", [*_V, "tile", "tile_annotation"], _CONFIRMED + _ON + " select distinct tile as id from on_tile where tile in (select tile from f3)")
def positive_tiles(spark, d):
    seen = view(spark, d, "tile_annotation").select(F.col("tile_id").alias("tile"))
    return on_tile(spark, d).join(seen, "tile", "left_semi").select(F.col("tile").alias("id")).distinct()


_ANY = ", hit as (select distinct t.id from tile t join building b on t.xmin <= b.xmax and b.xmin <= t.xmax and t.ymin <= b.ymax and b.ymin <= t.ymax)"


@query("labeled_negative_tiles", [*_V, "tile", "tile_annotation"], _CONFIRMED + _ON + _ANY + " select id from hit where id in (select tile from f3) and id not in (select tile from on_tile)")
def labeled_negative(spark, d):
    seen = view(spark, d, "tile_annotation").select(F.col("tile_id").alias("id"))
    return on_tile(spark, d, view(spark, d, "building")).select(F.col("tile").alias("id")).distinct().join(seen, "id", "left_semi").join(positive_tiles(spark, d), "id", "left_anti")


_NEGATIVE = _ANY + " select t.id from tile t where t.bucket {0} and t.id in (select tile_id from tile_annotation) and t.id not in (select id from hit)"


def _negative(spark, d: str, which: str) -> DataFrame:
    seen = view(spark, d, "tile_annotation").select(F.col("tile_id").alias("id"))
    hit = on_tile(spark, d, view(spark, d, "building")).select(F.col("tile").alias("id"))
    return view(spark, d, "tile").where(which).select("id").join(seen, "id", "left_semi").join(hit, "id", "left_anti")


@query("high_confidence_negative_tiles", ["tile", "tile_annotation", "building"], _NEGATIVE.format("not in ('0', '1')"))
def high_negative(spark, d):
    return _negative(spark, d, _EX_ANTE)


@query("low_confidence_negative_tiles", ["tile", "tile_annotation", "building"], _NEGATIVE.format("in ('0', '1')"))
def low_negative(spark, d):
    return _negative(spark, d, "bucket in ('0', '1')")


@query("labeled_tiles", ["tile", "tile_annotation"], " select t.id, a.id as annotation from tile t join tile_annotation a on a.tile_id = t.id")
def labeled(spark, d):
    a = view(spark, d, "tile_annotation").select(F.col("id").alias("annotation"), F.col("tile_id").alias("id"))
    return view(spark, d, "tile").select("id").join(a, "id")


_INIT = f", init as (select id from tile where {_EX_ANTE} union select b.id from tile a join tile b on {_ADJ} where b.bucket is not null and a.bucket = 'ex ante permit')"


@query("initial_tiles_needing_labels", ["tile", "tile_annotation"], _INIT + " select id from init where id not in (select tile_id from tile_annotation)")
def needing_labels(spark, d):
    return initially_labeled(spark, d).join(view(spark, d, "tile_annotation").select(F.col("tile_id").alias("id")), "id", "left_anti")


@query("unlabeled_adjacent_tiles", ["tile", "tile_annotation"], f" select distinct b.id from tile a join tile b on {_ADJ} where b.bucket is not null and a.bucket = 'ex ante permit' and b.id not in (select tile_id from tile_annotation)")
def unlabeled_adjacent(spark, d):
    return adjacent(spark, d).select(F.col("neighbour").alias("id")).distinct().join(view(spark, d, "tile_annotation").select(F.col("tile_id").alias("id")), "id", "left_anti")


_STATE = f""", st as (select f.id, {_COUNTY} as county, case when exists (select 1 from permit p where p.status = 'Active' and {_NEAR}) then 'active' when exists (select 1 from permit p where {_NEAR}) then 'historical' else 'none' end as state from site f)"""
_STATES = ["active", "historical", "none"]


def site_states(spark, d: str) -> DataFrame:
    """(id, county, state): one distance join serves both statuses."""
    p = view(spark, d, "permit").select(F.col("id").alias("permit"), F.col("status") == "Active")
    near = site_permits(spark, d).join(p.toDF("permit", "active"), "permit").groupBy(F.col("site").alias("id")).agg(F.bool_or("active").alias("active"))
    out = sites(spark, d).withColumn("county", F.expr(_COUNTY)).join(near, "id", "left")
    return out.select("id", "county", F.expr("case when active then 'active' when active is not null then 'historical' else 'none' end").alias("state"))


@query("facilities_by_county_and_status", [*_V, "county"], _CONFIRMED + _STATE + " select c.name, " + ", ".join(f"count(case when state = '{s}' then 1 end) as {s}" for s in _STATES) + ", count(*) as total from st join county c on c.id = st.county group by rollup(c.name)")
def county_status(spark, d):
    """Counts per county and a total row; the rollup is over at most 25 names."""
    j = site_states(spark, d).join(view(spark, d, "county").select(F.col("id").alias("county"), "name"), "county")
    return j.rollup("name").agg(*[F.count_if(F.col("state") == s).alias(s) for s in _STATES], F.count("*").alias("total"))


_LOST = f""", lost as (select p.*, {county_of('rx', 'ry')} as county, not exists (select 1 from site f where {_NEAR}) as lost from permit p)"""


@query("permit_issues_by_county", [*_V, "county"], _CONFIRMED + _STATE + _LOST + """, a as (select county, count(*) as facilities, count(case when state = 'none' then 1 end) as without_permit from st group by 1),
    b as (select county, count(*) as permits, count(case when lost then 1 end) as lost, count(case when lost and population >= 200 then 1 end) as large_lost from lost group by 1),
    j as (select case when coalesce(facilities, 0) + coalesce(permits, 0) < 50 then 'All other' else name end as name, coalesce(facilities, 0) as facilities, coalesce(without_permit, 0) as without_permit, coalesce(permits, 0) as permits, coalesce(lost, 0) as lost, coalesce(large_lost, 0) as large_lost
        from county c left join a on a.county = c.id left join b on b.county = c.id)
    select name, cast(sum(facilities) as bigint) as facilities, cast(sum(without_permit) as bigint) as without_permit, cast(sum(permits) as bigint) as permits, cast(sum(lost) as bigint) as lost, cast(sum(large_lost) as bigint) as large_lost from j group by name""")
def issues(spark, d):
    a = site_states(spark, d).groupBy("county").agg(F.count("*").alias("facilities"), F.count_if(F.col("state") == "none").alias("without_permit"))
    gone = permits_without(spark, d).select("id", F.lit(True).alias("lost"))
    p = view(spark, d, "permit").withColumn("county", F.expr(county_of("rx", "ry"))).join(gone, "id", "left")
    b = p.groupBy("county").agg(F.count("*").alias("permits"), F.count("lost").alias("lost"), F.count_if(F.expr("lost and population >= 200")).alias("large_lost"))
    j = view(spark, d, "county").select(F.col("id").alias("county"), "name").join(a, "county", "left").join(b, "county", "left").na.fill(0)
    j = j.withColumn("name", F.when(F.expr("facilities + permits < 50"), "All other").otherwise(F.col("name")))
    return j.groupBy("name").agg(*[F.sum(c).alias(c) for c in ("facilities", "without_permit", "permits", "lost", "large_lost")])


@query("permits_by_program_and_status", ["permit"], """, g as (select program, count(*) as total, count(case when status = 'Active' then 1 end) as active, count(case when population is null then 1 end) as no_count, count(case when population >= 200 then 1 end) as large from permit group by program)
    select case when grouping(program) = 1 then 'Total' else program end as program, cast(sum(total) as bigint) as total, cast(sum(active) as bigint) as active, cast(sum(total - active) as bigint) as historical, cast(sum(no_count) as bigint) as no_count, cast(sum(large) as bigint) as large from g group by rollup(program)""")
def by_program(spark, d):
    g = view(spark, d, "permit").groupBy("program").agg(F.count("*").alias("total"), F.count_if(F.col("status") == "Active").alias("active"), F.count_if(F.col("population").isNull()).alias("no_count"), F.count_if(F.col("population") >= 200).alias("large"))
    out = g.rollup("program").agg(F.grouping("program").alias("g"), F.sum("total").alias("total"), F.sum("active").alias("active"), F.sum(F.col("total") - F.col("active")).alias("historical"), F.sum("no_count").alias("no_count"), F.sum("large").alias("large"))
    return out.withColumn("program", F.when(F.col("g") == 1, "Total").otherwise(F.col("program"))).drop("g")


@query("labeling_table", _TC, _TILES + " select coalesce(bucket, 'removed') as bucket, status, count(*) as tiles, count(case when positive then 1 end) as positive from status group by 1, 2")
def labeling(spark, d):
    return tile_status(spark, d).groupBy(F.coalesce("bucket", F.lit("removed")).alias("bucket"), "status").agg(F.count("*").alias("tiles"), F.count_if("positive").alias("positive"))


@query("removed_in_both_phases", ["cafo_annotation"], """, r as (select building_id, bool_or(phase = 0) as typing, bool_or(phase = 1) as dating from cafo_annotation where not is_cafo group by 1)
    select count(case when typing then 1 end) as typing, count(case when dating then 1 end) as dating, count(case when typing and dating then 1 end) as both_phases, count(*) as removed from r""")
def removed(spark, d):
    r = view(spark, d, "cafo_annotation").where("not is_cafo").groupBy("building_id").agg(F.bool_or(F.col("phase") == 0).alias("typing"), F.bool_or(F.col("phase") == 1).alias("dating"))
    return r.agg(F.count_if("typing").alias("typing"), F.count_if("dating").alias("dating"), F.count_if(F.expr("typing and dating")).alias("both_phases"), F.count("*").alias("removed"))


@query("headline_values", [*_V, "tile", "tile_annotation", "type_annotation"], _CONFIRMED + _STATE + """ select 'confirmed facilities' as name, cast(count(*) as double) as value from site union all select 'all buildings', count(*) from building
    union all select 'permits', count(*) from permit union all select 'share without permit', count(case when state = 'none' then 1 end) / cast(count(*) as double) from st
    union all select 'annotated tiles', count(distinct tile_id) from tile_annotation union all select 'kept tiles', count(bucket) from tile
    union all select 'confirmed without type', count(*) from site where id not in (select building_id from type_annotation)""")
def headline(spark, d):
    """One row per value; every relation is aggregated once."""
    st = site_states(spark, d).agg(F.count("*").cast("double").alias("confirmed facilities"), (F.count_if(F.col("state") == "none") / F.count("*")).alias("share without permit"))
    n = lambda df, c, name: df.agg(c.cast("double").alias(name))
    parts = [
        st, n(view(spark, d, "building"), F.count("*"), "all buildings"), n(view(spark, d, "permit"), F.count("*"), "permits"),
        n(view(spark, d, "tile_annotation").select("tile_id").distinct(), F.count("*"), "annotated tiles"), n(view(spark, d, "tile"), F.count("bucket"), "kept tiles"),
        n(sites(spark, d).join(view(spark, d, "type_annotation").select(F.col("building_id").alias("id")), "id", "left_anti"), F.count("*"), "confirmed without type"),
    ]
    return reduce(DataFrame.union, [p.unpivot([], p.columns, "name", "value") for p in parts])


_RANGES = [("confirmed facilities", "value > 0"), ("active without label", "value = 0"), ("confirmed without dating", "value = 0"), ("unmatched large permits", "value < 100"), ("unlabeled next to ex ante", "value = 0")]


@query("check_report", [*_V, "tile", "tile_annotation"], _CONFIRMED + f""", v as (select 'confirmed facilities' as name, count(*) as value from site union all select 'active without label', count(*) from building where not excluded and id >= 0 and id not in (select building_id from cafo_annotation)
    union all select 'confirmed without dating', count(*) from site where id not in (select building_id from construction_annotation)
    union all select 'unmatched large permits', count(*) from permit p where status = 'Active' and population > 200 and not exists (select 1 from site f where {_NEAR})
    union all select 'unlabeled next to ex ante', count(distinct b.id) from tile a join tile b on {_ADJ} where b.bucket is not null and a.bucket = 'ex ante permit' and b.id not in (select tile_id from tile_annotation))
    select name, value, case {' '.join(f"when name = '{n}' then {c}" for n, c in _RANGES)} end as passed from v""")
def check_report(spark, d):
    """Each check's count of offending rows and whether it lies in its accepted range."""
    s = materialize(sites(spark, d), "sites")
    key = lambda v, c: view(spark, d, v).select(F.col(c).alias("id"))
    found = [
        s, view(spark, d, "building").where("not excluded and id >= 0").join(key("cafo_annotation", "building_id"), "id", "left_anti"), s.join(key("construction_annotation", "building_id"), "id", "left_anti"),
        permits_without(spark, d).where("status = 'Active' and population > 200"), unlabeled_adjacent(spark, d),
    ]
    each = [df.agg(F.count("*").alias("value")).select(F.lit(n).alias("name"), "value", F.expr(c).alias("passed")) for df, (n, c) in zip(found, _RANGES)]
    return reduce(DataFrame.union, each)
