"""Matches in tiers, whole permit lists, and tile classes from the four tile relations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window as W, functions as F

from geoledger.functions.projection import project, unproject
from geoledger.operators.spatial import grid_join
from geoledger.operators.storage import materialize
from geoledger.plans.estimates import rated
from geoledger.plans.library import _CONFIRMED, _KAPPA, _SHARES, _TABLE, _V, query, site_permits, sites
from geoledger.plans.matching import _BOX, _PARCELS, _REG, parcel_of, points
from geoledger.plans.reports import _ANY, _ON, high_negative, labeled_negative, low_negative, positive_tiles
from geoledger.sources.views import view

#: Two sites whose distances differ by less can't be told apart.
TIE = 20


@query("parcel_site_else_closest", [*_V, "parcel"], _CONFIRMED + _PARCELS + f""", first as (select reg.permit, min(f.id) as site from reg join site f on f.parcel_id = reg.parcel group by 1),
    n as (select p.id as permit, f.id as site, sqrt({_REG}) as d, row_number() over (partition by p.id order by {_REG}, f.id) as k from permit p join site f on {_REG} <= 1000000 where p.id not in (select permit from first)),
    w as (select *, lead(d) over (partition by permit order by k) - d as gap from n)
    select permit, site, 'parcel' as source from first union all select permit, case when coalesce(gap >= {TIE}, true) then site end, case when coalesce(gap >= {TIE}, true) then 'closest' else 'tied' end from w where k = 1""")
def parcel_else_closest(spark, d):
    """A permit's site by its parcel; without one the closest within 1000 m, unless the two closest are a tie."""
    s = materialize(sites(spark, d).select(*_BOX, "parcel_id"), "sites")
    first = parcel_of(spark, d, "rx", "ry").join(s.select(F.col("id").alias("site"), F.col("parcel_id").alias("parcel")), "parcel").groupBy("permit").agg(F.min("site").alias("site"))
    first = materialize(first, "by-parcel")
    rest = points(spark, d, "rx", "ry").join(first.select(F.col("permit").alias("id")), "id", "left_anti")
    near = grid_join(rest, s.select(*_BOX), 1000).select(F.col("l.id").alias("permit"), F.col("r.id").alias("site"), F.sqrt("d2").alias("d"))
    # the two closest are an aggregate, so a place with very many sites isn't sorted
    two = near.groupBy("permit").agg(F.min(F.struct("d", "site")).alias("a"))
    second = near.join(two, "permit").where("site <> a.site").groupBy("permit").agg(F.min("d").alias("next"))
    out = two.join(second, "permit", "left").withColumn("clear", F.coalesce(F.col("next") - F.col("a.d") >= TIE, F.lit(True)))
    out = out.select("permit", F.when(F.col("clear"), F.col("a.site")).alias("site"), F.when(F.col("clear"), "closest").otherwise("tied").alias("source"))
    return first.select("permit", "site", F.lit("parcel").alias("source")).union(out)


def permit_lists(spark, d: str, only: DataFrame | None = None) -> DataFrame:
    """(site, permits): all permits within 1000 m of each site, in order; an empty list where there are none. ``only(id)`` names sites."""
    s, near = sites(spark, d).select(F.col("id").alias("site")), site_permits(spark, d).select("site", "permit")
    if only is not None:
        s = s.join(only.select(F.col("id").alias("site")), "site", "left_semi")
    got = near.groupBy("site").agg(F.sort_array(F.collect_list("permit")).alias("permits"))
    return s.join(got, "site", "left").withColumn("permits", F.coalesce("permits", F.array().cast("array<bigint>")))


@query("site_permit_lists", _V, _CONFIRMED + """, m as (select f.id as site, p.id as permit from site f left join permit p on (pow(greatest(0, f.xmin - p.rx, p.rx - f.xmax), 2) + pow(greatest(0, f.ymin - p.ry, p.ry - f.ymax), 2) <= 1000000
      or (p.gx is not null and pow(greatest(0, f.xmin - p.gx, p.gx - f.xmax), 2) + pow(greatest(0, f.ymin - p.gy, p.gy - f.ymax), 2) <= 1000000)))
    select site, coalesce(string_agg(permit, ',' order by permit), '') as permits from m group by site""")
def site_permit_lists(spark, d):
    return permit_lists(spark, d).select("site", F.array_join("permits", ",").alias("permits"))


_CLASSES = """, pos as (select distinct tile as id from on_tile where tile in (select tile from f3)),
    cls as (select t.id, t.bucket, case when t.id not in (select id from hit) and t.bucket in ('0', '1') then 'low confidence negative' when t.id not in (select id from hit) and t.bucket not in ('0', '1') then 'high confidence negative'
      when t.id in (select id from hit) and t.id not in (select tile from on_tile) then 'labeled negative' when t.id in (select id from pos) then 'positive' end as class from tile t where t.id in (select tile_id from tile_annotation))"""
_CLASSED = [*_V, "tile", "tile_annotation"]


def class_map(spark, d: str) -> DataFrame:
    """(id, class): tiles by the four tile relations; of several classes of a tile the last one counts."""
    parts = [(positive_tiles, "positive"), (labeled_negative, "labeled negative"), (high_negative, "high confidence negative"), (low_negative, "low confidence negative")]
    all_ = reduce(DataFrame.union, [f(spark, d).select("id", F.struct(F.lit(k).alias("k"), F.lit(c).alias("class")).alias("c")) for k, (f, c) in enumerate(parts)])
    return all_.groupBy("id").agg(F.max("c").alias("c")).select("id", "c.class")


@query("tile_class_map", _CLASSED, _CONFIRMED + _ON + _ANY + _CLASSES + " select id, class from cls where class is not null")
def tile_class_map(spark, d):
    return class_map(spark, d)


#: SQL: verdicts of tiles with exactly two raters, in order of the raters.
_TWO = """, v as (select a.tile_id as id, a.annotator, bool_or(a.label = 'purchase') as verdict from tile_annotation a join tile t on t.id = a.tile_id where t.bucket is not null group by 1, 2),
    two as (select id, arg_min(verdict, annotator) as a, arg_max(verdict, annotator) as b from v group by 1 having count(*) = 2)"""


@query("agreement_by_tile_class", _CLASSED, _CONFIRMED + _ON + _ANY + _CLASSES + _TWO + f""", t as (select class, {_TABLE} from two join cls using (id) where class is not null group by class), s as (select *, {_SHARES} from t)
    select class, n, both_true, both_false, n - both_true - both_false as disagree, po as agreement, {_KAPPA} as kappa from s""")
def agreement_by_tile_class(spark, d):
    """Raters' agreement by the class that the tile relations give."""
    pairs = rated(spark, d).select(F.col("tile_id").alias("id"), "a", "b").join(class_map(spark, d), "id")
    t = pairs.groupBy("class").agg(*[F.expr(x) for x in _TABLE.split(", ")]).selectExpr("*", *_SHARES.split(", "))
    return t.selectExpr("class", "n", "both_true", "both_false", "n - both_true - both_false as disagree", "po as agreement", f"{_KAPPA} as kappa")


@query("agreement_by_label_status", [*_V, "tile", "tile_annotation"], _TWO + f""", st as (select t.id, case when t.bucket in ('0', '1') then 'labeled' else 'initially labeled' end as status from tile t),
    t as (select status, {_TABLE} from two join st using (id) group by status), s as (select *, {_SHARES} from t)
    select status, n, both_true, both_false, n - both_true - both_false as disagree, po as agreement, {_KAPPA} as kappa from s""")
def agreement_by_status(spark, d):
    """Raters' agreement by why a tile was labeled: in the initial set, or afterwards."""
    pairs = rated(spark, d).withColumn("status", F.when(F.col("bucket").isin("0", "1"), "labeled").otherwise("initially labeled"))
    t = pairs.groupBy("status").agg(*[F.expr(x) for x in _TABLE.split(", ")]).selectExpr("*", *_SHARES.split(", "))
    return t.selectExpr("status", "n", "both_true", "both_false", "n - both_true - both_false as disagree", "po as agreement", f"{_KAPPA} as kappa")


@query("rater_batch_by_class", _CLASSED, _CONFIRMED + _ON + _ANY + _CLASSES + """, r as (select id, class, row_number() over (partition by class order by md5(concat('31|', id)), id) as k from cls where class is not null)
    select id, class, k, cast(floor((k - 1) / 2.0) as bigint) as pair, (k - 1) % 2 as place from r where k <= 400""")
def rater_batch(spark, d, most: int = 400):
    """Up to ``most`` tiles of each class for a second rating, in a fixed random order, two and two."""
    w = W.partitionBy("class").orderBy(F.md5(F.concat(F.lit("31|"), F.col("id").cast("string"))), "id")
    r = class_map(spark, d).withColumn("k", F.row_number().over(w).cast("long")).where(F.col("k") <= most)
    return r.select("id", "class", "k", F.floor((F.col("k") - 1) / 2).alias("pair"), ((F.col("k") - 1) % 2).alias("place"))


_X0, _Y0 = -100000.0, -300000.0
_LONLAT = unproject("x", "y")


@query("permit_lonlat", ["permit"], f", p as (select id, rx + {_X0}e0 as x, ry + {_Y0}e0 as y from permit), g as (select id, x, y, {_LONLAT[0]} as lon, {_LONLAT[1]} as lat from p) select id, round(lon, 9) as lon, round(lat, 9) as lat, sqrt(pow({project('lon', 'lat')[0]} - x, 2) + pow({project('lon', 'lat')[1]} - y, 2)) < 0.001 as returns from g")
def permit_lonlat(spark, d):
    """Permits' longitude and latitude, with the places taken as metres from a corner of the projection, and whether projecting them gives the place back to the millimetre."""
    p = view(spark, d, "permit").selectExpr("id", f"rx + {_X0}D as x", f"ry + {_Y0}D as y").selectExpr("id", "x", "y", f"{_LONLAT[0]} as lon", f"{_LONLAT[1]} as lat")
    x, y = project("lon", "lat")
    return p.selectExpr("id", "round(lon, 9) as lon", "round(lat, 9) as lat", f"sqrt(pow({x} - x, 2) + pow({y} - y, 2)) < 0.001 as returns")
