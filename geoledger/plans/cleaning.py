"""Cleaning on load and flat extracts, over whole tables."""

from __future__ import annotations

from pyspark.sql import Window as W, functions as F

from geoledger.plans.library import query
from geoledger.sources.views import view


def table(spark, d: str, name: str):
    return spark.read.parquet(f"{d}/{name}.parquet")


@query("address_parts", [], "select o_orderkey as id, trim(string_split(o_orderpriority, '-')[1]) as first_part, coalesce(trim(string_split(o_orderpriority, '-')[2]), o_orderstatus) as second_part from orders")
def address_parts(spark, d):
    """First two trimmed tokens; a fallback column when there are fewer than two."""
    parts = F.split("o_orderpriority", "-")
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.trim(parts[0]).alias("first_part"), F.coalesce(F.trim(F.get(parts, F.lit(1))), "o_orderstatus").alias("second_part"))


@query("nested_lookup", [], "select event_id, try_cast(json_extract_string(props, '$.k') as bigint) as k, coalesce(json_extract_string(props, '$.missing'), json_extract_string(props, '$.k')) as either_key from events")
def nested(spark, d):
    k = F.get_json_object("props", "$.k")
    return table(spark, d, "events").select("event_id", k.try_cast("bigint").alias("k"), F.coalesce(F.get_json_object("props", "$.missing"), k).alias("either_key"))


@query("content_digests", [], "select md5(props) as digest, count(*) as copies, min(event_id) as first_id from events group by 1")
def digests(spark, d):
    return table(spark, d, "events").groupBy(F.md5("props").alias("digest")).agg(F.count("*").alias("copies"), F.min("event_id").alias("first_id"))


@query("labels_unpivoted", [], "select doc_id, 'quality' as kind from labels where quality = 1 union all select doc_id, 'toxic' from labels where toxic = 1")
def unpivoted(spark, d):
    return table(spark, d, "labels").unpivot(["doc_id"], ["quality", "toxic"], "kind", "on").where("on = 1").drop("on")


@query("part_words_bridge", [], "select p_partkey, trim(unnest(string_split(p_name, ' '))) as word from part")
def bridge(spark, d):
    return table(spark, d, "part").select("p_partkey", F.explode(F.split("p_name", " ")).alias("word")).withColumn("word", F.trim("word"))


@query("number_in_one_parcel", ["parcel"], " select owner, min(id) as id from parcel group by owner having count(distinct number) = 1")
def one_parcel(spark, d):
    return view(spark, d, "parcel").groupBy("owner").agg(F.min("id").alias("id"), F.min("number").alias("lo"), F.max("number").alias("hi")).where("lo = hi").select("owner", "id")


@query("first_delivery_wins", ["parcel"], """, k as (select *, first_value(owner) over w as first_owner, row_number() over w as place from parcel window w as (partition by number order by id))
    select number, id, owner, first_owner, place = 1 as kept from k where place = 1 or owner <> first_owner""")
def first_wins(spark, d):
    """The first of each number is kept; later ones with other owners are reported."""
    w = W.partitionBy("number").orderBy("id")
    k = view(spark, d, "parcel").withColumns({"first_owner": F.first("owner").over(w), "place": F.row_number().over(w)})
    return k.where("place = 1 or owner <> first_owner").select("number", "id", "owner", "first_owner", (F.col("place") == 1).alias("kept"))


@query("human_source_preferred", ["type_annotation", "building"], """, u as (select building_id as id, animal_type, 1 as rank from type_annotation union all select id, lower(animal_type), 2 from building)
    select id, animal_type, case min(rank) when 1 then 'human' else 'permit' end as source from u group by 1, 2""")
def preferred(spark, d):
    a = view(spark, d, "type_annotation").select(F.col("building_id").alias("id"), "animal_type", F.lit(1).alias("rank"))
    u = a.union(view(spark, d, "building").select("id", F.lower("animal_type"), F.lit(2)))
    return u.groupBy("id", "animal_type").agg(F.when(F.min("rank") == 1, "human").otherwise("permit").alias("source"))


@query("status_filled_by_priority", ["tile", "tile_annotation"], """, p as (select distinct tile_id as id from tile_annotation where label = 'purchase'), e as (select distinct tile_id as id from tile_annotation where label = 'error')
    select t.id, case when p.id is not null then 'positive' when e.id is not null then 'flagged' when t.bucket is null then 'removed' else 'unset' end as status from tile t left join p using (id) left join e using (id)""")
def filled(spark, d):
    """Ordered sources fill one column; one aggregate serves them all."""
    a = view(spark, d, "tile_annotation").groupBy(F.col("tile_id").alias("id")).agg(F.bool_or(F.col("label") == "purchase").alias("p"), F.bool_or(F.col("label") == "error").alias("e"))
    return view(spark, d, "tile").join(a, "id", "left").selectExpr("id", "case when p then 'positive' when e then 'flagged' when bucket is null then 'removed' else 'unset' end as status")


@query("review_merge", ["cafo_annotation"], """, last as (select building_id, max(annotated_on) as annotated_on from cafo_annotation group by 1)
    select a.building_id, bool_or(a.is_cafo) as is_cafo, bool_or(a.phase = 1) as second_phase from cafo_annotation a join last using (building_id, annotated_on) group by 1 having min(a.is_cafo::int) = max(a.is_cafo::int)""")
def review_merge(spark, d):
    """Flags of the newest review date; contradicting reviews of that date drop the site."""
    a = view(spark, d, "cafo_annotation")
    last = a.groupBy("building_id").agg(F.max("annotated_on").alias("annotated_on"))
    g = a.join(last, ["building_id", "annotated_on"]).groupBy("building_id")
    out = g.agg(F.bool_or("is_cafo").alias("is_cafo"), F.bool_and("is_cafo").alias("every"), F.bool_or(F.col("phase") == 1).alias("second_phase"))
    return out.where("is_cafo = every").drop("every")


@query("owners_in_layer", ["building", "parcel"], " select p.number, string_agg(distinct p.owner, '; ' order by p.owner) as owners, count(distinct b.id) as buildings from building b join parcel p on p.id = b.parcel_id where p.owner <> '' group by p.number")
def owners_layer(spark, d):
    p = view(spark, d, "parcel").where("owner <> ''").select(F.col("id").alias("parcel_id"), "owner", "number")
    g = view(spark, d, "building").join(p, "parcel_id").groupBy("number")
    return g.agg(F.array_join(F.sort_array(F.collect_set("owner")), "; ").alias("owners"), F.count_distinct("id").alias("buildings"))


@query("second_rater_batch", ["tile", "tile_annotation"])
def rater_batch(spark, d, per_class: int = 400, seed: int = 7):
    """Work list of at most ``per_class`` tiles of each class (a sampling operator), neighbours in hash order paired.

    Two of four raters get a tile, the other two its partner.
    """
    c = filled(spark, d).withColumn("h", F.xxhash64(F.lit(seed), "id"))
    c = c.withColumn("k", F.row_number().over(W.partitionBy("status").orderBy("h", "id"))).where(f"k <= {per_class}")
    pair = F.floor((F.col("k") - 1) / 2)
    choice = F.pmod(F.xxhash64(F.lit(seed), "status", pair), F.lit(6))
    pairs = F.array(*[F.array(F.lit(a), F.lit(b)) for a, b in [(0, 1), (0, 2), (0, 3), (1, 2), (1, 3), (2, 3)]])
    mine = F.element_at(pairs, F.when(F.col("k") % 2 == 1, choice + 1).otherwise(6 - choice).cast("int"))
    return c.select("id", "status", pair.alias("pair"), F.explode(mine).alias("rater"))
