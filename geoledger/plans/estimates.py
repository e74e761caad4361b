"""Strata, interval estimates, resampling and rater agreement."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from geoledger.operators.intervals import combined_estimate, exact_lower, exact_upper
from geoledger.plans.library import _ADJ, _EX_ANTE, _KAPPA, _SHARES, _TABLE, adjacent, query
from geoledger.sources.views import county_of, view

_T = ["tile", "tile_annotation"]
_GROUP = county_of("(t.xmin + t.xmax) / 2.0", "(t.ymin + t.ymax) / 2.0")

#: SQL: one row per tile with its stratum ("completed" before bucket and county group) and flags.
_TILES = f""", adj as (select distinct b.id from tile a join tile b on {_ADJ} where b.bucket is not null and a.bucket = 'ex ante permit'),
    seen as (select tile_id as id, count(*) as n, bool_or(label = 'purchase') as positive, bool_or(label = 'error') as flagged from tile_annotation group by 1),
    status as (select t.id, t.bucket, case when t.bucket is null then 'removed' when s.id is null then 'unlabeled' when {_EX_ANTE.replace('bucket', 't.bucket')} then 'initially labeled' else 'labeled' end as status,
    case when {_EX_ANTE.replace('bucket', 't.bucket')} or a.id is not null then 'completed' when t.bucket is not null then concat(t.bucket, ':', c.county_group) end as stratum,
    s.id is not null as labeled, coalesce(s.positive, false) as positive, coalesce(s.flagged, false) as flagged from tile t left join adj a on a.id = t.id left join seen s on s.id = t.id left join county c on c.id = {_GROUP}),
    strata as (select stratum, count(*) as total, count(case when labeled then 1 end) as labeled, count(case when not labeled then 1 end) as unlabeled, count(case when positive then 1 end) as positive from status where stratum is not null group by 1)"""
_TC = [*_T, "county"]


def tile_status(spark, d: str) -> DataFrame:
    t = view(spark, d, "tile").alias("t")
    seen = view(spark, d, "tile_annotation").groupBy(F.col("tile_id").alias("id")).agg(F.bool_or(F.col("label") == "purchase").alias("p"), F.bool_or(F.col("label") == "error").alias("f"))
    near = adjacent(spark, d).select(F.col("neighbour").alias("id")).distinct().withColumn("near", F.lit(True))
    county = view(spark, d, "county").select(F.col("id").alias("county"), "county_group")
    j = t.withColumn("county", F.expr(_GROUP)).join(seen, "id", "left").join(near, "id", "left").join(county, "county", "left")
    return j.selectExpr(
        "id", "bucket", f"case when bucket is null then 'removed' when p is null then 'unlabeled' when {_EX_ANTE} then 'initially labeled' else 'labeled' end as status",
        f"case when {_EX_ANTE} or near then 'completed' when bucket is not null then concat(bucket, ':', county_group) end as stratum",
        "p is not null as labeled", "coalesce(p, false) as positive", "coalesce(f, false) as flagged",
    )


def survey(spark, d: str) -> DataFrame:
    g = tile_status(spark, d).where("stratum is not null").groupBy("stratum")
    return g.agg(F.count("*").alias("total"), F.count_if("labeled").alias("labeled"), F.count_if(~F.col("labeled")).alias("unlabeled"), F.count_if("positive").alias("positive"))


@query("tile_status", _TC, _TILES + " select id, bucket, status, stratum, labeled, positive from status")
def status(spark, d):
    return tile_status(spark, d).drop("flagged")


@query("survey_strata", _TC, _TILES + " select * from strata")
def survey_strata(spark, d):
    return survey(spark, d)


@query("strata_population", _TC, _TILES + """, p as (select stratum, positive, positive / cast(labeled as double) * unlabeled + positive as population from strata where labeled > 0)
    select stratum, population, case when population > 0 then positive / population end as recall from p""")
def population(spark, d):
    p = survey(spark, d).where("labeled > 0").withColumn("population", F.expr("positive / labeled * unlabeled + positive"))
    return p.selectExpr("stratum", "population", "case when population > 0 then positive / population end as recall")


@query("weighted_total", _TC, _TILES + " select sum(total / cast(labeled as double) * positive) as population from strata where labeled > 0")
def weighted_total(spark, d):
    return survey(spark, d).where("labeled > 0").agg(F.expr("sum(total / labeled * positive) as population"))


@query("strata_exact_intervals")
def exact(spark, d):
    s = survey(spark, d)
    return s.withColumns({"lower": exact_lower(F.col("positive"), F.col("labeled")), "upper": exact_upper(F.col("positive"), F.col("labeled"))})


@query("combined_prevalence")
def combined(spark, d):
    return combined_estimate(survey(spark, d))


@query("split_estimate")
def split(spark, d):
    """Bucket 0 and bucket 1 strata estimated apart, completed positives and positives of removed tiles added as they are."""
    s = survey(spark, d)
    parts = combined_estimate(s.where("stratum <> 'completed'").withColumn("part", F.substring_index("stratum", ":", 1)), ["part"]).select("part", "point_n", "lower_n", "upper_n")
    done = s.where("stratum = 'completed'").select(F.lit("completed").alias("part"), *[F.col("positive").alias(c) for c in ("point_n", "lower_n", "upper_n")])
    late = tile_status(spark, d).where("stratum is null").agg(F.count_if("positive").alias("n")).select(F.lit("post hoc").alias("part"), *[F.col("n").alias(c) for c in ("point_n", "lower_n", "upper_n")])
    all_ = parts.union(done).union(late)
    return all_.union(all_.agg(F.lit("all").alias("part"), F.sum("point_n").alias("point_n"), F.sum("lower_n").alias("lower_n"), F.sum("upper_n").alias("upper_n")))


def replicates(spark, strata: DataFrame, draws: int, seed: int) -> DataFrame:
    """``strata`` once per replicate with ``u``, a uniform number hashed from (seed, replicate, stratum)."""
    grid = strata.withColumn("replicate", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))))
    return grid.withColumn("u", (F.pmod(F.xxhash64(F.lit(seed), "replicate", "stratum"), F.lit(1 << 52)) + 0.5) / float(1 << 52))


@query("sampled_population")
def sampled(spark, d, draws: int = 100, seed: int = 17):
    """Summed per-stratum draws of an exact bound at a random level: median and 95 % range over replicates."""
    r = replicates(spark, survey(spark, d).where("labeled > 0"), draws, seed).withColumn("alpha", F.expr("1 - abs(2 * u - 1)"))
    x, n, a = F.col("positive"), F.col("labeled"), F.col("alpha")
    r = r.withColumn("share", F.when(F.col("u") < 0.5, exact_lower(x, n, a)).otherwise(exact_upper(x, n, a)))
    per = r.groupBy("replicate").agg(F.expr("sum(share * unlabeled + positive) as population"))
    return per.agg(F.expr("percentile(population, 0.5) as point"), F.expr("percentile(population, 0.025) as lower"), F.expr("percentile(population, 0.975) as upper"))


_SOURCES = """, rep as (select distinct annotator, tile_id as item, label from tile_annotation where label in ('purchase', 'click')), mult as (select item, label, count(*) as k from rep group by 1, 2),
    src as (select label, annotator, sum(1.0 / k) as w from rep join mult using (item, label) group by 1, 2), st as (select label, count(distinct annotator) as n from tile_annotation group by 1)"""


@query("multiplicity_estimate", ["tile_annotation"], _SOURCES + " select s.label, any_value(st.n) as sources, sum(w) as estimate from src s join st using (label) group by s.label")
def multiplicity(spark, d):
    """Items reported by several sources count 1/k for each, summed over all sources; nothing is sampled or scaled by N/n."""
    a = view(spark, d, "tile_annotation")
    rep = a.where("label in ('purchase', 'click')").select("annotator", F.col("tile_id").alias("item"), "label").distinct()
    k = rep.groupBy("item", "label").agg(F.count("*").alias("k"))
    w = rep.join(k, ["item", "label"]).groupBy("label").agg(F.expr("sum(1.0D / k) as estimate"))
    return a.groupBy("label").agg(F.count_distinct("annotator").alias("sources")).join(w, "label").select("label", "sources", "estimate")


_FRACTIONS = "case n when 1 then '1' when 2 then '1/2' when 3 then '1/3' else '1/4' end"


@query("tile_fractions", ["tile_annotation"], f", t as (select tile_id, count(distinct annotator) as n from tile_annotation where label = 'purchase' group by 1) select {_FRACTIONS} as fraction, count(*) as tiles from t group by 1")
def fractions(spark, d):
    t = view(spark, d, "tile_annotation").where("label = 'purchase'").groupBy("tile_id").agg(F.count_distinct("annotator").alias("n"))
    return t.groupBy(F.expr(_FRACTIONS).alias("fraction")).agg(F.count("*").alias("tiles"))


_CLASS = "case when status = 'labeled' and flagged and not positive then 'labeled negative' when positive then 'positive' when bucket in ('0', '1') then 'low confidence negative' else 'high confidence negative' end"


@query("tile_classes", _TC, _TILES + f", k as (select {_CLASS} as class, bucket from status where labeled and bucket is not null) select class, bucket, count(*) as tiles from k group by 1, 2")
def classes(spark, d):
    k = tile_status(spark, d).where("labeled and bucket is not null").select(F.expr(_CLASS).alias("class"), "bucket")
    return k.groupBy("class", "bucket").agg(F.count("*").alias("tiles"))


#: SQL: verdict of each annotator per kept tile, tiles with exactly two raters, paired in annotator order.
_PAIRS = _TILES + f""", v as (select a.tile_id, a.annotator, bool_or(a.label = 'purchase') as verdict from tile_annotation a join tile t on t.id = a.tile_id where t.bucket is not null group by 1, 2),
    pr as (select tile_id, min(annotator) as r1, max(annotator) as r2, arg_min(verdict, annotator) as a, arg_max(verdict, annotator) as b from v group by 1 having count(*) = 2),
    rated as (select pr.*, bucket, {_CLASS} as class from pr join status on id = tile_id)"""


def rated(spark, d: str) -> DataFrame:
    kept = tile_status(spark, d).where("bucket is not null").select(F.col("id").alias("tile_id"), "bucket", F.expr(_CLASS).alias("class"))
    v = view(spark, d, "tile_annotation").groupBy("tile_id", "annotator").agg(F.bool_or(F.col("label") == "purchase").alias("verdict"))
    p = v.groupBy("tile_id").agg(F.count("*").alias("n"), F.min("annotator").alias("r1"), F.max("annotator").alias("r2"), F.min_by("verdict", "annotator").alias("a"), F.max_by("verdict", "annotator").alias("b"))
    return p.where("n = 2").drop("n").join(kept, "tile_id")


@query("paired_ratings", _TC, _PAIRS + " select tile_id, r1, r2, a, b, bucket, class from rated")
def paired(spark, d):
    return rated(spark, d).select("tile_id", "r1", "r2", "a", "b", "bucket", "class")


def _kappa_sql(keys: str) -> str:
    return _PAIRS + f", t as (select {keys}, {_TABLE} from rated group by {keys}), s as (select *, {_SHARES} from t) select {keys}, n, both_true, both_false, n - both_true - both_false as disagree, po as agreement, {_KAPPA} as kappa from s"


def _kappa(df: DataFrame, *keys: str) -> DataFrame:
    t = df.groupBy(*keys).agg(*[F.expr(x) for x in _TABLE.split(", ")]).selectExpr("*", *_SHARES.split(", "))
    return t.selectExpr(*keys, "n", "both_true", "both_false", "n - both_true - both_false as disagree", "po as agreement", f"{_KAPPA} as kappa")


@query("agreement_by_class", _TC, _kappa_sql("class"))
def by_class(spark, d):
    return _kappa(rated(spark, d), "class")


@query("agreement_by_bucket", _TC, _kappa_sql("bucket"))
def by_bucket(spark, d):
    return _kappa(rated(spark, d), "bucket")


@query("rater_matrix", _TC, _kappa_sql("r1, r2"))
def rater_matrix(spark, d):
    return _kappa(rated(spark, d), "r1", "r2")


@query("balanced_agreement", _TC, _PAIRS + f""", pop as (select {_CLASS} as class, count(*) as size from status where labeled and bucket is not null group by 1), got as (select class, count(*) as n from rated group by 1),
    w as (select a, b, cast(size as double) / n as w from rated join pop using (class) join got using (class)),
    s as (select sum(case when a = b then w else 0 end) / sum(w) as po, sum(case when a then w else 0 end) / sum(w) as pa, sum(case when b then w else 0 end) / sum(w) as pb from w)
    select po as agreement, (po - (pa * pb + (1 - pa) * (1 - pb))) / (1 - (pa * pb + (1 - pa) * (1 - pb))) as kappa from s where po is not null""")
def balanced(spark, d):
    """Agreement with classes weighted to their share among all labeled tiles, in closed form."""
    pop = tile_status(spark, d).where("labeled and bucket is not null").groupBy(F.expr(_CLASS).alias("class")).agg(F.count("*").alias("size"))
    # one aggregate per class keeps the rated rows in place; the weights meet eight cells, not the rows
    cells = rated(spark, d).groupBy("class", "a", "b").agg(F.count("*").alias("k"))
    n = cells.groupBy("class").agg(F.sum("k").alias("n"))
    w = cells.join(n, "class").join(pop, "class").withColumn("w", F.expr("k * size / n"))
    s = w.agg(F.expr("sum(if(a = b, w, 0)) / sum(w) as po"), F.expr("sum(if(a, w, 0)) / sum(w) as pa"), F.expr("sum(if(b, w, 0)) / sum(w) as pb")).where("po is not null")
    return s.withColumn("pe", F.expr("pa * pb + (1 - pa) * (1 - pb)")).selectExpr("po as agreement", "(po - pe) / (1 - pe) as kappa")
