"""Resampled intervals and headline estimates over strata."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from geoledger.functions import estimates as est
from geoledger.operators.draws import binomial, interval, replicates, resampled_sum, uniform
from geoledger.operators.intervals import combined_estimate, exact_lower, exact_upper
from geoledger.operators.storage import materialize
from geoledger.plans.estimates import _GROUP, _TC, _TILES, survey, tile_status
from geoledger.plans.further import _WEIGHT, _WEIGHED, weights
from geoledger.plans.library import query, sites
from geoledger.plans.quality import facility_tile_ratio
from geoledger.sources.views import view


def bootstrap_total(strata: DataFrame, draws: int, seed: int) -> DataFrame:
    """(point, lower, upper): positives over all ``strata(stratum, labeled, positive)``, each drawn anew from a binomial of its
    labeled tiles, ``draws`` times. Strata without labels and those added afterwards take no part."""
    s = replicates(strata.where("labeled > 0 and stratum <> 'post hoc'"), draws)
    drawn = s.withColumn("hits", binomial(F.col("labeled"), F.col("positive") / F.col("labeled"), uniform(seed, "replicate", "stratum")))
    return interval(drawn.groupBy("replicate").agg(F.sum("hits").alias("total")), "total")


@query("bootstrap_positives")
def bootstrap_positives(spark, d, draws: int = 1000, seed: int = 23):
    """Median and central 95 % of resampled positives, beside those observed."""
    s = survey(spark, d)
    return bootstrap_total(s, draws, seed).join(s.where("labeled > 0").agg(F.sum("positive").alias("observed")))


def weight_classes(spark, d: str) -> DataFrame:
    """(stratum, total, sampled, positives, values, counts): the different weights of a stratum's positive tiles, and how many have them.

    Positive tiles are those of the sample and those of the same bucket and county group that were labeled for another reason.
    """
    t = tile_status(spark, d).where("labeled and bucket is not null")
    group = view(spark, d, "tile").withColumn("county", F.expr(_GROUP.replace("t.", ""))).join(view(spark, d, "county").select(F.col("id").alias("county"), "county_group"), "county", "left")
    t = t.join(group.select("id", F.expr("concat(bucket, ':', county_group)").alias("cell")), "id").join(weights(spark, d), "id", "left").withColumn("w", F.coalesce("w", F.lit(0.0)))
    classes = t.where("w > 0").groupBy(F.col("cell").alias("stratum"), "w").agg(F.count("*").alias("n"), F.count_if(F.expr("stratum = cell")).alias("sampled"))
    per = classes.groupBy("stratum").agg(F.sum("sampled").alias("positives"), F.sort_array(F.collect_list(F.struct("w", "n"))).alias("c"))
    s = survey(spark, d).where("labeled > 0 and stratum <> 'completed'").select("stratum", "total", F.col("labeled").alias("sampled"))
    return s.join(per, "stratum").select("stratum", "total", "sampled", "positives", F.col("c.w").alias("values"), F.col("c.n").alias("counts"))


@query("multiplicity_interval")
def multiplicity_interval(spark, d, draws: int = 1000, seed: int = 29):
    """Resampled range of the expanded multiplicity estimate: per stratum and replicate a binomial number of positive tiles, drawn with
    replacement from all positive tiles, times tiles over sampled tiles; summed over strata."""
    s = replicates(materialize(weight_classes(spark, d), "weight-classes"), draws)
    s = s.withColumn("hits", binomial(F.col("sampled"), F.col("positives") / F.col("sampled"), uniform(seed, "replicate", "stratum")))
    s = s.withColumn("x", F.expr("total / cast(sampled as double)") * resampled_sum(F.col("hits"), F.col("values"), F.col("counts"), F.xxhash64(F.lit(seed + 1), "replicate", "stratum")))
    return interval(s.groupBy("replicate").agg(F.sum("x").alias("estimate")), "estimate")


@query("bucket_totals", _TC, _TILES + """, b as (select coalesce(case when stratum = 'completed' then 'permit' else bucket end, 'removed') as own, coalesce(bucket, 'removed') as bucket, labeled, positive from status)
    select 'permit apart' as part, case when grouping(own) = 1 then 'Total' else own end as bucket, count(*) as tiles, count(case when labeled then 1 end) as labeled, count(case when positive then 1 end) as positive from b group by rollup(own)
    union all select 'by bucket', case when grouping(bucket) = 1 then 'Total' else bucket end, count(*), count(case when labeled then 1 end), count(case when positive then 1 end) from b group by rollup(bucket)""")
def bucket_totals(spark, d):
    """Tiles by bucket with their total: once with tiles labeled for their permits apart, once in their buckets."""
    s = tile_status(spark, d).select(F.expr("coalesce(case when stratum = 'completed' then 'permit' else bucket end, 'removed') as own"), F.expr("coalesce(bucket, 'removed') as bucket"), "labeled", "positive")

    def table(part: str, by: str):
        t = s.rollup(by).agg(F.grouping(by).alias("g"), F.count("*").alias("tiles"), F.count_if("labeled").alias("labeled"), F.count_if("positive").alias("positive"))
        return t.select(F.lit(part).alias("part"), F.expr(f"if(g = 1, 'Total', {by}) as bucket"), "tiles", "labeled", "positive")

    return table("permit apart", "own").union(table("by bucket", "bucket"))


@query("bucket_intervals")
def bucket_intervals(spark, d):
    """The same with the share of positives and its exact 95 % range; null where nothing is labeled."""
    t = bucket_totals(spark, d)
    x, n = F.col("positive"), F.col("labeled")
    return t.select("*", F.try_divide(x, n).alias("share"), exact_lower(x, n).alias("lower"), exact_upper(x, n).alias("upper"))


def headline_estimates(strata: DataFrame, tiles_per_facility, facilities) -> DataFrame:
    """(name, point, lower, upper) of one row of numbers and ``strata(stratum, total, labeled, unlabeled, positive)``.

    Bounds of a quotient change places where the divisor is an estimate (``swap``), so that they stay bounds;
    "as published" rows leave them in their places.
    """
    part = strata.withColumn("part", F.when(F.col("stratum").startswith("0:"), "0").when(F.col("stratum").startswith("1:"), "1").otherwise("rest"))
    by = combined_estimate(part.where("part <> 'rest'"), ["part"])
    done = part.where("part = 'rest'").agg(F.coalesce(F.sum("positive"), F.lit(0)).alias("done"))
    e0, e1 = (by.where(F.col("part") == p).select(est.estimate(F.col("point_n"), F.col("lower_n"), F.col("upper_n")).alias(f"e{p}"), F.col("total").alias(f"n{p}"), F.col("unlabeled").alias(f"u{p}"), F.col("positive").alias(f"x{p}")) for p in ("0", "1"))
    one = e0.join(e1).join(done).withColumn("tpf", tiles_per_facility).withColumn("seen", facilities)
    both = F.struct(*((F.col("e0")[c] + F.col("e1")[c] + F.col("done")).alias(c) for c in ("point", "lower", "upper")))
    one = one.withColumn("tiles", both).withColumn("observed", F.expr("x0 + x1 + done"))
    unseen = est.over(est.minus(F.col("tiles"), F.col("observed")), F.col("tpf"))
    rows = {
        "positive tiles": F.col("tiles"), "facilities": est.over(F.col("tiles"), F.col("tpf")), "unseen facilities": unseen,
        "completeness": est.share_of(F.col("seen"), unseen), "tile recall": est.under(F.col("observed"), F.col("tiles"), swap=True), "tile recall as published": est.under(F.col("observed"), F.col("tiles")),
        "false negative rate": est.over(F.col("e0"), F.col("n0")), "unobserved in bucket 0": est.minus(F.col("e0"), F.col("x0")), "unobserved in bucket 1": est.minus(F.col("e1"), F.col("x1")),
        "unlabeled in bucket 0": est.estimate(F.col("u0"), F.col("u0"), F.col("u0")), "tiles per facility": est.estimate(F.col("tpf"), F.col("tpf"), F.col("tpf")),
    }
    return reduce(DataFrame.union, [one.select(F.lit(k).alias("name"), v.alias("e")) for k, v in rows.items()]).select("name", "e.*")


@query("estimate_headlines")
def estimate_headlines(spark, d):
    """Headline estimates of positive tiles, facilities and completeness, from one materialized row of numbers."""
    ratio, n = facility_tile_ratio(spark, d), sites(spark, d).agg(F.count("*").alias("n"))
    row = ratio.join(n).first()
    return headline_estimates(materialize(survey(spark, d), "survey"), F.lit(float(row.tiles_per_facility)), F.lit(float(row.n)))


@query("completeness_checks")
def completeness_checks(spark, d):
    """Completeness and its lower bound against the least values that are expected."""
    c = estimate_headlines(spark, d).where("name = 'completeness'")
    row = lambda name, value, least: c.select(F.lit(name).alias("name"), F.col(value).alias("value"), F.lit(least).alias("least"), (F.col(value) > least).alias("ok"))
    return row("completeness", "point", 0.9).union(row("completeness, lower", "lower", 0.8))


@query("weights_by_stratum", _WEIGHED, _WEIGHT + """ select s.stratum, count(case when w.w > 0 then 1 end) as positive_tiles, coalesce(round(sum(w.w), 9), 0) as sites from strata s join status t on t.stratum = s.stratum and t.labeled left join weight w on w.tile = t.id group by s.stratum""")
def weights_by_stratum(spark, d):
    """Labeled tiles that show a site, and the sites they stand for, by stratum: what the resampling draws from."""
    t = tile_status(spark, d).where("stratum is not null and labeled").join(weights(spark, d), "id", "left")
    return t.groupBy("stratum").agg(F.count_if(F.expr("w > 0")).alias("positive_tiles"), F.coalesce(F.round(F.sum("w"), 9), F.lit(0.0)).alias("sites"))
