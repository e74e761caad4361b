"""Snapshots, reruns, a lost driver and two writers; forests, draws and estimates against plain Python."""

import math
import random
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from geoledger.functions import estimates as est
from geoledger.operators import draws, forest, intervals
from geoledger.operators.components import connected_components
from geoledger.operators.versions import VersionedTable
from geoledger.plans import inference

PARCEL = "county string, number string, owner string, archived_at string"


def rows(table):
    return sorted(tuple(r) for r in table.read().collect())


def test_first_delivery_wins_and_reruns_change_nothing(spark, tmp_path):
    t = VersionedTable(spark, str(tmp_path / "parcels"), PARCEL)
    assert t.read().count() == 0 and t.number == 0
    first = spark.createDataFrame([("A", "1", "x", None), ("A", "1", "later", None), ("A", "2", "y", None), (None, "3", "no key", None)], PARCEL).withColumn("k", F.monotonically_increasing_id())
    assert t.insert_new(first, ["county", "number"], [F.col("k")]) == 1
    assert rows(t) == [("A", "1", "x", None), ("A", "2", "y", None)]
    assert t.insert_new(first, ["county", "number"], [F.col("k")]) == 1  # a rerun
    more = spark.createDataFrame([("A", "1", "z", None), ("B", "1", "w", None)], PARCEL)
    assert t.insert_new(more, ["county", "number"], [F.col("owner")]) == 2
    assert rows(t)[-1] == ("B", "1", "w", None) and len(rows(t)) == 3 and t.read(1).count() == 2
    with pytest.raises(ValueError, match="no version 7"):
        t.read(7)


def test_soft_delete_edits_and_relabels(spark, tmp_path):
    t = VersionedTable(spark, str(tmp_path / "f"), PARCEL)
    t.insert_new(spark.createDataFrame([("A", "1", "x", None), ("A", "2", None, "2020"), ("B", "3", "y", None)], PARCEL), ["county", "number"], [F.col("owner")])
    assert t.archive(F.lit("2024"), where="county = 'A'") == 2
    assert t.archive(F.lit("2025"), where="county = 'A'") == 2  # nothing is left to archive
    assert rows(t) == [("A", "1", "x", "2024"), ("A", "2", None, "2020"), ("B", "3", "y", None)]
    assert t.edit("owner is null", {"owner": F.lit("new")}) == 3 and t.edit("owner = 'new'", {"owner": F.lit("new")}) == 3
    assert t.put(spark.createDataFrame([("B", "3", "z", None), ("C", "4", "q", None)], PARCEL), ["county", "number"]) == 4
    gone, put = spark.createDataFrame([("A",)], "county string"), spark.createDataFrame([("D", "5", "r", None), ("D", "5", "r", None)], PARCEL)
    assert t.remove_then_insert(put, ["county", "number"], gone) == 5
    assert rows(t) == [("B", "3", "z", None), ("C", "4", "q", None), ("D", "5", "r", None)]
    assert t.remove_then_insert(put, ["county", "number"], gone) == 5


def test_a_lost_driver_and_a_second_writer(spark, tmp_path, monkeypatch):
    t = VersionedTable(spark, str(tmp_path / "f"), PARCEL)
    one = spark.createDataFrame([("A", "1", "x", None)], PARCEL)
    t.insert_new(one, ["county", "number"], [F.col("owner")])
    # a driver that dies after its snapshot leaves no version
    spark.createDataFrame([("Z", "9", "lost", None)], PARCEL).write.parquet(str(tmp_path / "f" / "sdead"))
    again = VersionedTable(spark, str(tmp_path / "f"), PARCEL)
    assert rows(again) == [("A", "1", "x", None)] and again.number == 1
    (tmp_path / "f" / "marks" / "000000002").touch()  # nor does one that dies while it makes the mark
    assert rows(again) == [("A", "1", "x", None)] and again.number == 2
    # two writers from version 2: the second one fails and the first one's content stays
    both = spark.createDataFrame([("B", "2", "y", None)], PARCEL)
    assert t.replace(t.read().unionByName(both), 2) == 3
    with pytest.raises(RuntimeError, match="another writer"):
        again.replace(one, 2)
    assert len(rows(t)) == 2


def test_forest_answers_every_threshold(spark):
    rng = random.Random(4)
    edges = [(rng.randrange(60), rng.randrange(60), rng.choice([1, 2, 2, 3, 5, 9])) for _ in range(110)] + [(7, 7, 1), (1, None, 2), (100, 101, None), (3, 4, 9), (4, 3, 1)]
    table = spark.createDataFrame(edges, "u bigint, v bigint, w bigint")
    tree = forest.minimum_forest(table)
    assert tree.count() == len({(r.u, r.v) for r in tree.collect()})
    nodes = spark.range(60)
    counts = {r.threshold: r.clusters for r in forest.cluster_counts(nodes, tree, [0, 1, 2, 3, 5, 9]).collect()}
    reference = spark.createDataFrame([(k, k // 3) for k in range(0, 60, 2)], "node bigint, label bigint")
    differing = {(r.threshold, r.component): (r.clusters, r.reference_clusters, r.differs) for r in forest.differing_groups(nodes, tree, reference, [1, 3, 9]).collect()}
    kept = [(u, v, w) for u, v, w in edges if v is not None and w is not None and u != v]

    def labels(t):
        own = {k: k for k in range(60)}
        changed = True
        while changed:
            changed = False
            for u, v, w in kept:
                if w <= t and own[u] != own[v]:
                    own[u] = own[v] = min(own[u], own[v])
                    changed = True
        return own

    for t in counts:
        assert counts[t] == len(set(labels(t).values()))
    groups = labels(9)
    for t in (1, 3, 9):
        own = labels(t)
        for g in set(groups.values()):
            m = [k for k in range(60) if groups[k] == g]
            ref = {k: k // 3 if k % 2 == 0 else f"own {k}" for k in m}
            same = all((own[a] == own[b]) == (ref[a] == ref[b]) for a, b in combinations(m, 2))
            assert differing[t, g] == (len({own[k] for k in m}), len(set(ref.values())), not same)
    assert {(r.node, r.component) for r in forest.clusters_at(tree, 2).collect()} == {(r.node, r.component) for r in connected_components(table.where("w <= 2").select("u", "v")).collect()}
    assert forest.minimum_forest(table.where("w > 99")).count() == 0


def test_binomial_quantiles_are_the_inverse_of_the_sum(spark):
    for n, p in ((1, 0.3), (7, 0.5), (40, 0.02), (200, 0.97)):
        pmf = [math.comb(n, k) * p**k * (1 - p) ** (n - k) for k in range(n + 1)]
        u = np.linspace(0.001, 0.999, 57)
        assert draws.binomial_quantile(np.full(57, n), np.full(57, p), u).tolist() == [int(np.searchsorted(np.cumsum(pmf), x - 1e-12)) for x in u]
    assert draws.binomial_quantile(np.array([0, 5, 5, -1]), np.array([0.5, 0.0, 1.0, 0.5]), np.full(4, 0.5)).tolist() == [0, 0, 5, 0]
    share = intervals.beta_share(np.array([0.0, 0.3, 1.0, 0.5]), np.array([2.0, 2.0, 2.0, 1.0]), np.array([3.0, 3.0, 3.0, 1.0]))
    assert share == pytest.approx([0, 1 - 0.7**4 - 4 * 0.3 * 0.7**3, 1, 0.5])


def test_draws_have_their_mean_and_variance_and_do_not_change(spark):
    s = spark.createDataFrame([("a", 80, 20, 100), ("b", 50, 0, 50), ("c", 10, 10, 10)], "stratum string, labeled int, positive int, total int")
    d = draws.replicates(s, 4000).withColumn("k", draws.binomial(F.col("labeled"), F.col("positive") / F.col("labeled"), draws.uniform(5, "replicate", "stratum")))
    got = {r.stratum: (r.m, r.v) for r in d.groupBy("stratum").agg(F.avg("k").alias("m"), F.var_samp("k").alias("v")).collect()}
    assert got["a"][0] == pytest.approx(20, abs=0.3) and got["a"][1] == pytest.approx(15, rel=0.1) and got["b"] == (0, 0) and got["c"] == (10, 0)
    at = lambda df: sorted(tuple(r) for r in df.select("stratum", "replicate", "k").collect())
    assert at(d) == at(draws.replicates(s.repartition(7), 4000).withColumn("k", draws.binomial(F.col("labeled"), F.col("positive") / F.col("labeled"), draws.uniform(5, "replicate", "stratum"))))
    total = inference.bootstrap_total(s, 2000, 9).first()
    assert total.point == pytest.approx(30, abs=1) and total.lower < 25 and total.upper > 35
    values = draws.replicates(s.where("stratum = 'a'"), 4000).withColumn("x", draws.resampled_sum(F.lit(10), F.array(F.lit(0.5), F.lit(1.0), F.lit(3.0)), F.array(F.lit(2), F.lit(1), F.lit(1)), F.xxhash64("replicate")))
    m = values.agg(F.avg("x").alias("m"), F.var_samp("x").alias("v")).first()
    assert m.m == pytest.approx(12.5, abs=0.15) and m.v == pytest.approx(10 * ((0.5 + 1 + 9) / 4 - 1.25**2), rel=0.1)


def test_estimate_arithmetic(spark):
    df = spark.createDataFrame([(10.0, 5.0, 20.0), (0.0, 0.0, 4.0)], "p double, l double, u double").withColumn("e", est.estimate(F.col("p"), F.col("l"), F.col("u")))
    one = lambda e: [tuple(r.x) for r in df.select(e.alias("x")).collect()]
    assert one(est.plus(F.col("e"), 1))[0] == (11, 6, 21) and one(est.minus(F.col("e"), 1))[0] == (9, 4, 19) and one(est.times(F.col("e"), 2))[0] == (20, 10, 40)
    assert one(est.over(F.col("e"), 5))[0] == (2, 1, 4) and one(est.over(F.col("e"), 0))[0] == (None, None, None)
    assert one(est.under(10, F.col("e"))) == [(1, 2, 0.5), (float("inf"), float("inf"), 2.5)]
    assert one(est.under(10, F.col("e"), swap=True)) == [(1, 0.5, 2), (float("inf"), 2.5, float("inf"))]
    assert one(est.share_of(10, F.col("e")))[0] == (0.5, 10 / 30, 10 / 15)


def test_headline_estimates(spark):
    s = spark.createDataFrame([("0:1", 1000, 500, 500, 0), ("1:1", 100, 50, 50, 40), ("completed", 30, 30, 0, 12)], "stratum string, total int, labeled int, unlabeled int, positive int")
    got = {r.name: r for r in inference.headline_estimates(s, F.lit(2.0), F.lit(26.0)).collect()}
    assert got["positive tiles"].point == 0 + 80 + 12 and got["facilities"].point == 46 and got["unseen facilities"].point == 20
    assert got["completeness"].point == pytest.approx(26 / 46) and got["completeness"].lower < got["completeness"].point < got["completeness"].upper
    assert got["tile recall"].point == pytest.approx(52 / 92) and got["tile recall as published"].lower == got["tile recall"].upper
    assert got["unobserved in bucket 1"].point == 40 and got["unlabeled in bucket 0"].point == 500 and got["false negative rate"].point == 0
