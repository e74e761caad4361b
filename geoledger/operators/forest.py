"""Minimum spanning forests: one run answers every threshold on the edges' weights."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from geoledger.operators.components import connected_components
from geoledger.operators.storage import materialize


def minimum_forest(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``(u, v, w)``, u < v: a spanning forest of ``edges(u, v, w)`` of least weight.

    For every threshold t, nodes are connected by edges of weight up to t just if they are by forest
    edges of weight up to t. Ties are taken in order of (w, u, v), so the result is the only one. Null ends or
    weights and loops are ignored; of several edges between two nodes the lightest counts; an empty input gives none.

    In each round every class takes its first edge that leaves it, and classes that are so joined become one: at
    most half as many are left. A round is minimum aggregates and joins on classes, written once.
    """
    e = edges.where("u is not null and v is not null and w is not null and u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"), "w")
    e = e.groupBy("u", "v").agg(F.min("w").alias("w"))
    e = materialize(e.select("u", "v", "w", F.col("u").alias("cu"), F.col("v").alias("cv")), "forest")
    found = None
    for _ in range(max_rounds):
        first = F.struct("w", "u", "v", "cu", "cv")
        ends = e.select(F.col("cu").alias("c"), first.alias("e")).union(e.select("cv", first))
        taken = materialize(ends.groupBy("c").agg(F.min("e").alias("e")).select("e.*").distinct(), "taken")
        if taken.isEmpty():
            return e.select("u", "v", "w") if found is None else found
        part = taken.select("u", "v", "w")
        found = part if found is None else found.union(part)
        label = materialize(connected_components(taken.select(F.col("cu").alias("u"), F.col("cv").alias("v"))), "label")
        # every class with an edge took one, so all of them have a label
        e = e.join(label.toDF("cu", "nu"), "cu").join(label.toDF("cv", "nv"), "cv").where("nu <> nv")
        e = materialize(e.select("u", "v", "w", F.col("nu").alias("cu"), F.col("nv").alias("cv")), "forest")
    raise RuntimeError(f"the forest did not settle in {max_rounds} rounds")


def clusters_at(forest: DataFrame, threshold) -> DataFrame:
    """``(node, component)`` of nodes with a forest edge of at most this weight."""
    return connected_components(forest.where(F.col("w") <= threshold).select("u", "v"))


def cluster_counts(nodes: DataFrame, forest: DataFrame, thresholds: list) -> DataFrame:
    """``(threshold, clusters)``: of all ``nodes(id)``; each forest edge up to a threshold joins two clusters."""
    spark = nodes.sparkSession
    steps = spark.createDataFrame([(t,) for t in thresholds], f"threshold {dict(forest.dtypes)['w']}")
    n = nodes.agg(F.count("*").alias("n"))
    got = forest.join(F.broadcast(steps), F.col("w") <= F.col("threshold")).groupBy("threshold").agg(F.count("*").alias("edges"))
    return steps.join(got, "threshold", "left").join(n).select("threshold", (F.col("n") - F.coalesce("edges", F.lit(0))).alias("clusters"))


def differing_groups(nodes: DataFrame, forest: DataFrame, reference: DataFrame, thresholds: list) -> DataFrame:
    """``(threshold, component, clusters, reference_clusters, differs)`` of every group that all forest edges make of ``nodes(id)``.

    ``reference(node, label)`` is another clustering of the nodes; those without a label are their own. A group differs at a
    threshold if its clusters there aren't the reference's: if an edge up to it joins two labels, or the numbers differ.
    """
    spark = nodes.sparkSession
    steps = spark.createDataFrame([(t,) for t in thresholds], f"threshold {dict(forest.dtypes)['w']}")
    group = connected_components(forest.select("u", "v"))
    all_ = nodes.select(F.col("id").alias("node")).join(group, "node", "left").join(reference, "node", "left")
    all_ = materialize(all_.select("node", F.coalesce("component", "node").alias("component"), F.coalesce(F.col("label").cast("string"), F.concat(F.lit("own "), F.col("node").cast("string"))).alias("label")), "groups")
    sizes = all_.groupBy("component").agg(F.count("*").alias("size"), F.count_distinct("label").alias("reference_clusters"))
    ends = forest.join(all_.select(F.col("node").alias("u"), "component", F.col("label").alias("lu")), "u").join(all_.select(F.col("node").alias("v"), F.col("label").alias("lv")), "v")
    at = ends.join(F.broadcast(steps), F.col("w") <= F.col("threshold")).groupBy("threshold", "component").agg(F.count("*").alias("edges"), F.bool_or(F.expr("lu <> lv")).alias("across"))
    out = sizes.join(F.broadcast(steps)).join(at, ["threshold", "component"], "left").withColumn("clusters", F.col("size") - F.coalesce("edges", F.lit(0)))
    return out.select("threshold", "component", "clusters", "reference_clusters", (F.coalesce("across", F.lit(False)) | (F.col("clusters") != F.col("reference_clusters"))).alias("differs"))
