"""Bridges: edges whose removal splits a component."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window as W, functions as F

from geoledger.operators.components import connected_components
from geoledger.operators.storage import materialize


def _bridges(g: pd.DataFrame) -> pd.DataFrame:
    near: dict = {}
    for u, v in zip(g.u, g.v):
        near.setdefault(u, []).append(v)
        near.setdefault(v, []).append(u)
    seen, low, found = {}, {}, []
    for root in near:
        if root in seen:
            continue
        stack = [(root, None, iter(near[root]))]
        seen[root] = low[root] = len(seen)
        while stack:
            node, parent, rest = stack[-1]
            for other in rest:
                if other not in seen:
                    seen[other] = low[other] = len(seen)
                    stack.append((other, node, iter(near[other])))
                    break
                if other != parent:
                    low[node] = min(low[node], seen[other])
            else:
                stack.pop()
                if stack:
                    low[parent] = min(low[parent], low[node])
                    if low[node] > seen[parent]:
                        found.append((min(node, parent), max(node, parent)))
    return pd.DataFrame([(g.component.iloc[0], a, b) for a, b in found], columns=["component", "u", "v"])


def _forest(edges: DataFrame) -> DataFrame:
    """``(u, v)`` of a spanning forest: each round every class takes its first edge that leaves it, and classes that are so joined become one."""
    e = materialize(edges.select("u", "v", F.col("u").alias("cu"), F.col("v").alias("cv")), "forest")
    found = None
    while True:
        ends = e.select(F.col("cu").alias("c"), F.struct("u", "v", "cu", "cv").alias("e")).union(e.select("cv", F.struct("u", "v", "cu", "cv")))
        taken = materialize(ends.groupBy("c").agg(F.min("e").alias("e")).select("e.*").distinct(), "taken")
        if taken.isEmpty():
            return e.select("u", "v") if found is None else found
        part = taken.select("u", "v")
        found = part if found is None else found.union(part)
        label = materialize(connected_components(taken.select(F.col("cu").alias("u"), F.col("cv").alias("v"))), "label")
        e = e.join(label.toDF("cu", "nu"), "cu").join(label.toDF("cv", "nv"), "cv").where("nu <> nv")
        e = materialize(e.select("u", "v", F.col("nu").alias("cu"), F.col("nv").alias("cv")), "forest")


def _bridges_by_tour(tagged: DataFrame) -> DataFrame:
    """Bridges of ``tagged(component, u, v)`` in rounds of joins.

    Edges outside a spanning forest have a random label; a node's label is the exclusive or of its
    edges' labels. A forest edge cuts its tree in two, and is a bridge just if the labels on one side cancel out. A tour
    along the forest meets one side's nodes between its two passes of the edge, so that suffix sums
    over the tour, which double their reach each round, give every side's label. Labels have 128 bits, so the
    chance of a wrong bridge is below 2^-100 for any table.
    """
    forest = materialize(_forest(tagged.select("u", "v")), "tree")
    rest = tagged.select("u", "v").join(forest, ["u", "v"], "left_anti").select("u", "v", F.xxhash64(F.lit(1), "u", "v").alias("p"), F.xxhash64(F.lit(2), "v", "u").alias("q"))
    label = rest.select(F.col("u").alias("a"), "p", "q").union(rest.select("v", "p", "q")).groupBy("a").agg(F.bit_xor("p").alias("p"), F.bit_xor("q").alias("q"))
    out = forest.select(F.col("u").alias("a"), F.col("v").alias("b")).union(forest.select("v", "u"))
    around = W.partitionBy("a").orderBy("b")
    out = out.withColumns({"k": F.row_number().over(around), "after": F.lead("b").over(around), "first": F.min("b").over(W.partitionBy("a"))})
    roots = tagged.select(F.col("component").alias("a")).distinct().withColumn("root", F.lit(True))
    out = materialize(out.join(roots, "a", "left").join(label, "a", "left"), "out")
    weight = lambda c: F.when(F.col("k") == 1, F.coalesce(c, F.lit(0))).otherwise(0)
    # the tour arrives by (b, a) and leaves by (a, after); at the root's last edge it ends
    last = F.col("after").isNull() & F.coalesce("root", F.lit(False))
    step = out.select(F.col("b").alias("a"), F.col("a").alias("b"), F.when(~last, F.col("a")).alias("na"), F.when(~last, F.coalesce("after", "first")).alias("nb"))
    own = out.select("a", "b", weight(F.col("p")).alias("wp"), weight(F.col("q")).alias("wq"))
    tour = materialize(step.join(own, ["a", "b"]).select("a", "b", "na", "nb", "wp", "wq", F.col("wp").alias("p"), F.col("wq").alias("q")), "tour")
    while not (going := tour.where("na is not null")).isEmpty():
        ahead = tour.select(F.col("a").alias("na"), F.col("b").alias("nb"), F.col("na").alias("ma"), F.col("nb").alias("mb"), F.col("p").alias("ap"), F.col("q").alias("aq"))
        moved = going.join(ahead, ["na", "nb"]).select("a", "b", F.col("ma").alias("na"), F.col("mb").alias("nb"), "wp", "wq", F.col("p").bitwiseXOR(F.col("ap")).alias("p"), F.col("q").bitwiseXOR(F.col("aq")).alias("q"))
        tour = materialize(moved.union(tour.where("na is null")), "tour")
    past = tour.select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v"), F.col("p").bitwiseXOR(F.col("wp")).alias("p"), F.col("q").bitwiseXOR(F.col("wq")).alias("q"))
    cut = past.groupBy("u", "v").agg(F.bit_xor("p").alias("p"), F.bit_xor("q").alias("q")).where("p = 0 and q = 0").select("u", "v")
    return tagged.join(cut, ["u", "v"]).select("component", "u", "v")


def bridges(edges: DataFrame, in_task: int = 200_000) -> DataFrame:
    """``(component, u, v)`` of the bridges of ``edges(u, v)`` with integer nodes, u < v.

    A component of at most ``in_task`` edges is walked in one task; larger ones are solved together in
    rounds of joins (`_bridges_by_tour`), whatever their size. Loops, null ends and repeated edges are
    ignored; an empty table gives an empty one.
    """
    e = edges.where("u is not null and v is not null and u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()
    e = materialize(e, "bridge")
    tagged = materialize(e.join(connected_components(e).withColumnRenamed("node", "u"), "u").select("component", "u", "v"), "bridge")
    large = materialize(tagged.groupBy("component").count().where(F.col("count") > in_task).select("component"), "large")
    small = tagged.join(large, "component", "left_anti").groupBy("component").applyInPandas(_bridges, "component bigint, u bigint, v bigint")
    return small if large.isEmpty() else small.union(_bridges_by_tour(tagged.join(large, "component", "left_semi")))
