"""Connected components by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from geoledger.operators.storage import materialize


#: Up to so many edges a round is done in one partition, with fewer exchanges, for each of which Spark's driver starts a thread.
FEW = 50_000


def _same(df: DataFrame) -> DataFrame:
    return df


def _one(df: DataFrame) -> DataFrame:
    return df.coalesce(1).hint("merge")


def _large_star(edges: DataFrame, dealt=_same) -> DataFrame:
    both = dealt(edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))))
    low = dealt(materialize(both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m")), "cc-low"))
    return both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame, dealt=_same) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    low = dealt(materialize(down.groupBy("u").agg(F.min("v").alias("m")), "cc-low"))
    hung = down.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return dealt(hung.union(low.select("u", F.col("m").alias("v"))))


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def connected_components(edges: DataFrame, max_rounds: int = 40) -> DataFrame:
    """Label every node of ``edges(u, v)`` with the smallest node it can reach.

    Returns ``(node, component)`` for nodes that occur in an edge, each once. Ids are any
    orderable type. Null ends and loops are ignored; an empty input gives an empty result.
    Each round is two minimum aggregates, each written and then joined back on its key, so that
    Spark can split a hub's edges over tasks; they are never gathered in a list. Rounds are cut with files in the shared folder; the driver
    sees only a count and a checksum per round. At most FEW edges are kept in one partition. The rounds stop when the edge set is a star
    forest that no longer changes; if ``max_rounds`` passes first, a RuntimeError is raised
    rather than a wrong labelling returned.
    """
    e = edges.where("u is not null and v is not null and u <> v").select("u", "v").distinct()
    e = materialize(e, "cc")
    before = _state(e)
    if not before[0]:
        return e.select(F.col("u").alias("node"), F.col("v").alias("component"))
    for _ in range(max_rounds):
        dealt = _one if before[0] <= FEW else _same
        e = dealt(materialize(_small_star(_large_star(e, dealt).distinct(), dealt).distinct(), "cc"))
        after = _state(e)
        if after == before:
            members = e.select(F.col("u").alias("node"), F.col("v").alias("component"))
            roots = e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
            return members.union(roots)
        before = after
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")


def member_digest(node: str) -> Column:
    """Aggregate: 120 bits that depend on a group's members and not on their order, so that nothing is gathered.

    Two sums of 60-bit pieces of the members' MD5; groups with one digest and one size are taken as equal.
    """
    piece = lambda at: F.sum(F.conv(F.substring(F.md5(F.col(node).cast("string")), at, 15), 16, 10).cast("decimal(20,0)")).cast("string")
    return F.md5(F.concat_ws(":", piece(1), piece(17)))
