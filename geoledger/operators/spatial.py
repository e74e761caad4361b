"""Spatial joins as equi joins on grid cells with an exact test."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from geoledger.operators.storage import materialize


def _cells(lo: str, hi: str, cell: int) -> str:
    return f"sequence(cast(floor({lo} / {cell}) as bigint), cast(floor({hi} / {cell}) as bigint))"


def box_distance2(l: str, r: str) -> Column:
    """Squared distance of two boxes; 0 when they touch or overlap."""
    dx = f"greatest(0, {l}.xmin - {r}.xmax, {r}.xmin - {l}.xmax)"
    dy = f"greatest(0, {l}.ymin - {r}.ymax, {r}.ymin - {l}.ymax)"
    return F.expr(f"{dx} * {dx} + {dy} * {dy}")


def boxes_of_points(df: DataFrame, x: str, y: str) -> DataFrame:
    """Points as empty boxes; rows without a position have none and drop out."""
    found = df.where(f"{x} is not null and {y} is not null")
    return found.withColumns({"xmin": F.col(x), "xmax": F.col(x), "ymin": F.col(y), "ymax": F.col(y)})


def grid_join(left: DataFrame, right: DataFrame, within: int, cell: int | None = None, few: bool = False) -> DataFrame:
    """``(l, r, d2)``: structs of all pairs of boxes at most ``within`` apart, and squared distance.

    Both sides are dealt to the cells they touch (the left one grown by ``within``), joined on the
    cell, and kept in the one cell that holds the pair's larger lower-left corner, so no distinct
    is needed. Cells are at least ``within`` wide; a dense cell is a skewed key of a sort-merge
    join, which Spark splits. The join is always sorted and merged: Spark takes a side's size from
    its compressed files, before its boxes are dealt to cells, and would send through the driver
    what is many times as large. ``few`` leaves that to Spark, for a right side that doesn't grow
    with the data. Boxes with null bounds match nothing.
    """
    cell = cell or max(within, 1)
    l = left.select(F.struct(*left.columns).alias("l")).where("l.xmin is not null")
    r = right.select(F.struct(*right.columns).alias("r")).where("r.xmin is not null")
    l = l.withColumn("cx", F.expr(f"explode({_cells(f'(l.xmin - {within})', f'(l.xmax + {within})', cell)})"))
    l = l.withColumn("cy", F.expr(f"explode({_cells(f'(l.ymin - {within})', f'(l.ymax + {within})', cell)})"))
    r = r.withColumn("cx", F.expr(f"explode({_cells('r.xmin', 'r.xmax', cell)})"))
    r = r.withColumn("cy", F.expr(f"explode({_cells('r.ymin', 'r.ymax', cell)})"))
    pairs = l.join(r if few else r.hint("merge"), ["cx", "cy"])
    own = f"cx = floor(greatest(l.xmin - {within}, r.xmin) / {cell}) and cy = floor(greatest(l.ymin - {within}, r.ymin) / {cell})"
    return pairs.where(own).withColumn("d2", box_distance2("l", "r")).where(F.col("d2") <= within * within).select("l", "r", "d2")


def self_pairs(boxes: DataFrame, within: int) -> DataFrame:
    """``(id_a, id_b, d2)`` with id_a < id_b of boxes at most ``within`` apart."""
    got = grid_join(boxes, boxes, within).where("l.id < r.id")
    return got.select(F.col("l.id").alias("id_a"), F.col("r.id").alias("id_b"), "d2")


def nearest(left: DataFrame, right: DataFrame, start: int, apart: str = "true") -> DataFrame:
    """``(id, other, d2)``: the nearest right box of every left one, ties to the smallest id.

    Rows without a match within ``start`` are retried at twice the reach. Cells stay an eighth of the reach at
    most (``start`` at least), so a far row meets a dense place as many small keys, not as one. ``apart`` may forbid pairs (of ``l`` and ``r``). Left rows with null bounds, or
    with nothing to be near to within the data's extent, have no row.
    """
    if right.where("xmin is not null").isEmpty():
        return left.sparkSession.createDataFrame([], "id bigint, other bigint, d2 bigint")
    both = left.select("xmin", "ymin", "xmax", "ymax").union(right.select("xmin", "ymin", "xmax", "ymax"))
    lo_x, lo_y, hi_x, hi_y = both.agg(F.min("xmin"), F.min("ymin"), F.max("xmax"), F.max("ymax")).first()
    found, rest, reach = None, left.where("xmin is not null"), start
    while True:
        hits = grid_join(rest, right, reach, max(start, reach // 8)).where(apart).groupBy(F.col("l.id").alias("id")).agg(F.min(F.struct("d2", F.col("r.id").alias("other"))).alias("t"))
        hits = materialize(hits.select("id", "t.other", "t.d2"), "near")
        found = hits if found is None else found.union(hits)
        if lo_x is None or reach > (hi_x - lo_x) + (hi_y - lo_y):
            return found
        rest = materialize(rest.join(hits.hint("merge"), "id", "left_anti"), "rest")
        if rest.isEmpty():
            return found
        reach *= 2
