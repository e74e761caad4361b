"""Polygons of any form: predicates, distances, shared areas and hulls as joins over their edges.

A shape is a row ``(id, polys)`` with a unique id and polys an array of polygons; a polygon is an array of rings,
its outline first and then its holes; a ring is an array of ``struct<x: double, y: double>`` in metres, in
either direction, closed or not. Rings of one or two vertices are points and lines. Shapes without a
vertex have no edge and match nothing. Shapes are closed sets: touching counts as meeting.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from geoledger.operators.spatial import grid_join

POLYS = "array<array<array<struct<x: double, y: double>>>>"
#: Share of an area below which it counts as none.
EPS = 1e-9


def boxes(shapes: DataFrame) -> DataFrame:
    """``(id, xmin, ymin, xmax, ymax)`` of shapes that have a vertex."""
    v = shapes.select("id", F.expr("flatten(flatten(polys))").alias("v")).where("size(v) > 0")
    side = lambda f, c: F.expr(f"array_{f}(transform(v, p -> p.{c}))").alias(c + f)
    return v.select("id", *(side(f, c) for f in ("min", "max") for c in "xy"))


def edges(shapes: DataFrame) -> DataFrame:
    """``(id, ring, x1, y1, x2, y2, side, ox, oy)``: one row an edge.

    ``side`` is 1 where the shape lies to the left of the edge, -1 to the right, 0 for rings without an area. ``ox,
    oy`` is the shape's first vertex, to reckon from. A ring of one vertex is an edge from it to itself; other
    repeated vertices make no edge.
    """
    rings = shapes.select("id", F.posexplode("polys").alias("p", "rings")).select("id", "p", F.posexplode("rings").alias("k", "v"), F.expr("rings[0][0]").alias("o"))
    rings = rings.where("size(v) > 0").withColumn("c", F.expr("if(size(v) > 1 and v[0] = v[size(v) - 1], v, concat(v, array(v[0])))"))
    area = "aggregate(sequence(1, size(c) - 1), 0D, (s, i) -> s + (c[i - 1].x - v[0].x) * (c[i].y - v[0].y) - (c[i].x - v[0].x) * (c[i - 1].y - v[0].y))"
    rings = rings.withColumn("side", F.expr(f"cast(sign({area}) * if(k = 0, 1, -1) as int)"))
    e = rings.select("id", F.expr("100000 * p + k").alias("ring"), "side", "o", F.explode(F.expr("transform(sequence(1, size(c) - 1), i -> struct(c[i - 1] as a, c[i] as b))")).alias("e"), F.size("v").alias("n"))
    e = e.where("e.a <> e.b or n = 1")
    return e.selectExpr("id", "ring", "e.a.x as x1", "e.a.y as y1", "e.b.x as x2", "e.b.y as y2", "side", "o.x as ox", "o.y as oy")


def cross(ax: str, ay: str, bx: str, by: str, px: str, py: str) -> str:
    """SQL text: over 0 where p is left of the line from a to b."""
    return f"(({bx} - {ax}) * ({py} - {ay}) - ({by} - {ay}) * ({px} - {ax}))"


def crosses_ray(e: str, x: str, y: str) -> str:
    """SQL text: whether edge ``e`` crosses the ray from a point to the right; an edge holds its lower end only."""
    turn = cross(f"{e}.x1", f"{e}.y1", f"{e}.x2", f"{e}.y2", x, y)
    return f"((({e}.y1 > {y}) <> ({e}.y2 > {y})) and (({turn} > 0) = ({e}.y2 > {e}.y1)))"


def on_edge(e: str, x: str, y: str) -> str:
    """SQL text: whether a point lies on edge ``e``."""
    turn = cross(f"{e}.x1", f"{e}.y1", f"{e}.x2", f"{e}.y2", x, y)
    return f"({turn} = 0 and {x} between least({e}.x1, {e}.x2) and greatest({e}.x1, {e}.x2) and {y} between least({e}.y1, {e}.y2) and greatest({e}.y1, {e}.y2))"


def segments_meet(a: str, b: str) -> str:
    """SQL text: whether two edges have a common point."""
    turn = lambda e, f, k: f"sign({cross(f'{e}.x1', f'{e}.y1', f'{e}.x2', f'{e}.y2', f'{f}.x{k}', f'{f}.y{k}')})"
    apart = " and ".join(f"greatest(least({a}.{c}1, {a}.{c}2), least({b}.{c}1, {b}.{c}2)) <= least(greatest({a}.{c}1, {a}.{c}2), greatest({b}.{c}1, {b}.{c}2))" for c in "xy")
    return f"({apart} and {turn(a, b, 1)} * {turn(a, b, 2)} <= 0 and {turn(b, a, 1)} * {turn(b, a, 2)} <= 0)"


def point_segment_d2(px: str, py: str, e: str) -> str:
    """SQL text: squared distance of a point to an edge."""
    dx, dy = f"({e}.x2 - {e}.x1)", f"({e}.y2 - {e}.y1)"
    length = f"({dx} * {dx} + {dy} * {dy})"
    t = f"(case when {length} = 0 then 0e0 else least(1e0, greatest(0e0, (({px} - {e}.x1) * {dx} + ({py} - {e}.y1) * {dy}) / {length})) end)"
    return f"(pow({px} - {e}.x1 - {t} * {dx}, 2) + pow({py} - {e}.y1 - {t} * {dy}, 2))"


def segment_d2(a: str, b: str) -> str:
    """SQL text: squared distance of two edges."""
    ends = ", ".join(point_segment_d2(f"{x}.x{k}", f"{x}.y{k}", y) for x, y in ((a, b), (b, a)) for k in (1, 2))
    return f"(case when {segments_meet(a, b)} then 0e0 else least({ends}) end)"


def area_below_both(a: str, b: str, lo: str, hi: str, base: str) -> str:
    """SQL text: area over ``base`` and below both of two edges, from x = lo to x = hi, where both reach from lo to hi."""
    at = lambda e, x: f"({e}.y1 + ({e}.y2 - {e}.y1) * ({x} - {e}.x1) / ({e}.x2 - {e}.x1) - {base})"
    la, lb, ha, hb = at(a, lo), at(b, lo), at(a, hi), at(b, hi)
    # where the lower edge changes, at a share t of the way, both are as high as the first is there
    t = f"(({la} - {lb}) / (({la} - {lb}) - ({ha} - {hb})))"
    middle = f"({la} + {t} * ({ha} - {la}))"
    low, high = f"least({la}, {lb})", f"least({ha}, {hb})"
    return f"(({hi} - {lo}) / 2e0 * case when ({la} - {lb}) * ({ha} - {hb}) >= 0 then {low} + {high} else {t} * ({low} + {middle}) + (1 - {t}) * ({middle} + {high}) end)"


def _slabs(lo: str, hi: str, cell: float) -> str:
    return f"sequence(cast(floor({lo} / {cell}) as bigint), cast(floor({hi} / {cell}) as bigint))"


def points_in(points: DataFrame, shapes: DataFrame, cell: int = 1000, few: bool = False) -> DataFrame:
    """``(point, shape, on_edge)``: all pairs of ``points(id, x, y)`` and shapes that hold them.

    Boxes give candidates by a grid join. A point then meets only the edges of its candidates that lie in
    its own horizontal strip of height ``cell``; the parity of those that cross its ray is an aggregate. So a shape
    of very many edges costs a point one strip, and its rows are split as any skewed key. ``few`` as in ``grid_join``: shapes
    that don't grow with the data may be broadcast. Ids are unique; null places drop.
    """
    p = points.where("x is not null and y is not null").selectExpr("id", "double(x) as x", "double(y) as y")
    p = p.withColumns({"xmin": F.col("x"), "xmax": F.col("x"), "ymin": F.col("y"), "ymax": F.col("y")})
    near = grid_join(p, boxes(shapes), 0, cell, few).select(F.col("l.id").alias("point"), "l.x", "l.y", F.col("r.id").alias("shape"))
    near = near.withColumn("slab", F.expr(f"cast(floor(y / {cell}) as bigint)"))
    e = edges(shapes).withColumn("slab", F.explode(F.expr(_slabs("least(y1, y2)", "greatest(y1, y2)", cell)))).withColumnRenamed("id", "shape")
    e = e.select("shape", "slab", F.struct("x1", "y1", "x2", "y2").alias("e"))
    met = near.join(e if few else e.hint("merge"), ["shape", "slab"])
    found = met.groupBy("point", "shape").agg(F.expr(f"bool_or({on_edge('e', 'x', 'y')}) as on_edge"), F.expr(f"count_if({crosses_ray('e', 'x', 'y')}) % 2 = 1 as odd"))
    return found.where("on_edge or odd").select("point", "shape", "on_edge")


def _firsts(shapes: DataFrame) -> DataFrame:
    """``(id, shape, x, y)``: the first vertex of every ring, numbered."""
    v = shapes.select("id", F.posexplode(F.expr("transform(filter(flatten(polys), r -> size(r) > 0), r -> r[0])")).alias("k", "v"))
    return v.select(F.struct("id", "k").alias("id"), F.col("id").alias("shape"), "v.x", "v.y")


def near_shapes(left: DataFrame, right: DataFrame, within: float = 0, cell: int = 1000) -> DataFrame:
    """``(l, r, d2)``: all pairs of shapes at most ``within`` apart, and their squared distance; 0 where they meet.

    The distance is the least one of their edges, which are dealt to cells (``grid_join``), so that only edges near
    each other are compared. Where one shape holds the other no edges need be near: then a ring's first vertex lies in it.
    """
    box = lambda df: edges(df).selectExpr("id", "x1", "y1", "x2", "y2", "least(x1, x2) as xmin", "greatest(x1, x2) as xmax", "least(y1, y2) as ymin", "greatest(y1, y2) as ymax")
    pairs = grid_join(box(left), box(right), within, max(cell, int(within)))
    pairs = pairs.groupBy(F.col("l.id").alias("l"), F.col("r.id").alias("r")).agg(F.expr(f"min({segment_d2('l', 'r')}) as d2"))
    pairs = pairs.where(F.col("d2") <= float(within) ** 2)
    held = points_in(_firsts(left), right, cell).select(F.col("point.id").alias("l"), F.col("shape").alias("r"), F.lit(0.0).alias("d2"))
    holds = points_in(_firsts(right), left, cell).select(F.col("shape").alias("l"), F.col("point.id").alias("r"), F.lit(0.0).alias("d2"))
    return pairs.union(held).union(holds).groupBy("l", "r").agg(F.min("d2").alias("d2"))


def measures(shapes: DataFrame) -> DataFrame:
    """``(id, area, cx, cy)``: area without holes, and the centroid; the mean of edge ends where there is no area."""
    turn = "side * ((x1 - ox) * (y2 - oy) - (x2 - ox) * (y1 - oy))"
    s = edges(shapes).groupBy("id").agg(
        F.expr(f"sum({turn}) / 2 as area"), F.expr(f"sum({turn} * (x1 + x2 - 2 * ox)) / 6 as mx"), F.expr(f"sum({turn} * (y1 + y2 - 2 * oy)) / 6 as my"),
        F.expr("avg(x1 + x2) / 2 as ax"), F.expr("avg(y1 + y2) / 2 as ay"), F.first("ox").alias("ox"), F.first("oy").alias("oy"),
    )
    return s.selectExpr("id", "area", "if(area > 0, ox + mx / area, ax) as cx", "if(area > 0, oy + my / area, ay) as cy")


def shared_area(left: DataFrame, right: DataFrame, cell: int = 1000, few: bool = False) -> DataFrame:
    """``(l, r, shared)``: the area that two shapes share, for all pairs whose boxes meet.

    A shape's area is the sum of the areas below its edges, signed by their direction; so the area of two is the
    sum, over pairs of their edges, of the area below both, each with both signs. Edges of a pair meet in vertical
    strips of width ``cell``, to which their common stretch is cut. ``few`` as in ``grid_join``.
    """
    pairs = grid_join(boxes(left), boxes(right), 0, cell, few).select(F.col("l.id").alias("l"), F.col("r.id").alias("r"), F.least("l.ymin", "r.ymin").alias("base"))
    e = lambda df, name: edges(df).where("x1 <> x2 and side <> 0").select(
        F.col("id").alias(name), F.explode(F.expr(_slabs("least(x1, x2)", "greatest(x1, x2)", cell))).alias("strip"), F.struct("x1", "y1", "x2", "y2").alias(f"e{name}"), F.expr(f"side * sign(x1 - x2) as s{name}")
    )
    met = pairs.join(e(left, "l"), "l").join(e(right, "r"), ["r", "strip"])
    met = met.withColumn("lo", F.expr(f"greatest(least(el.x1, el.x2), least(er.x1, er.x2), strip * {cell}D)")).withColumn("hi", F.expr(f"least(greatest(el.x1, el.x2), greatest(er.x1, er.x2), (strip + 1) * {cell}D)"))
    got = met.where("lo < hi").groupBy("l", "r").agg(F.expr(f"sum(sl * sr * {area_below_both('el', 'er', 'lo', 'hi', 'base')}) as shared"))
    return got.withColumn("shared", F.greatest("shared", F.lit(0.0)))


def relate(left: DataFrame, right: DataFrame, cell: int = 1000) -> DataFrame:
    """``(l, r, shared, within, contains, touches)`` for all pairs that meet.

    ``within``: all of l's area lies in r (contains: the reverse); ``touches``: no area is shared. Shapes without an
    area are within nothing here; a share below EPS counts as none.
    """
    met = near_shapes(left, right, 0, cell).select("l", "r").join(shared_area(left, right, cell), ["l", "r"], "left").withColumn("shared", F.coalesce("shared", F.lit(0.0)))
    area = lambda df, x: measures(df).select(F.col("id").alias(x), F.col("area").alias(f"a{x}"))
    met = met.join(area(left, "l"), "l").join(area(right, "r"), "r")
    most = lambda a: f"({a} > 0 and shared >= {a} * (1 - {EPS}))"
    return met.selectExpr("l", "r", "shared", f"{most('al')} as within", f"{most('ar')} as contains", f"shared <= least(al, ar) * {EPS} as touches")


def _chain(x: list[float], y: list[float]) -> list[int]:
    """Places of the hull's corners, counterclockwise from the smallest (x, y); points are sorted and distinct."""
    if len(x) < 3:
        return list(range(len(x)))

    def half(order):
        out: list[int] = []
        for k in order:
            while len(out) > 1 and (x[out[-1]] - x[out[-2]]) * (y[k] - y[out[-2]]) - (y[out[-1]] - y[out[-2]]) * (x[k] - x[out[-2]]) <= 0:
                out.pop()
            out.append(k)
        return out[:-1]

    return half(range(len(x))) + half(range(len(x) - 1, -1, -1))


def _corners(keys: np.ndarray, x: np.ndarray, y: np.ndarray):
    """(key, x, y) of the hull's corners of each key, in order."""
    if not len(keys):
        return keys, x, y
    order = np.lexsort((y, x, keys))
    keys, x, y = keys[order], x[order], y[order]
    new = np.concatenate([[True], (keys[1:] != keys[:-1]) | (x[1:] != x[:-1]) | (y[1:] != y[:-1])])
    keys, x, y = keys[new], x[new], y[new]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])).tolist()
    at = [i + k for i, j in zip(first, [*first[1:], len(keys)], strict=True) for k in _chain(x[i:j].tolist(), y[i:j].tolist())]
    return keys[at], x[at], y[at]


def hulls(points: DataFrame, key: str = "key") -> DataFrame:
    """``(id, polys)``: the convex hull of the points ``(key, x, y)`` of each key (a bigint), as a shape.

    Every task first sends only the corners of its own hulls, by batch, so a key with a large share of all points
    reaches its group as a few rows a batch; hulls of hulls are merged there. Fewer than three points, or points on
    a line, are a ring of one or two vertices. Null keys and places drop.
    """

    def partial(batches):
        for b in batches:
            cols = _corners(*(b.column(k).to_numpy(zero_copy_only=False) for k in range(3)))
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["key", "x", "y"])

    def merge(group: pa.Table) -> pa.Table:
        keys, x, y = _corners(*(group.column(k).to_numpy() for k in range(3)))
        ring = [{"x": a, "y": b} for a, b in zip(x.tolist(), y.tolist(), strict=True)]
        kind = pa.list_(pa.list_(pa.list_(pa.struct([("x", pa.float64()), ("y", pa.float64())]))))
        return pa.table({"id": pa.array(keys[:1], pa.int64()), "polys": pa.array([[[ring]]], kind)})

    p = points.select(F.col(key).cast("long").alias("key"), F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")).dropna()
    return p.mapInArrow(partial, "key bigint, x double, y double").groupBy("key").applyInArrow(merge, f"id bigint, polys {POLYS}")


def canonical(polys: str) -> str:
    """SQL text: the same polygons in a fixed order, each ring from its smallest vertex, outlines counterclockwise and holes clockwise, closed."""
    opened = "if(size(r) > 1 and r[0] = r[size(r) - 1], slice(r, 1, size(r) - 1), r)"
    turn = "aggregate(sequence(1, size(r)), 0D, (s, i) -> s + (r[i - 1].x - r[0].x) * (r[i % size(r)].y - r[0].y) - (r[i % size(r)].x - r[0].x) * (r[i - 1].y - r[0].y))"
    turned = f"if(({turn} < 0) = (k = 0), reverse(r), r)"
    rolled = "concat(slice(r, array_position(r, array_min(r)), size(r)), slice(r, 1, array_position(r, array_min(r))))"
    ring = f"transform(transform(transform(g, (r, k) -> {opened}), (r, k) -> {turned}), (r, k) -> {rolled})"
    holes = "if(size(g) > 1, concat(slice(g, 1, 1), array_sort(slice(g, 2, size(g) - 1))), g)"
    return f"array_sort(transform(transform({polys}, g -> {ring}), g -> {holes}))"


def wkt(polys: str) -> str:
    """SQL text: MULTIPOLYGON text to the millimetre."""
    number = lambda c: f"cast(cast(p.{c} as decimal(18, 3)) as string)"
    ring = f"concat('(', array_join(transform(r, p -> concat({number('x')}, ' ', {number('y')})), ', '), ')')"
    return f"concat('MULTIPOLYGON (', array_join(transform({polys}, g -> concat('(', array_join(transform(g, r -> {ring}), ', '), ')')), ', '), ')')"
