"""Polygons of any form against plain Python over exact fractions, and known values."""

import random
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from geoledger.operators import polygons as pg


def frame(spark, shapes):
    """shapes: id -> list of polygons of rings of (x, y)."""
    return spark.createDataFrame([(k, [[[{"x": float(x), "y": float(y)} for x, y in r] for r in p] for p in polys]) for k, polys in shapes.items()], f"id bigint, polys {pg.POLYS}")


def ring_edges(polys):
    for p in polys:
        for r in p:
            r = r if len(r) == 1 or r[0] != r[-1] else r[:-1]
            yield from [(r[k], r[(k + 1) % len(r)]) for k in range(len(r))]


def turn(a, b, p):
    return (b[0] - a[0]) * (p[1] - a[1]) - (b[1] - a[1]) * (p[0] - a[0])


def on(a, b, p):
    return turn(a, b, p) == 0 and min(a[0], b[0]) <= p[0] <= max(a[0], b[0]) and min(a[1], b[1]) <= p[1] <= max(a[1], b[1])


def holds(polys, p):
    odd = False
    for a, b in ring_edges(polys):
        if on(a, b, p):
            return True
        if (a[1] > p[1]) != (b[1] > p[1]) and p[0] < a[0] + Fraction((p[1] - a[1]) * (b[0] - a[0]), b[1] - a[1]):
            odd = not odd
    return odd


def point_d2(p, a, b):
    n = (b[0] - a[0]) ** 2 + (b[1] - a[1]) ** 2
    t = min(1, max(0, Fraction((p[0] - a[0]) * (b[0] - a[0]) + (p[1] - a[1]) * (b[1] - a[1]), n))) if n else 0
    return (p[0] - a[0] - t * (b[0] - a[0])) ** 2 + (p[1] - a[1] - t * (b[1] - a[1])) ** 2


def meet(a, b, c, d):
    s = lambda v: (v > 0) - (v < 0)
    if on(a, b, c) or on(a, b, d) or on(c, d, a) or on(c, d, b):
        return True
    return s(turn(a, b, c)) * s(turn(a, b, d)) < 0 and s(turn(c, d, a)) * s(turn(c, d, b)) < 0


def distance2(s, t):
    if holds(t, next(ring_edges(s))[0]) or holds(s, next(ring_edges(t))[0]):
        return 0
    if any(holds(t, a) for a, _ in ring_edges(s)) or any(holds(s, a) for a, _ in ring_edges(t)):
        return 0
    return min(0 if meet(a, b, c, d) else min(point_d2(a, c, d), point_d2(b, c, d), point_d2(c, a, b), point_d2(d, a, b)) for a, b in ring_edges(s) for c, d in ring_edges(t))


def star(rng, x, y, size, n):
    """A ring around a place whose corners lie at rising angles."""
    around = sorted({(rng.randint(-size, size), rng.randint(-size, size)) for _ in range(n)} - {(0, 0)}, key=lambda p: __import__("math").atan2(p[1], p[0]))
    ring = [(x + a, y + b) for a, b in around]
    return ring if rng.random() < 0.5 else ring[::-1]


def area_by_strips(s, t):
    """Exact area of what both hold: between neighbouring corners and crossings all borders are straight."""
    cuts = set()
    es, et = ([e for e in ring_edges(x) if e[0][0] != e[1][0]] for x in (s, t))
    for a, b in [*ring_edges(s), *ring_edges(t)]:
        cuts |= {Fraction(a[0]), Fraction(b[0])}
    at = lambda e, x: Fraction(e[0][1]) + Fraction(e[1][1] - e[0][1], e[1][0] - e[0][0]) * (x - e[0][0])
    both = es + et
    for i, e in enumerate(both):
        for f in both[i + 1 :]:
            m1, m2 = (Fraction(g[1][1] - g[0][1], g[1][0] - g[0][0]) for g in (e, f))
            if m1 != m2:
                x = (at(f, Fraction(0)) - at(e, Fraction(0))) / (m1 - m2)
                if max(min(e[0][0], e[1][0]), min(f[0][0], f[1][0])) <= x <= min(max(e[0][0], e[1][0]), max(f[0][0], f[1][0])):
                    cuts.add(x)
    total, cuts = Fraction(0), sorted(cuts)
    for lo, hi in zip(cuts, cuts[1:], strict=False):
        mid = (lo + hi) / 2
        ys = [sorted(at(e, mid) for e in edges if min(e[0][0], e[1][0]) < mid < max(e[0][0], e[1][0])) for edges in (es, et)]
        spans = [list(zip(y[::2], y[1::2], strict=True)) for y in ys]
        total += (hi - lo) * sum((max(Fraction(0), min(b, d) - max(a, c)) for a, b in spans[0] for c, d in spans[1]), Fraction(0))
    return total


L = [[[(0, 0), (10, 0), (10, 4), (4, 4), (4, 10), (0, 10)]]]


def shapes_at_random(rng, n, wide):
    out = {}
    for k in range(n):
        x, y = rng.randint(0, wide), rng.randint(0, wide)
        ring = star(rng, x, y, rng.choice([8, 30]), rng.randint(4, 9))
        if len(ring) < 3 or not holds([[ring]], (x, y)):
            ring = [(x, y), (x + 7, y), (x + 3, y + 9)]
        out[k] = [[ring]]
    out[n] = [[[(20, 20), (90, 20), (90, 90), (20, 90)], [(40, 40), (40, 70), (70, 70), (70, 40)]]]  # with a hole
    out[n + 1] = [[[(45, 45), (50, 45), (47, 50)]], [[(100, 100), (110, 100), (105, 111)]]]  # two parts, one in the hole
    out[n + 2] = [[[(30, 30)]]]
    out[n + 3] = [[[(0, 55), (120, 56)]]]
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_points_and_shapes_against_brute_force(spark, seed):
    rng = random.Random(seed)
    shapes = shapes_at_random(rng, 24, 120)
    points = [(k, rng.randint(-5, 125), rng.randint(-5, 125)) for k in range(150)]
    points += [(1000 + k, *a) for k, (a, _) in enumerate(e for s in shapes.values() for e in ring_edges(s))]
    got = {(r.point, r.shape) for r in pg.points_in(spark.createDataFrame(points, "id bigint, x long, y long"), frame(spark, shapes), 16).collect()}
    assert got == {(i, k) for i, x, y in points for k, s in shapes.items() if holds(s, (x, y))}

    table = frame(spark, shapes)
    for within in (0, 25):
        near = {(r.l, r.r): r.d2 for r in pg.near_shapes(table, table, within, 16).collect()}
        want = {(a, b): float(d) for a, s in shapes.items() for b, t in shapes.items() if (d := distance2(s, t)) <= within * within}
        assert near == pytest.approx(want, abs=1e-9)


def test_shared_areas_against_exact_strips(spark):
    rng = random.Random(7)
    shapes = shapes_at_random(rng, 16, 80)
    got = {(r.l, r.r): r.shared for r in pg.shared_area(frame(spark, shapes), frame(spark, shapes), 16).collect()}
    for a, s in shapes.items():
        for b, t in shapes.items():
            assert got.get((a, b), 0) == pytest.approx(float(area_by_strips(s, t)), abs=1e-6), (a, b)


def test_l_shape_and_a_box_that_crosses_it_twice(spark):
    shapes = frame(spark, {1: L, 2: [[[(2, 2), (8, 2), (8, 8), (2, 8)]]], 3: [[[(1, 1), (1, 3), (3, 3), (3, 1)]]], 4: [[[(10, 0), (12, 0), (12, 4), (10, 4)]]], 5: [[[(5, 5), (9, 5), (9, 9), (5, 9)]]]})
    got = {(r.l, r.r): r for r in pg.relate(shapes, shapes, 5).where("l < r").collect()}
    assert set(got) == {(1, 2), (1, 3), (1, 4), (2, 3), (2, 5)}
    assert got[1, 2].shared == pytest.approx(20) and not got[1, 2].within and not got[1, 2].touches  # 6 x 2 and 2 x 4
    assert got[1, 3].contains and not got[1, 3].within and got[1, 3].shared == pytest.approx(4)
    assert got[1, 4].touches and got[1, 4].shared == pytest.approx(0)
    m = {r.id: r for r in pg.measures(shapes).collect()}
    assert m[1].area == 64 and m[1].cx == pytest.approx((40 * 5 + 24 * 2) / 64) and m[1].cy == pytest.approx((40 * 2 + 24 * 7) / 64)


def test_holes_and_lines_have_their_measures(spark):
    shapes = {1: [[[(0, 0), (10, 0), (10, 10), (0, 10)], [(0, 0), (5, 0), (5, 5), (0, 5)]]], 2: [[[(0, 0), (6, 0)]]], 3: [[[(2, 3)]]], 4: []}
    m = {r.id: (r.area, round(r.cx, 9), round(r.cy, 9)) for r in pg.measures(frame(spark, shapes)).collect()}
    assert m == {1: (75, round((500 - 62.5) / 75, 9), round((500 - 62.5) / 75, 9)), 2: (0, 3, 0), 3: (0, 2, 3)}


def test_hulls_hold_their_points(spark):
    rng = random.Random(3)
    points = [(k % 5, rng.randint(0, 40), rng.randint(0, 40)) for k in range(400)] + [(7, 1, 1)] * 3 + [(8, 0, 0), (8, 2, 2), (8, 1, 1)] + [(None, 1, 1), (9, None, 1)]
    df = spark.createDataFrame(points, "key bigint, x long, y long")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 30)  # many partial hulls
    try:
        got = {r.id: [(int(p.x), int(p.y)) for p in r.polys[0][0]] for r in pg.hulls(df.repartition(4)).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert set(got) == {0, 1, 2, 3, 4, 7, 8} and got[7] == [(1, 1)] and got[8] == [(0, 0), (2, 2)]
    for k, x, y in points[:400]:
        assert holds([[got[k]]], (x, y))
    for k in range(5):
        own = {(x, y) for key, x, y in points if key == k}
        assert set(got[k]) <= own and all(turn(a, b, c) > 0 for a, b, c in zip(got[k], got[k][1:] + got[k][:1], got[k][2:] + got[k][:2], strict=True))


def test_one_text_for_one_shape(spark):
    a = {1: [[[(0, 0), (4, 0), (4, 4), (0, 4)], [(1, 1), (2, 1), (2, 2)]], [[(9, 9), (10, 9), (10, 10)]]]}
    b = {1: [[[(10, 10), (10, 9), (9, 9), (10, 10)]], [[(4, 4), (4, 0), (0, 0), (0, 4)], [(2, 2), (1, 1), (2, 1)]]]}
    texts = {frame(spark, s).select(F.expr(pg.wkt(pg.canonical("polys"))).alias("t")).first().t for s in (a, b)}
    assert texts == {"MULTIPOLYGON (((0.000 0.000, 4.000 0.000, 4.000 4.000, 0.000 4.000, 0.000 0.000), (1.000 1.000, 2.000 2.000, 2.000 1.000, 1.000 1.000)), ((9.000 9.000, 10.000 9.000, 10.000 10.000, 9.000 9.000)))"}
    assert pg.near_shapes(frame(spark, {}), frame(spark, a)).count() == 0
