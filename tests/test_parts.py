"""Small fixtures for files, scores, intervals and bridges."""

import json

import pytest
from pyspark.sql import functions as F

from geoledger.operators.bridges import bridges
from geoledger.operators.intervals import combined_estimate, exact_lower, exact_upper
from geoledger.operators.names import clean_name, fuzzy_pairs, tfidf_pairs
from geoledger.operators.spatial import nearest
from geoledger.sources import files


def test_exact_bounds(spark):
    rows = [(0, 100), (1, 100), (50, 50), (3, 10), (0, 0), (400_000, 1_000_000)]
    got = spark.createDataFrame(rows, "x bigint, n bigint").select("x", "n", exact_lower(F.col("x"), F.col("n")).alias("lo"), exact_upper(F.col("x"), F.col("n")).alias("hi")).collect()
    by = {(r.x, r.n): (r.lo, r.hi) for r in got}
    assert by[0, 100] == pytest.approx((0, 1 - 0.025 ** (1 / 100)), abs=1e-9)
    assert by[50, 50] == pytest.approx((0.025 ** (1 / 50), 1), abs=1e-9)
    assert by[3, 10] == pytest.approx((0.0667395, 0.6524529), abs=1e-6)
    assert by[1, 100][0] == pytest.approx(1 - 0.975 ** (1 / 100), abs=1e-9)
    assert by[0, 0] == (None, None)
    assert by[400_000, 1_000_000] == pytest.approx((0.4 - 1.96 * 0.00049, 0.4 + 1.96 * 0.00049), abs=1e-5)


def test_combined_estimate_of_one_stratum_is_its_exact_interval(spark):
    s = spark.createDataFrame([(10, 1000, 3)], "labeled bigint, unlabeled bigint, positive bigint")
    r = combined_estimate(s).first()
    assert (r.point, r.lower, r.upper) == pytest.approx((0.3, 0.0667395, 0.6524529), abs=1e-6)
    assert (r.point_n, r.lower_n, r.upper_n) == (303, 69, 655)
    two = combined_estimate(spark.createDataFrame([(10, 1000, 3), (10, 1000, 3), (0, 5, 0)], "labeled bigint, unlabeled bigint, positive bigint")).first()
    assert two.upper - two.lower == pytest.approx((0.6524529 - 0.0667395) / 2**0.5, abs=1e-6)


def _lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
        row = new
    return row[-1]


def test_fuzzy_scores(spark):
    names = ["Smith Farms LLC", "SMITH, FARM", "Jones & Sons", "trust", "", "Abel Petrov", "Petrov Abel", "a" * 40]
    pairs = spark.createDataFrame([(a, b) for a in names for b in names] + [(None, "x")], "name_a string, name_b string")
    got = fuzzy_pairs(pairs).withColumns({"ca": F.expr(clean_name("name_a")), "cb": F.expr(clean_name("name_b"))}).collect()
    assert len(got) == len(names) ** 2
    for r in got:
        n = len(r.ca) + len(r.cb)
        assert r.fuzzy == (1000 if not n else round(200 * _lcs(r.ca, r.cb) / n) * 10), (r.ca, r.cb)
    assert {r.cb for r in got if r.name_b == "SMITH, FARM"} == {"smith"}


def test_tfidf_scores(spark):
    names = spark.createDataFrame([("red barn",), ("red mill",), ("x",), ("",), (None,)], "name string")
    pairs = spark.createDataFrame([("red barn", "red barn"), ("red barn", "red mill"), ("x", "red mill"), ("", "")], "name_a string, name_b string")
    got = {(r.name_a, r.name_b): r.tfidf for r in tfidf_pairs(names, pairs).collect()}
    import math

    red, one = math.log(5 / 3) + 1, math.log(5 / 2) + 1
    assert got == {("red barn", "red barn"): 1000, ("red barn", "red mill"): int(1000 * red * red / (red * red + one * one)), ("x", "red mill"): 0, ("", ""): 0}


def test_bridges(spark):
    edges = [(1, 2), (2, 3), (3, 1), (3, 4), (4, 5), (5, 6), (6, 4), (7, 8), (8, 7), (9, 9), (None, 1)]
    got = {(r.component, r.u, r.v) for r in bridges(spark.createDataFrame(edges, "u bigint, v bigint")).collect()}
    assert got == {(1, 3, 4), (7, 7, 8)}


def _is_bridge(edges, cut):
    near = {}
    for u, v in edges - {cut}:
        near.setdefault(u, set()).add(v)
        near.setdefault(v, set()).add(u)
    seen, todo = {cut[0]}, [cut[0]]
    while todo:
        for other in near.get(todo.pop(), ()):
            if other not in seen:
                seen.add(other)
                todo.append(other)
    return cut[1] not in seen


def test_bridges_of_components_too_large_for_a_task(spark):
    import random

    pick = random.Random(5)
    edges = {tuple(sorted(pick.sample(range(40), 2))) for _ in range(44)}  # sparse, with cycles and trees
    edges |= {(100 + k, 101 + k) for k in range(40)} | {(100, 120)}  # a path with one cycle
    edges |= {(200, 201 + k) for k in range(30)} | {(205, 206)}  # a hub
    table = spark.createDataFrame(sorted(edges), "u bigint, v bigint")
    want = {e for e in edges if _is_bridge(edges, e)}
    got = bridges(table, 35).collect()  # two components go by rounds of joins, the hub's by a task
    assert {(r.u, r.v) for r in got} == want and len(got) == len(want)
    assert bridges(table.where("u < 0"), 0).count() == 0


def test_nearest_without_anything_near(spark):
    schema = "id bigint, xmin bigint, ymin bigint, xmax bigint, ymax bigint"
    a = spark.createDataFrame([(1, 0, 0, 0, 0), (2, 90000, 0, 90000, 0), (3, None, 0, None, 0)], schema)
    b = spark.createDataFrame([(7, 10, 0, 20, 5), (8, -10, 0, -10, 0), (9, 10, 0, 20, 5)], schema)
    assert {(r.id, r.other, r.d2) for r in nearest(a, b, 50).collect()} == {(1, 7, 100), (2, 7, 89980**2)}
    assert nearest(a, b.where("id < 0"), 50).count() == 0
    assert nearest(a.where("id < 0"), b.where("id < 0"), 50).count() == 0


def test_annotation_files(spark, tmp_path):
    tri = [[{"x": 0.0, "y": 0.0}, {"x": 4.0, "y": 0.0}, {"x": 0.0, "y": 4.0}]]
    line = {"name": "/a/tile_1.tif", "createdAt": "2024-01-02T03:04:05Z", "annotations": [
        {"label": "cafo", "type": "segment", "coordinates": tri}, {"label": "b", "type": "box", "coordinates": tri}, {"label": "t", "type": "text", "coordinates": None},
        {"label": "cafo", "type": "segment", "coordinates": [[{"x": 1.0, "y": 1.0}, {"x": 3.0, "y": 2.0}]]}]}
    text = json.dumps(line)
    (tmp_path / "ann_1.jsonl").write_text(text + "\n\n" + text + "\n" + json.dumps({"annotations": []}) + "\n")
    (tmp_path / "bob_1.jsonl").write_text(text + "\n")
    got = files.read_annotations(spark, str(tmp_path))
    assert sorted((r.image, r.rater) for r in got.collect()) == [("tile_1", "ann"), ("tile_1", "bob")]
    rings = {(r.rater, r.k): [(p.x, p.y) for p in r.ring] for r in files.annotation_polygons(got).collect()}
    assert rings["ann", 3] == [(1, 1), (3, 1), (3, 2), (1, 2)] and set(rings) == {("ann", 0), ("ann", 3), ("bob", 0), ("bob", 3)}
    area = files.annotation_polygons(got).select(F.expr(files.ring_area("ring")).alias("a"), "k").collect()
    assert {(r.k, r.a) for r in area} == {(0, 8.0), (3, 2.0)}


def test_text_geometry_and_double_json(spark):
    df = spark.createDataFrame([("POLYGON ((0 0, 4 0, 4 4, 0 0), (1 1, 2 1, 2 2, 1 1))",), ("MULTIPOLYGON (((0 0, 1 0, 1 1, 0 0)), ((5 5, 6 5, 6 6, 5 5)))",), ("POINT (1 2)",), (None,)], "w string")
    shapes = [r.g and [len(p) for p in r.g] for r in df.select(F.expr(files.wkt_rings("w")).alias("g")).collect()]
    assert shapes == [[2], [1, 1], None, None]
    j = spark.createDataFrame([('{"a": 1}',), (json.dumps('{"a": 2}'),), (None,)], "c string")
    assert [r.v and r.v.a for r in j.select(files.read_json_text("c", "a int").alias("v")).collect()] == [1, 2, None]


def test_csv_features_and_append(spark, tmp_path):
    (tmp_path / "in.csv").write_text('id,Full Name,extra\n1,"a ""b"", c",x\n2,,y\n')
    rows = files.read_csv(spark, str(tmp_path / "in.csv"), ["Full Name", "id"])
    assert [tuple(r) for r in rows.collect()] == [('a "b", c', "1"), (None, "2")]
    box = rows.selectExpr("id", "0L as xmin", "0L as ymin", "2L as xmax", "3L as ymax")
    files.write_features(box, str(tmp_path / "f"), "id")
    first = json.loads(spark.read.text(str(tmp_path / "f")).orderBy("value").first().value)
    assert first["properties"] == {"id": "1"} and first["geometry"]["coordinates"] == [[[0, 0], [2, 0], [2, 3], [0, 3], [0, 0]]]
    rows.select("id").write.parquet(str(tmp_path / "t"))
    assert files.append_new(spark.createDataFrame([("2",), ("3",), ("3",)], "id string"), spark, str(tmp_path / "t"), "id") == 1
    with pytest.raises(ValueError, match="empty"):
        files.require_rows(full=rows, empty=rows.where("false"))


def test_projection_is_true_to_scale_and_area(spark):
    import math

    from geoledger.functions.projection import project

    rows = [(-120.0, 0.0), (-120.0, 34.0), (-119.99, 34.0), (-121.0, 37.0), (-120.99, 37.0), (-121.0, 37.01), (None, 1.0)]
    x, y = project("lon", "lat")
    got = [(r.x, r.y) for r in spark.createDataFrame(rows, "lon double, lat double").selectExpr(f"{x} as x", f"{y} as y").collect()]
    assert got[0] == pytest.approx((0, -4_000_000), abs=1e-3) and got[6][0] is None
    e2 = 0.00669438002290
    along = lambda lat: 6378137 * math.cos(math.radians(lat)) / math.sqrt(1 - e2 * math.sin(math.radians(lat)) ** 2) * math.radians(0.01)
    assert math.dist(got[1], got[2]) == pytest.approx(along(34), rel=1e-6)  # a standard parallel keeps its length
    up = 6378137 * (1 - e2) / (1 - e2 * math.sin(math.radians(37.005)) ** 2) ** 1.5 * math.radians(0.01)
    cross = abs((got[4][0] - got[3][0]) * (got[5][1] - got[3][1]) - (got[4][1] - got[3][1]) * (got[5][0] - got[3][0]))
    assert cross == pytest.approx(along(37.0) * up, rel=1e-4)


def test_unscored_queries_hold_their_invariants(spark):
    from geoledger.plans.registry import QUERIES

    sf = "/root/testdata/sf0.001"
    batch = QUERIES["second_rater_batch"](spark, sf).collect()
    raters = {}
    for r in batch:
        raters.setdefault(r.id, set()).add(r.rater)
    assert all(len(v) == 2 for v in raters.values())
    pairs = {}
    for r in batch:
        pairs.setdefault((r.status, r.pair), []).append(r.rater)
    assert all(len(v) == len(set(v)) for v in pairs.values()) and sorted(map(len, pairs.values()))[-1] == 4
    a, b = (QUERIES["sampled_population"](spark, sf).collect() for _ in range(2))
    assert a == b and a[0].lower <= a[0].point <= a[0].upper
    parts = {r.part: r for r in QUERIES["split_estimate"](spark, sf).collect()}
    assert parts["all"].point_n == sum(r.point_n for k, r in parts.items() if k != "all")
    known = sum(r.positive for r in QUERIES["tile_status"](spark, sf).select("positive").collect())
    assert parts["all"].point_n >= known


def test_stock_counts_what_was_built_before_the_spine(spark, monkeypatch):
    from geoledger.plans import matching

    rows = [(1, 1990, None, 1), (2, 1992, 1994, 2), (3, 1993, 1997, 3), (4, 1996, None, 4), (5, 1995, 1996, 5), (5, 1998, 2001, 6), (6, None, 1999, 7), (7, 2000, 2000, 8)]
    table = spark.createDataFrame(rows, "building_id bigint, built int, destroyed int, annotated bigint")
    monkeypatch.setattr(matching, "view", lambda *a: table)
    ends = {}
    for i, b, g, _ in rows:
        ends.setdefault(i, []).append((b, g))
    low, high = lambda x: min(x, default=None), lambda x: max(x, default=None)
    pick = {i: (low(b), high(b), low(g), high(g)) for i, v in ends.items() for b, g in [([x for x, _ in v if x is not None], [x for _, x in v if x is not None])]}
    got = {r.year: (r.standing, r.built, r.gone) for r in matching.stock(spark, "").collect()}
    assert got == {
        y: (sum(b0 is not None and b0 <= y and (g1 is None or g1 > y) for b0, _, _, g1 in pick.values()), sum(p[0] == y for p in pick.values()), sum(p[3] == y for p in pick.values()))
        for y in range(1995, 2021)
    }
    bounds = {r.year: (r.strict, r.loose) for r in matching.stock_bounds(spark, "").collect()}
    stood = lambda b, g, y: (b is None or b <= y) and (g is None or g >= y)
    assert bounds == {y: (sum(stood(b1, g0, y) for _, b1, g0, _ in pick.values()), sum(stood(b0, g1, y) for b0, _, _, g1 in pick.values())) for y in range(1995, 2021)}


def test_names_beyond_ascii_and_long_ones(spark):
    """Letters of any script are word characters; scores agree with the plain table of subsequences."""
    import random

    from geoledger.operators.names import fuzzy_score, lcs_length

    got = {r.name: r.c for r in spark.createDataFrame([("Pe\u00f1a Farms",), ("M\u00fcller & S\u00f6hne, LLC",), ("\u674e\u660e 7",)], "name string").withColumn("c", F.expr(clean_name("name"))).collect()}
    assert got == {"Pe\u00f1a Farms": "pe\u00f1a", "M\u00fcller & S\u00f6hne, LLC": "m\u00fcller s\u00f6hne", "\u674e\u660e 7": "\u674e\u660e 7"}
    assert fuzzy_score("", "") == 1000 and fuzzy_score("", "a") == 0 and fuzzy_score("pe\u00f1a", "pena") == 750
    chance = random.Random(4)
    for _ in range(300):
        a, b = ("".join(chance.choice("abc \u00f1") for _ in range(chance.randint(0, 90))) for _ in range(2))
        row = [0] * (len(b) + 1)
        for x in a:
            last = row
            row = [0]
            for k, y in enumerate(b):
                row.append(max(last[k + 1], row[k], last[k] + (x == y)))
        assert lcs_length(a, b) == row[-1]


def test_places_beyond_the_counties_keep_null(spark):
    from geoledger.plans.quality import located

    counties = spark.createDataFrame([(0, "A", 0, 0), (1, "B", 16020, 0)], "id bigint, name string, xmin bigint, ymin bigint")
    points = spark.createDataFrame([(1, 5, 5), (2, 16020, 16019), (3, 5, 16020), (4, 80100 + 7, 1), (5, None, 1)], "id bigint, x bigint, y bigint")
    assert {r.id: r.county for r in located(points, counties, "x", "y").collect()} == {1: "A", 2: "B", 3: None, 4: "A", 5: None}
