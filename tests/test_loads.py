"""Each load's rules on small hand-made files and rows."""

import datetime
import json

from pyspark.sql import functions as F

from geoledger.sources import files, loads


def text(spark, columns, rows):
    return spark.createDataFrame(rows, ", ".join(f"`{c}` string" for c in columns))


def test_construction_rows(spark):
    row = lambda **v: [v.get(c) for c in loads.CONSTRUCTION]
    got, refused = loads.construction(text(spark, loads.CONSTRUCTION, [
        row(latitude="36.5", longitude="-119.5", construction_lower="1990", construction_upper="1998", destruction_lower="-", has_lagoon="TRUE", where_animals_stay="mostly indoor", processed_on="3/14/2023"),
        row(latitude="36.5", longitude="-119.5", construction_upper="-"), row(latitude="Error", longitude="-119.5", construction_upper="2001"),
    ]))
    (r,) = got.collect()
    assert (r.construction_lower, r.construction_upper, r.destruction_lower) == (datetime.date(1990, 1, 1), datetime.date(1998, 12, 31), None)
    assert r.has_lagoon and r.indoors and not r.population_change and r.annotated_on == datetime.date(2023, 3, 14)
    assert sorted(x.refused for x in refused.collect()) == ["no construction date", "no place"]


def test_labels_of_two_sources(spark):
    row = lambda cols, **v: [v.get(c) for c in cols]
    typing = text(spark, loads.TYPING, [row(loads.TYPING, latitude="1", longitude="2", is_afo="true", is_cafo="false", notes="a Feedlot", uuid="u1", annotated_before="2023-01-02"), row(loads.TYPING, latitude="1", longitude="2"), row(loads.TYPING, latitude="1", longitude="2", is_afo="TRUE", annotation_facility_hash="h2", uuid="u2")])
    dating = text(spark, loads.CONSTRUCTION, [row(loads.CONSTRUCTION, latitude="3", longitude="4", is_cafo="True", uuid="u3", processed_on="12/1/2022"), row(loads.CONSTRUCTION, longitude="4", is_cafo="true")])
    got = {r.hash: (r.is_cafo, r.is_afo, r.phase) for r in loads.cafo_labels(typing, dating).collect()}
    assert got == {"u1": (True, True, "animal typing"), "h2": (False, True, "animal typing"), "u3": (True, True, "construction dating")}


def test_places_and_addresses(spark):
    a = text(spark, ["Latitude", "Longitude"], [["1", "2"], ["Error", "2"], [None, "2"], ["5", "6"]])
    b = text(spark, ["lat", "lon"], [["1.0", "2"], ["7", "Error"], ["8", "9"]])
    assert {tuple(r) for r in loads.permit_locations(a, b).collect()} == {(1, 2, "geocoded"), (5, 6, "registered"), (8, 9, "geocoded")}
    g = spark.createDataFrame([("1 Main", "Town", "1", "2", 0), ("1 Main", "Town", "3", "4", 1), ("2 Main", "Town", "Error", "4", 2)], "address string, city string, latitude string, longitude string, k int")
    p = spark.createDataFrame([(1, "1 Main", "Town"), (2, "2 Main", "Town"), (3, "1 Main", None)], "id int, address string, city string")
    assert {(r.id, r.glat, r.glon) for r in loads.with_geocoded(p, g).collect()} == {(1, 3, 4), (2, None, 4), (3, None, None)}
    rows = spark.createDataFrame([("1", "2", "b"), ("1.0", "2", "a"), ("x", "2", "c"), ("3", "4", "d")], "lat string, lon string, n string")
    kept, refused = loads.first_places(rows, "lat", "lon", [F.col("n")])
    assert {r.n for r in kept.collect()} == {"a", "d"} and {(r.n, r.refused) for r in refused.collect()} == {("b", "place was there before"), ("c", "no place")}


def test_flags_marks_buckets_and_old_groups(spark):
    t = spark.createDataFrame([(1, "true", None, "Permit match"), (1, "TRUE", "true", "ann"), (2, "false", "x", "ann")], "facility int, dairy string, poultry string, labeler string")
    assert {tuple(r) for r in loads.type_rows(t, ["dairy", "poultry"]).collect()} == {(1, "dairy", "human"), (1, "poultry", "human")}
    images = spark.createDataFrame([("a", None, "1"), ("b", "old", "2")], "name string, label_reason string, bucket string")
    assert {tuple(r) for r in loads.marked(images, text(spark, ["image_name"], [["a "], ["zz"]])).collect()} == {("a", "post_hoc", "1"), ("b", "old", "2")}
    assert {tuple(r) for r in loads.bucketed(images, text(spark, ["name", "bucket"], [["b", "inf"], ["b", "3"]])).collect()} == {("a", None, "1"), ("b", "old", "inf")}
    assert [r.name for r in loads.masks_of_state(text(spark, ["name"], [["Reno, NV--CA"], ["Fresno, CA"], ["Cairo, GA"]])).collect()] == ["Fresno, CA"]
    old = spark.createDataFrame([(1, ["x", "y"]), (2, ["z"]), (3, ["q"])], "legacy int, members array<string>")
    now = spark.createDataFrame([("x", 10), ("y", 7), ("z", 10)], "member string, facility int")
    assert {(r.legacy, tuple(r.facilities)) for r in loads.legacy_ids(old, now).collect()} == {(1, (7, 10)), (2, (10,))}


def test_edits_by_action_code(spark):
    kind = "array<struct<label: string, createdAt: string>>"
    a = spark.createDataFrame([(n, [("flag", "t"), ("cafo", "t"), ("barn", "t")]) for n in "abcd"], f"image string, annotations {kind}")
    actions = spark.createDataFrame([("a.jpeg", "1"), ("b.x.jpeg", "3"), ("c", "0"), ("zz.jpeg", "1"), ("d", "9"), ("d", None)], "file string, code string")
    got, refused = loads.edited(a, actions, "2024-01-01")
    assert {r.image: [x.label for x in r.annotations] for r in got.collect()} == {"a": ["cafo", "barn"], "b": ["barn", "Blank"], "c": ["flag", "cafo", "barn"], "d": ["flag", "cafo", "barn"]}
    assert sorted((r.image, r.refused) for r in refused.collect()) == [("d", "no such action"), ("d", "no such action"), ("zz", "no such image")]


def test_folders_of_files(spark, tmp_path):
    (tmp_path / "j").mkdir()
    for n in ("one", "two"):
        (tmp_path / "j" / f"{n}.json").write_text(json.dumps({"v": n, "w": [1, 2]}, indent=2))
    assert {(r.name, r.v, r.w[1]) for r in loads.read_json_files(spark, str(tmp_path / "j"), "v string, w array<int>").collect()} == {("one", "one", 2), ("two", "two", 2)}
    (tmp_path / "c").mkdir()
    (tmp_path / "c" / "san_luis-obispo.csv").write_text("number,owner\n1,\n2,x\n")
    (tmp_path / "c" / "kern.csv").write_text("owner,number\ny,3\n".replace("owner,number\ny,3", "number,owner\n3,y"))
    assert {tuple(r) for r in loads.read_county_files(spark, str(tmp_path / "c"), ["number", "owner"]).collect()} == {("1", None, "San Luis Obispo"), ("2", "x", "San Luis Obispo"), ("3", "y", "Kern")}
    (tmp_path / "p.csv").write_text('WDID,Facility Address,Latitude,Longitude,County,Program,Regulatory Measure Status,Cafo Population,Termination Date\n5A,"1 Main St, Town, CA",36.1,Error,Kern,COW,Active,"12",\n5B,Nowhere,,,Kern,COW,Active,,\n')
    (tmp_path / "g.csv").write_text("Address,City,Latitude,Longitude\n1 Main St,Town,36.2,-119\n")
    got = {r.id: (r.address, r.city, r.lat, r.lon, r.glat, r.glon, r.population) for r in loads.load_permits(spark, str(tmp_path / "p.csv"), str(tmp_path / "g.csv")).collect()}
    assert got == {"5A": ("1 Main St", "Town", 36.1, None, 36.2, -119, 12), "5B": ("Nowhere", "", None, None, None, None, None)}
    assert files.read_csv(spark, str(tmp_path / "g.csv"), ["City"]).count() == 1
