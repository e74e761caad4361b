"""The input files as typed tables: every rule of a load as column expressions over one scan.

Loads that can refuse rows return two tables: what is loaded, and the refused rows with a reason; nothing is
dropped in silence. All columns of a file come in as text (``files.read_csv``); blanks are null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from geoledger.sources.files import read_csv


def _true(c: str) -> Column:
    return F.coalesce(F.lower(F.trim(c)) == "true", F.lit(False))


def _number(c: str) -> Column:
    """A double, or null for what isn't a number ("Error", blanks)."""
    return F.expr(f"try_cast(trim(`{c}`) as double)")


def _day(c: str) -> Column:
    """A date written month/day/year; null if it is none."""
    return F.expr(f"cast(try_to_timestamp(`{c}`, 'M/d/yyyy') as date)")


def _year(c: str, end: str) -> Column:
    """The first or last day of a year; null for "-", blanks and other text."""
    return F.when(F.col(c).rlike(r"^\d{4}$"), F.expr(f"try_to_date(concat(`{c}`, '{end}'))"))


def split(rows: DataFrame, **reasons: Column) -> tuple[DataFrame, DataFrame]:
    """(rows without a reason, refused rows with the first reason that holds)."""
    why = F.coalesce(*[F.when(F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in reasons.items()])
    marked = rows.withColumn("refused", why)
    return marked.where("refused is null").drop("refused"), marked.where("refused is not null")


def known_keys(rows: DataFrame, key: str, table: DataFrame, table_key: str, name: str) -> tuple[DataFrame, DataFrame]:
    """Rows whose ``key`` occurs in a table, and the others refused as ``name``; rows with a null key are refused too."""
    keys = table.select(F.col(table_key).alias(key)).distinct().withColumn("_known", F.lit(True))
    marked = rows.join(keys, key, "left")
    return marked.where("_known").select(*rows.columns), marked.where("_known is null").select(*rows.columns, F.lit(name).alias("refused"))


def read_locations(rows: DataFrame, lat: str, lon: str) -> DataFrame:
    """``(latitude, longitude)``: distinct places of rows whose coordinates are numbers."""
    return rows.select(_number(lat).alias("latitude"), _number(lon).alias("longitude")).dropna().distinct()


def permit_locations(registered: DataFrame, geocoded: DataFrame) -> DataFrame:
    """``(latitude, longitude, source)``: distinct places of permits and of their addresses; the geocoded file names a place that both have."""
    both = read_locations(registered, "Latitude", "Longitude").withColumn("k", F.lit(0)).union(read_locations(geocoded, "lat", "lon").withColumn("k", F.lit(1)))
    return both.groupBy("latitude", "longitude").agg(F.when(F.max("k") == 1, "geocoded").otherwise("registered").alias("source"))


def with_geocoded(permits: DataFrame, geocoded: DataFrame) -> DataFrame:
    """Permits with ``glat, glon`` of their (address, city); of several geocoded rows of one address the last in file order (column ``k``) counts."""
    last = geocoded.groupBy("address", "city").agg(F.max_by(F.struct(_number("latitude").alias("glat"), _number("longitude").alias("glon")), "k").alias("g"))
    return permits.join(last.select("address", "city", "g.glat", "g.glon"), ["address", "city"], "left")


CONSTRUCTION = ["latitude", "longitude", "construction_lower", "construction_upper", "destruction_lower", "destruction_upper", "significant_animal_population_change", "has_lagoon", "where_animals_stay", "processed_on", "annotator", "uuid", "is_cafo"]
TYPING = ["latitude", "longitude", "is_afo", "is_cafo", "notes", "annotated_before", "labeler", "annotation_facility_hash", "uuid", "type", "secondary_type", "subtype"]


def construction(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Construction dates: lower bounds from the first day of a year, upper ones to the last; rows without an upper bound of construction are refused."""
    upper = _year("construction_upper", "-12-31")
    kept, refused = split(rows, **{"no construction date": upper.isNull(), "no place": _number("latitude").isNull() | _number("longitude").isNull()})
    out = kept.select(
        _number("latitude").alias("latitude"), _number("longitude").alias("longitude"), _year("construction_lower", "-01-01").alias("construction_lower"), upper.alias("construction_upper"),
        _year("destruction_lower", "-01-01").alias("destruction_lower"), _year("destruction_upper", "-12-31").alias("destruction_upper"), _true("significant_animal_population_change").alias("population_change"),
        F.coalesce(F.contains("where_animals_stay", F.lit("indoor")), F.lit(False)).alias("indoors"), _true("has_lagoon").alias("has_lagoon"), _day("processed_on").alias("annotated_on"),
    )
    return out, refused


def cafo_labels(typing: DataFrame, dating: DataFrame) -> DataFrame:
    """Labels of both sources: rows of animal typing with both flags blank, and rows of construction dating without a place, are no labels.

    A feeding operation whose notes name a feedlot counts; construction dating has one flag for both.
    """
    afo = _true("is_afo")
    first = typing.where("is_cafo is not null or is_afo is not null").select(
        _number("latitude").alias("latitude"), _number("longitude").alias("longitude"), F.expr("try_cast(annotated_before as date)").alias("annotated_on"), F.coalesce("annotation_facility_hash", "uuid").alias("hash"), F.col("labeler").alias("annotator"),
        (_true("is_cafo") | (afo & F.coalesce(F.contains(F.lower("notes"), F.lit("feedlot")), F.lit(False)))).alias("is_cafo"), afo.alias("is_afo"), F.lit("animal typing").alias("phase"),
    )
    second = dating.where("latitude is not null and longitude is not null").select(
        _number("latitude").alias("latitude"), _number("longitude").alias("longitude"), _day("processed_on").alias("annotated_on"), F.col("uuid").alias("hash"), "annotator", _true("is_cafo").alias("is_cafo"), _true("is_cafo").alias("is_afo"), F.lit("construction dating").alias("phase")
    )
    return first.unionByName(second)


def type_rows(rows: DataFrame, flags: list[str], key: str = "facility", labeler: str = "labeler") -> DataFrame:
    """``(key, animal_type, source)``: one row for each flag that is true; a labeler that names permits makes the source "permit". Each pair once, a human's label first."""
    pairs = F.array(*[F.struct(F.lit(f).alias("animal_type"), _true(f).alias("on")) for f in flags])
    long = rows.select(key, F.when(F.coalesce(F.contains(F.lower(labeler), F.lit("permit")), F.lit(False)), "permit").otherwise("human").alias("source"), F.explode(pairs).alias("p")).where("p.on")
    return long.groupBy(key, F.col("p.animal_type").alias("animal_type")).agg(F.min("source").alias("source"))


def marked(images: DataFrame, names: DataFrame, reason: str = "post_hoc") -> DataFrame:
    """Images with ``label_reason`` set where their name is listed; others keep theirs."""
    listed = names.select(F.trim("image_name").alias("name")).distinct().withColumn("_listed", F.lit(True))
    out = images.join(listed, "name", "left").withColumn("label_reason", F.when(F.col("_listed"), reason).otherwise(F.col("label_reason")))
    return out.select(*images.columns)


def bucketed(images: DataFrame, buckets: DataFrame) -> DataFrame:
    """Images with the bucket that a file (name, bucket) gives their name, else their own; of several rows of a name the largest counts."""
    given = buckets.groupBy("name").agg(F.max("bucket").alias("_given"))
    return images.join(given, "name", "left").withColumn("bucket", F.coalesce("_given", "bucket")).select(*images.columns)


def masks_of_state(masks: DataFrame, state: str = "CA") -> DataFrame:
    """Urban masks whose name is of a state; names of several states count for each."""
    return masks.where(F.contains("name", F.lit(f", {state}")))


def legacy_ids(groups: DataFrame, current: DataFrame) -> DataFrame:
    """``(legacy, facilities)``: the current facilities, in order, of the members of each old group; ``groups(legacy, members)``, ``current(member, facility)``."""
    each = groups.select("legacy", F.explode("members").alias("member")).join(current, "member")
    return each.groupBy("legacy").agg(F.sort_array(F.collect_set("facility")).alias("facilities"))


#: What each action code does to an image's annotations: labels to drop, and whether the image is then marked blank (fixed values).
ACTIONS = {0: ((), False), 1: (("flag",), False), 2: (("flag",), False), 3: (("flag", "cafo"), True), 4: (("flag", "cafo"), True), 5: ((), False), 6: (("flag", "cafo"), True)}


def edited(annotations: DataFrame, actions: DataFrame, at: str) -> tuple[DataFrame, DataFrame]:
    """(``annotations(image, annotations)`` after the edits, refused actions).

    ``actions(file, code)`` names images by file, up to its first dot. A code outside ACTIONS and an image without annotations are
    refused. Several actions of an image are done in order of their codes; ``at`` dates the marks.
    """
    named = actions.select(F.substring_index("file", ".", 1).alias("image"), F.expr("try_cast(code as int)").alias("code"))
    valid, odd = split(named, **{"no such action": F.col("code").isNull() | ~F.col("code").isin(*ACTIONS)})
    valid, unknown = known_keys(valid, "image", annotations, "image", "no such image")
    dropped = {label: [c for c, (labels, _) in ACTIONS.items() if label in labels] for label in ("flag", "cafo")}
    per = valid.groupBy("image").agg(*[F.bool_or(F.col("code").isin(*codes)).alias(f"_{label}") for label, codes in dropped.items()], F.count_if(F.col("code").isin(*[c for c, (_, blank) in ACTIONS.items() if blank])).alias("_blank"))
    kind = dict(annotations.dtypes)["annotations"]
    out = annotations.join(per, "image", "left")
    kept = F.filter("annotations", lambda a: ~((F.coalesce(F.col("_flag"), F.lit(False)) & (F.coalesce(a["label"], F.lit("")) == "flag")) | (F.coalesce(F.col("_cafo"), F.lit(False)) & (F.coalesce(a["label"], F.lit("")) == "cafo"))))
    blank = F.from_json(F.lit(f'{{"label": "Blank", "createdAt": "{at}"}}'), kind.removeprefix("array<").removesuffix(">"))
    out = out.withColumn("annotations", F.concat(kept, F.array_repeat(blank, F.coalesce(F.col("_blank").cast("int"), F.lit(0)))))
    return out.select(*annotations.columns), odd.unionByName(unknown)


def read_json_files(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A folder of files with one JSON object each, with ``name``, the file's name without its extension."""
    rows = spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path)
    return rows.withColumn("name", F.regexp_extract(F.col("_metadata.file_name"), r"^(.*?)(\.[^.]*)?$", 1))


def read_county_files(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """A folder of CSV files, one a county, with ``county`` from the file's name: words joined by "_" or "-", in capitals at their start."""
    raw = spark.read.csv(path, header=True, multiLine=True, escape='"', nullValue="")
    file = F.regexp_extract(F.col("_metadata.file_name"), r"^(.*?)(\.[^.]*)?$", 1)
    return raw.select(*[F.col(f"`{c}`") for c in columns], F.initcap(F.regexp_replace(F.url_decode(file), "[_-]+", " ")).alias("county"))


def load_permits(spark: SparkSession, permits: str, geocoded: str) -> DataFrame:
    """Permits with their own place and that of their address; places that are no numbers are null."""
    p = read_csv(spark, permits, ["WDID", "Facility Address", "Latitude", "Longitude", "County", "Program", "Regulatory Measure Status", "Cafo Population", "Termination Date"])
    p = p.select(
        F.col("WDID").alias("id"), F.trim(F.regexp_extract("Facility Address", r"^(.*?)(?:,|$)", 1)).alias("address"), F.trim(F.regexp_extract("Facility Address", r"^[^,]*,\s*([^,]*)", 1)).alias("city"), _number("Latitude").alias("lat"), _number("Longitude").alias("lon"),
        F.col("County").alias("county"), F.col("Program").alias("program"), F.col("Regulatory Measure Status").alias("status"), F.expr("try_cast(`Cafo Population` as int)").alias("population"), F.col("Termination Date").alias("terminated"),
    )
    g = read_csv(spark, geocoded, ["Address", "City", "Latitude", "Longitude"]).toDF("address", "city", "latitude", "longitude").withColumn("k", F.monotonically_increasing_id())
    return with_geocoded(p, g)


def first_places(rows: DataFrame, lat: str, lon: str, order: list[Column]) -> tuple[DataFrame, DataFrame]:
    """Rows of an older dump by place: of several rows at one (lat, lon) the first in ``order`` is loaded, the others and those without a place are refused."""
    placed, odd = split(rows, **{"no place": _number(lat).isNull() | _number(lon).isNull()})
    ranked = placed.withColumn("_k", F.row_number().over(W.partitionBy(_number(lat), _number(lon)).orderBy(*order)))
    again = ranked.where("_k > 1").drop("_k").withColumn("refused", F.lit("place was there before"))
    return ranked.where("_k = 1").drop("_k"), odd.unionByName(again)
