"""Readers of the input files and writers of the exports, with explicit schemas and no inference pass."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

_ANNOTATION = "annotations array<struct<label: string, type: string, createdAt: string, coordinates: array<array<struct<x: double, y: double>>>>>"
ANNOTATIONS = f"name string, filename string, createdAt string, {_ANNOTATION}"


def read_csv(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """CSV with a header as text columns; blanks are null, quotes are doubled, fields may hold line breaks.

    ``columns`` are taken by name, whatever their order in the file; others are dropped. A missing one raises.
    """
    raw = spark.read.csv(path, header=True, multiLine=True, escape='"', nullValue="")
    return raw.select(*[F.col(f"`{c}`") for c in columns])


def read_annotations(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines ``(image, created, annotations, rater, hash)``.

    The image is the last path part without extension, the rater the file name's prefix. Blank lines and
    rows without a name drop; equal payloads stay once, by digest. Lines that are no JSON raise.
    """
    raw = spark.read.text(path).select("value", F.col("_metadata.file_name").alias("file")).where("trim(value) <> ''")
    j = raw.withColumn("j", F.from_json("value", ANNOTATIONS, {"mode": "FAILFAST"}))
    name = F.coalesce("j.name", "j.filename")
    out = j.select(
        F.regexp_extract(name, r"([^/]+?)(\.[^./]*)?$", 1).alias("image"), F.expr("try_to_timestamp(j.createdAt)").alias("created"), F.col("j.annotations").alias("annotations"),
        F.substring_index("file", "_", 1).alias("rater"), F.md5("value").alias("hash"),
    )
    return out.where("image <> ''").dropDuplicates(["rater", "hash"])


def annotation_polygons(annotations: DataFrame) -> DataFrame:
    """``(image, rater, k, label, ring)``: one pixel polygon an entry; boxes, text and entries without coordinates drop.

    Two points span a box.
    """
    e = annotations.select("image", "rater", F.posexplode_outer("annotations").alias("k", "a")).where("a.type not in ('box', 'text') and size(a.coordinates) > 0 and size(a.coordinates[0]) >= 2")
    box = "array(p[0], named_struct('x', p[1].x, 'y', p[0].y), p[1], named_struct('x', p[0].x, 'y', p[1].y))"
    return e.withColumn("p", F.col("a.coordinates")[0]).selectExpr("image", "rater", "k", "a.label as label", f"case when size(p) = 2 then {box} else p end as ring")


def pixel_to_lonlat(ring: str, width: int = 1024, height: int = 1024) -> str:
    """SQL text: pixel centres of ``ring`` in the tile's bounds lon_min .. lat_max (rows count from the top)."""
    return f"transform({ring}, v -> named_struct('x', lon_min + (v.x + 0.5D) / {width} * (lon_max - lon_min), 'y', lat_max - (v.y + 0.5D) / {height} * (lat_max - lat_min)))"


def read_json_text(column: str, schema: str) -> Column:
    """A JSON object, or a JSON string that holds one."""
    inner = F.get_json_object(F.concat(F.lit('{"v":'), column, F.lit("}")), "$.v")
    return F.from_json(F.when(F.ltrim(F.col(column)).startswith('"'), inner).otherwise(F.col(column)), schema)


def wkt_rings(wkt: str) -> str:
    """SQL text: polygons, rings and vertices of WKT POLYGON or MULTIPOLYGON; null for other text."""
    body = f"regexp_replace({wkt}, '^\\\\s*MULTIPOLYGON\\\\s*\\\\(|^\\\\s*POLYGON\\\\s*', '')"
    polygon = "transform(split(regexp_replace(g, '^[\\\\s(]+|[\\\\s)]+$', ''), '\\\\)\\\\s*,\\\\s*\\\\('), r -> transform(split(r, '\\\\s*,\\\\s*'), v -> named_struct('x', cast(split(trim(v), '\\\\s+')[0] as double), 'y', cast(split(trim(v), '\\\\s+')[1] as double))))"
    return f"case when {wkt} rlike '^\\\\s*(MULTI)?POLYGON' then transform(split({body}, '\\\\)\\\\s*\\\\)\\\\s*,\\\\s*\\\\(\\\\s*\\\\('), g -> {polygon}) end"


def ring_area(ring: str) -> str:
    """SQL text: area of a ring by the shoelace sum, taken about its first vertex."""
    step = f"element_at({ring}, 1 + (i % size({ring})))"
    return f"abs(aggregate(sequence(1, size({ring})), 0D, (s, i) -> s + ({ring}[i - 1].x - {ring}[0].x) * ({step}.y - {ring}[0].y) - ({step}.x - {ring}[0].x) * ({ring}[i - 1].y - {ring}[0].y))) / 2"


def box_feature(*properties: str) -> Column:
    """GeoJSON feature text of a row's box with the named columns as properties; null columns are left out."""
    corner = lambda x, y: F.array(F.col(x), F.col(y))
    ring = F.array(corner("xmin", "ymin"), corner("xmax", "ymin"), corner("xmax", "ymax"), corner("xmin", "ymax"), corner("xmin", "ymin"))
    geometry = F.struct(F.lit("Polygon").alias("type"), F.array(ring).alias("coordinates"))
    return F.to_json(F.struct(F.lit("Feature").alias("type"), F.struct(*properties).alias("properties"), geometry.alias("geometry")))


def write_features(df: DataFrame, path: str, *properties: str) -> None:
    """One GeoJSON feature a line, in as many files as the input has partitions."""
    df.select(box_feature(*properties).alias("value")).write.mode("overwrite").text(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def append_new(df: DataFrame, spark: SparkSession, path: str, key: str) -> int:
    """Append the rows whose ``key`` is not stored yet (first of equal keys stays); returns how many."""
    new = df.dropDuplicates([key])
    old = spark.read.parquet(path)
    new = new.join(old.select(key), key, "left_anti").select(*old.columns)
    before = old.count()
    new.write.mode("append").parquet(path)
    return spark.read.parquet(path).count() - before


def require_rows(**tables: DataFrame) -> None:
    """Raise when a table that a step depends on is empty."""
    empty = [name for name, df in tables.items() if df.isEmpty()]
    if empty:
        raise ValueError(f"no rows in {', '.join(empty)}; load them first")
