"""Readers and sinks of the batch pipeline: CSV, JSON, GeoJSON, Markdown rows, increments."""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_csv(spark: SparkSession, path: str, fields: Sequence[str]) -> DataFrame:
    """All columns as strings, by a stated schema; empty cells are null."""
    schema = T.StructType([T.StructField(f, T.StringType()) for f in fields])
    return spark.read.schema(schema).csv(path, header=True, nullValue="", multiLine=True, escape='"')


def write_csv(df: DataFrame, path: str, fields: Sequence[str]) -> None:
    """The stated columns in their order; nulls as empty cells; other columns dropped."""
    df.select(*fields).write.mode("overwrite").csv(path, header=True, emptyValue="", nullValue="", escape='"')


def read_keyed_json(spark: SparkSession, path: str, key: str, value_schema: str) -> DataFrame:
    """A JSON object of records by key, as rows."""
    whole = spark.read.text(path, wholetext=True)
    return whole.select(F.explode(F.from_json("value", f"map<string,{value_schema}>")).alias(key, "r")).select(key, "r.*")


def read_records_json(spark: SparkSession, path: str, key: str, record_schema: str) -> DataFrame:
    """The records that a JSON document lists under a key, as rows."""
    whole = spark.read.schema(f"{key} array<{record_schema}>").json(path, multiLine=True)
    return whole.select(F.explode(key).alias("r")).select("r.*")


def first_existing(spark: SparkSession, paths: Sequence[str]) -> str | None:
    """The first of several paths that is there, asked of its own file system."""
    for path in paths:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        if at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
            return path
    return None


def read_geojson(spark: SparkSession, paths: str | Sequence[str], properties: str) -> DataFrame:
    """Features with their properties, file, kind of geometry, and place: lon and lat of a
    point, ring (array of points) of a polygon's outline. Of several paths the first that
    is there is read; none: no rows."""
    schema = f"features array<struct<geometry:struct<type:string,coordinates:string>,properties:{properties}>>"
    path = first_existing(spark, [paths] if isinstance(paths, str) else list(paths))
    whole = spark.createDataFrame([], f"{schema}, file string") if path is None else spark.read.schema(schema).json(path, multiLine=True).select("features", F.col("_metadata.file_name").alias("file"))
    f = whole.select(F.explode("features").alias("f"), "file")
    at, outline = F.from_json("f.geometry.coordinates", "array<double>"), F.from_json("f.geometry.coordinates", "array<array<array<double>>>")
    point, polygon = F.col("f.geometry.type") == "Point", F.col("f.geometry.type") == "Polygon"
    ring = F.transform(F.try_element_at(outline, F.lit(1)), lambda p: F.struct(p[0].alias("x"), p[1].alias("y")))
    return f.select("f.properties.*", F.col("f.geometry.type").alias("geometry"), F.when(point, F.get(at, 0)).alias("lon"), F.when(point, F.get(at, 1)).alias("lat"), F.when(polygon, ring).alias("ring"), "file")


def public(properties: Column) -> Column:
    """A map's entries but private ones (a name that begins with an underscore) and empty ones."""
    return F.map_filter(properties, lambda k, v: ~k.startswith("_") & v.isNotNull() & (v != ""))


def point_geometry(lon: str, lat: str) -> Column:
    return F.to_json(F.struct(F.lit("Point").alias("type"), F.array(lon, lat).alias("coordinates")))


def ring_geometry(ring: str) -> Column:
    """A polygon from an array of points."""
    return F.to_json(F.struct(F.lit("Polygon").alias("type"), F.array(F.transform(ring, lambda p: F.array(p["x"], p["y"]))).alias("coordinates")))


def geojson_features(df: DataFrame, geometry: Column, properties: Sequence[str]) -> DataFrame:
    """One JSON feature a row, as value, beside df's columns; properties that are null or
    empty, and private ones, are left out."""
    told = public(F.map_from_arrays(F.array(*[F.lit(p) for p in properties]), F.array(*[F.col(p).cast("string") for p in properties])))
    return df.withColumn("value", F.concat(F.lit('{"type":"Feature","geometry":'), geometry, F.lit(',"properties":'), F.to_json(told), F.lit("}")))


def geojson_collection(features: DataFrame, name: str, order: Sequence[str]) -> DataFrame:
    """The lines of a feature collection in WGS 84, in order: an opening line, a line a feature
    (all but the first led by a comma), a closing line. Sorted by ranges of the order, so
    no task holds the whole; the files, one after the other, are the document."""
    spark = features.sparkSession
    head = '{"type":"FeatureCollection","name":%s,"crs":{"type":"name","properties":{"name":"urn:ogc:def:crs:OGC:1.3:CRS84"}},"features":[' % json.dumps(name, ensure_ascii=False)
    kinds = [f.dataType.simpleString() for o in order for f in features.schema.fields if f.name == o]
    ends = spark.createDataFrame([(0, head), (2, "]}")], "_part int, value string").select("_part", *[F.lit(None).cast(k).alias(o) for k, o in zip(kinds, order, strict=True)], "value")
    first = F.broadcast(features.agg(F.min(F.struct(*order)).alias("_first")))
    body = features.crossJoin(first).select(F.lit(1).alias("_part"), *order, F.when(F.struct(*order) == F.col("_first"), F.col("value")).otherwise(F.concat(F.lit(","), "value")).alias("value"))
    return ends.unionByName(body).orderBy("_part", *order).select("_part", *order, "value")


def write_lines(df: DataFrame, path: str, by: Sequence[str] = ()) -> None:
    """The column value as text, in df's order; with ``by``, a folder a value."""
    df.select(*by, "value").write.mode("overwrite").partitionBy(*by).text(path)


def summary_lines(df: DataFrame) -> DataFrame:
    """Each row as one JSON document: columns in their order, letters as they are, nulls kept."""
    return df.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("value"))


def pending(targets: DataFrame, cache: DataFrame, key: str, retry_null: str | None = None) -> DataFrame:
    """Targets that the cache lacks; with ``retry_null``, also those whose value there is null."""
    known = cache if retry_null is None else cache.where(F.col(retry_null).isNotNull())
    return targets.join(known.select(key), key, "left_anti")


def sized(c: str):
    """struct<width, height> from JSON if both are positive, else null."""
    s = F.from_json(c, "width int, height int")
    return F.when((s["width"] > 0) & (s["height"] > 0), s)


def world_file(affine: str) -> Column:
    """The six lines of a world file (A, D, B, E, C, F) from a map of pixel corners, its
    origin moved to the first pixel's centre; ten decimals."""
    a = lambda k: F.col(affine)[k]
    x, y = a(4) + (a(0) + a(2)) / 2, a(5) + (a(1) + a(3)) / 2
    return F.concat_ws("\n", *[F.format_string("%.10f", v) for v in (a(0), a(1), a(2), a(3), x, y)])


#: First line of a file of control points (fixed value).
POINTS_HEAD = "mapX,mapY,pixelX,pixelY,enable,dX,dY,residual"


def control_points(frame: Column, corners: Column) -> Column:
    """The lines of a file of control points: a sheet's four corners on the map (struct of
    points by name) beside its frame in pixels (struct<left, top, right, bottom>), rows
    counted downwards and so negative."""
    lines = [
        F.concat_ws(",", corners[name]["x"], corners[name]["y"], frame[x], -frame[y], F.lit("1,0,0,0"))
        for name, x, y in (("north_west", "left", "top"), ("north_east", "right", "top"), ("south_east", "right", "bottom"), ("south_west", "left", "bottom"))
    ]
    return F.concat_ws("\n", F.lit(POINTS_HEAD), *lines)


def markdown_rows(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    cells = [F.replace(F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit("|"), F.lit("\\|")) for c in columns]
    return df.select(F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |")).alias("value"))


def markdown_report(df: DataFrame, group: str, columns: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The lines of a report, a section a group: a heading with its count, a table's head, and
    a row a record. Columns: group, part (0 heading, 1 and 2 head, 3 rows), the order's, value."""
    none = [F.lit(None).cast(f.dataType).alias(o) for o in order for f in df.schema.fields if f.name == o]
    counts = df.groupBy(group).agg(F.count("*").alias("n"))
    title = F.concat(F.lit("## "), F.coalesce(F.col(group).cast("string"), F.lit("none")), F.lit(" ("), F.col("n").cast("string"), F.lit(")"))
    fixed = F.array(F.struct(F.lit(0).alias("part"), title.alias("value")), *[F.struct(F.lit(k).alias("part"), F.lit("| " + " | ".join(x) + " |").alias("value")) for k, x in ((1, columns), (2, ["---"] * len(columns)))])
    heads = counts.select(group, F.explode(fixed).alias("l")).select(group, "l.part", *none, "l.value")
    cells = [F.regexp_replace(F.replace(F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit("|"), F.lit("\\|")), "\n", " ") for c in columns]
    rows = df.select(group, F.lit(3).alias("part"), *order, F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |")).alias("value"))
    return heads.unionByName(rows).orderBy(group, "part", *order)
