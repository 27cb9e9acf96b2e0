"""GeoJSON as tables: features with properties and geometry in nested arrays, and back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Coordinates keep their JSON text until the geometry type says how deep they nest.
FEATURE = "struct<type:string,properties:string,geometry:struct<type:string,coordinates:string>>"
_RINGS = "array<array<array<double>>>"


def parse_features(collections: DataFrame, column: str, properties: str | StructType) -> DataFrame:
    """One row a feature of FeatureCollection texts: properties.*, geometry_type, point (of points), parts (of polygons: a list of
    polygons, each a list of rings of struct(x, y)) and feature_no in the collection."""
    doc = F.from_json(column, f"struct<type:string,features:array<{FEATURE}>>")
    f = collections.select(F.posexplode(doc["features"]).alias("feature_no", "f"))
    g = F.col("f.geometry")
    corner = lambda p: F.struct(p[0].alias("x"), p[1].alias("y"))
    rings = lambda polygon: F.transform(polygon, lambda ring: F.transform(ring, corner))
    single = F.array(rings(F.from_json(g["coordinates"], _RINGS)))
    many = F.transform(F.from_json(g["coordinates"], f"array<{_RINGS}>"), rings)
    point = F.from_json(g["coordinates"], "array<double>")
    return f.select(
        "feature_no", F.from_json("f.properties", properties).alias("p"), g["type"].alias("geometry_type"),
        F.when(g["type"] == "Point", corner(point)).alias("point"), F.when(g["type"] == "Polygon", single).when(g["type"] == "MultiPolygon", many).alias("parts"),
    ).select("feature_no", "p.*", "geometry_type", "point", "parts")


def read_geojson(spark: SparkSession, path: str, properties: str | StructType) -> DataFrame:
    """All features of the files at path; a file is one document."""
    return parse_features(spark.read.text(path, wholetext=True), "value", properties)


def point_feature(x: Column, y: Column, properties: Column) -> Column:
    """A Point feature as JSON."""
    geometry = F.struct(F.lit("Point").alias("type"), F.array(x, y).alias("coordinates"))
    return F.to_json(F.struct(F.lit("Feature").alias("type"), properties.alias("properties"), geometry.alias("geometry")))


def polygon_feature(rings: Column, properties: Column) -> Column:
    coordinates = F.transform(rings, lambda ring: F.transform(ring, lambda p: F.array(p["x"], p["y"])))
    return F.to_json(F.struct(F.lit("Feature").alias("type"), properties.alias("properties"), F.struct(F.lit("Polygon").alias("type"), coordinates.alias("coordinates")).alias("geometry")))


def write_feature_lines(features: DataFrame, column: str, path: str) -> None:
    """One feature a line, for any number of tasks."""
    features.select(F.col(column).alias("value")).write.mode("overwrite").text(path)
