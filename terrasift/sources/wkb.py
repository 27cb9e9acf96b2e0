"""Geometry columns of GeoParquet files: well-known binary to points, lines and polygon rings, and from points and polygons."""

from __future__ import annotations

import struct

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

POINT, LINE, POLYGON, MULTIPOINT, MULTILINE, MULTIPOLYGON = 1, 2, 3, 4, 5, 6
_NAMES = {POINT: "Point", LINE: "LineString", POLYGON: "Polygon", MULTIPOINT: "MultiPoint", MULTILINE: "MultiLineString", MULTIPOLYGON: "MultiPolygon", 7: "GeometryCollection"}
_XY = "struct<x:double,y:double>"


class _Bytes:
    """A reader of well-known binary in either byte order, with heights and measures, which are left out."""

    def __init__(self, data: bytes):
        self.data, self.at = data, 0

    def head(self) -> int:
        """Kind of the geometry that begins here; its byte order and number of axes hold from now on."""
        self.order = "<" if self.data[self.at] else ">"
        (code,) = struct.unpack_from(f"{self.order}I", self.data, self.at + 1)
        self.at += 9 if code & 0x20000000 else 5  # an identifier of the reference system may follow
        plain = code & 0x0FFFFFFF
        self.axes = 2 + bool(code & 0x80000000) + bool(code & 0x40000000) + (0, 1, 1, 2)[plain // 1000 % 4]
        return plain % 1000

    def count(self) -> int:
        (n,) = struct.unpack_from(f"{self.order}I", self.data, self.at)
        self.at += 4
        return n

    def points(self, n: int) -> list[dict]:
        flat = struct.unpack_from(f"{self.order}{self.axes * n}d", self.data, self.at)
        self.at += 8 * self.axes * n
        return [{"x": x, "y": y} for x, y in zip(flat[:: self.axes], flat[1 :: self.axes], strict=True)]

    def rings(self) -> list:
        return [self.points(self.count()) for _ in range(self.count())]


def decode(data: bytes | None) -> tuple[str | None, dict | None, list | None, list | None]:
    """(kind, point, polygons, lines) of geometries in either byte order, with or without heights and measures: polygons are lists of rings, the first of
    each the outer one; lines are lists of points, of a MultiPoint one of each point. Null gives nulls; a collection, or a kind that is not
    known, is an error and not a null."""
    if data is None:
        return None, None, None, None
    own = _Bytes(data)
    kind = own.head()
    if kind == POINT:
        return "Point", own.points(1)[0], None, None
    if kind == LINE:
        return "LineString", None, None, [own.points(own.count())]
    if kind == POLYGON:
        return "Polygon", None, [own.rings()], None
    if kind not in (MULTIPOINT, MULTILINE, MULTIPOLYGON):
        raise ValueError(f"a {_NAMES.get(kind, kind)} is not read")
    parts = []
    for _ in range(own.count()):
        each = own.head()
        parts.append(own.rings() if each == POLYGON else own.points(own.count() if each == LINE else 1))
    return _NAMES[kind], None, parts if kind == MULTIPOLYGON else None, None if kind == MULTIPOLYGON else parts


def encode(point: dict | None, polygons: list | None) -> bytes | None:
    """Little-endian; one polygon is a Polygon, more are a MultiPolygon; a null point and null polygons are null."""
    if point is not None:
        return struct.pack("<BI2d", 1, POINT, point["x"], point["y"])
    if polygons is None:
        return None
    parts = []
    for rings in polygons:
        body = [struct.pack("<BII", 1, POLYGON, len(rings))]
        body += [struct.pack(f"<I{2 * len(r)}d", len(r), *(v for p in r for v in (p["x"], p["y"]))) for r in rings]
        parts.append(b"".join(body))
    return parts[0] if len(parts) == 1 else struct.pack("<BII", 1, MULTIPOLYGON, len(parts)) + b"".join(parts)


def geometry(wkb: Column) -> Column:
    """struct(kind, point, polygons, lines) of a binary column, in Arrow batches."""

    @F.pandas_udf(f"kind string, point {_XY}, polygons array<array<array<{_XY}>>>, lines array<array<{_XY}>>")
    def run(s: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([decode(bytes(v) if v is not None else None) for v in s], columns=["kind", "point", "polygons", "lines"])

    return run(wkb)


def to_wkb(point: Column | None = None, polygons: Column | None = None) -> Column:
    @F.pandas_udf("binary")
    def points(s: pd.DataFrame) -> pd.Series:
        return pd.Series([encode({"x": x, "y": y}, None) if x == x else None for x, y in zip(s.x, s.y, strict=True)], dtype=object)

    @F.pandas_udf("binary")
    def areas(s: pd.Series) -> pd.Series:
        return pd.Series([encode(None, p) for p in s], dtype=object)

    return points(point) if point is not None else areas(polygons)


def read_geoparquet(spark: SparkSession, path: str, column: str = "geometry") -> DataFrame:
    """The table with its geometry column decoded; only the columns that are used are read."""
    df = spark.read.parquet(path)
    return df.withColumn(column, geometry(F.col(column)))
