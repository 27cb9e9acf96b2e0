"""Formats of spark.read, and extracts laid out along a curve: what is read, and what is not."""

import json
import os
import random
import re

import pytest
from pyspark.sql import functions as F

from terrasift.sources import curve, datasource


def collection(path, features, bbox=None, **first):
    with open(path, "w") as f:
        json.dump({"type": "FeatureCollection", **first, **({"bbox": bbox} if bbox else {}), "features": features}, f)


def point(x, y, **properties):
    return {"type": "Feature", "properties": properties, "geometry": {"type": "Point", "coordinates": [x, y]}}


def explained(df):
    return df._jdf.queryExecution().toString()


def test_geojson_kinds(spark, tmp_path):
    shapes = [
        {"type": "Polygon", "coordinates": [[[0, 0], [4, 0], [4, 3], [0, 0]]]}, {"type": "LineString", "coordinates": [[1, 2, 9], [5, -6, 9]]}, {"type": "MultiPoint", "coordinates": []},
        {"type": "GeometryCollection", "geometries": [{"type": "Point", "coordinates": [7, 8]}, {"type": "Point", "coordinates": [-7, 1]}]}, None,
    ]
    collection(tmp_path / "a.geojson", [{"type": "Feature", "properties": {"n": i, "t": "Ä\n"}, "geometry": g} for i, g in enumerate(shapes)])
    (tmp_path / "_skipped.geojson").write_text("no JSON")
    (tmp_path / "one.geojson").write_text(json.dumps(point(1, 1, n=9)))
    got = datasource.read(spark, "geojson", str(tmp_path)).orderBy("path", "feature_no").collect()
    assert [(r.geometry_type, r.xmin, r.ymin, r.xmax, r.ymax) for r in got] == [("Polygon", 0, 0, 4, 3), ("LineString", 1, -6, 5, 2), ("MultiPoint", None, None, None, None), ("GeometryCollection", -7, 1, 7, 8), (None, None, None, None, None), ("Point", 1, 1, 1, 1)]
    assert [json.loads(r.properties)["n"] for r in got] == [0, 1, 2, 3, 4, 9] and json.loads(got[0].geometry) == shapes[0]


def test_geojson_skips_files_and_features(spark, tmp_path):
    """Files that the filters rule out aren't parsed: here they hold no JSON beyond their bounds."""
    collection(tmp_path / "near.geojson", [point(x, 0.5, n=x) for x in range(10)], [0, 0, 9, 1])
    (tmp_path / "far.geojson").write_text('{"type": "FeatureCollection", "bbox": [100, 0, 109, 1], "features": [broken')
    df = datasource.read(spark, "geojson", str(tmp_path)).where("xmin < 50 and xmax >= 7")
    assert sorted(r.xmin for r in df.collect()) == [7, 8, 9]
    assert df.where("geometry_type = 'Polygon'").count() == 0
    by_name = datasource.read(spark, "geojson", str(tmp_path)).where(F.col("path").endswith("near.geojson"))
    assert by_name.count() == 10
    with pytest.raises(Exception, match="Expecting value"):
        datasource.read(spark, "geojson", str(tmp_path)).count()


def test_small_files_share_a_partition(spark, tmp_path, monkeypatch):
    for i in range(6):
        collection(tmp_path / f"{i}.geojson", [point(i, i)])
    reader = datasource.GeoJsonReader({"path": str(tmp_path)})
    assert len(reader.partitions()) == 1
    monkeypatch.setattr(datasource, "_TOGETHER", 2 * os.path.getsize(tmp_path / "0.geojson"))
    assert [len(p.paths) for p in reader.partitions()] == [2, 2, 2]
    empty = tmp_path / "empty"
    empty.mkdir()
    assert datasource.read(spark, "geojson", str(empty)).count() == 0
    with pytest.raises(Exception, match="missing"):
        datasource.read(spark, "geojson", str(tmp_path / "missing")).count()


def test_geojson_round_trip(spark, tmp_path):
    datasource.register(spark)
    df = spark.range(500).repartition(3).select("id", F.struct(F.lit("a").alias("b")).alias("s"), F.lit(None).cast("string").alias("none"), F.when(F.col("id") > 0, F.to_json(F.struct(F.lit("Point").alias("type"), F.array(F.col("id") * 1.5, F.lit(-2.0)).alias("coordinates")))).alias("geometry"))
    path = str(tmp_path / "out")
    for mode in ("append", "overwrite"):
        df.write.format("geojson").mode(mode).save(path)
        got = datasource.read(spark, "geojson", path).collect()
        assert sorted((json.loads(r.properties)["id"], r.xmin) for r in got) == [(i, i * 1.5 if i else None) for i in range(500)]
        files = sorted(os.listdir(path))
        assert len(files) == 3 and not any(f.startswith(".") for f in files)
        box = json.loads(open(f"{path}/{files[0]}").read())["bbox"]
        assert box[1] == box[3] == -2


def test_xlsx_sheets_are_partitions(spark, tmp_path):
    from terrasift.sources import workbook

    frames = [workbook.Sheet(n, spark.createDataFrame([(i, f"{n}<{i}>") for i in range(k)], "a long, b string").orderBy("a"), {}, {}, {}) for n, k in (("One", 3), ("Two", 5))]
    workbook.write_workbook(spark, f"{tmp_path}/w.xlsx", frames)
    workbook.write_workbook(spark, f"{tmp_path}/v.xlsx", frames[:1])
    df = datasource.read(spark, "xlsx", str(tmp_path))
    assert df.rdd.getNumPartitions() == 3
    two = df.where("sheet = 'Two' and col = 1 and row >= 3")
    assert two.rdd.getNumPartitions() == 1 and [r.value for r in two.orderBy("row").collect()] == [f"Two<{i}>" for i in range(1, 5)]
    assert df.where(F.col("path").endswith("v.xlsx")).rdd.getNumPartitions() == 1


def test_xlsx_round_trip(spark, tmp_path):
    datasource.register(spark)
    path = str(tmp_path / "x")
    rows = [(1, "a & <b>", None, 2.5, True), (2, " lead", "Ä", -1e300, False)]
    spark.createDataFrame(rows, "n long, t string, o string, d double, b boolean").coalesce(1).write.format("xlsx").mode("append").save(path)
    got = {(r.row, r.col): r.value for r in datasource.read(spark, "xlsx", path).collect()}
    assert got == {**{(1, i): c for i, c in enumerate("ntodb")}, (2, 0): "1", (2, 1): "a & <b>", (2, 3): "2.5", (2, 4): "True", (3, 0): "2", (3, 1): " lead", (3, 2): "Ä", (3, 3): "-1e+300", (3, 4): "False"}


EXTENT = (0.0, 0.0, 16.0, 16.0)


def test_curve_places(spark):
    got = {(r.x, r.y): r.z for r in spark.range(64).selectExpr("id % 8 as x", "id div 8 as y").withColumn("z", curve.curve(F.col("x"), F.col("y"))).collect()}
    assert all(z == sum((x >> i & 1) << 2 * i | (y >> i & 1) << 2 * i + 1 for i in range(3)) for (x, y), z in got.items())
    big = spark.range(1).select(curve.curve(F.lit(65535).cast("long"), F.lit(0).cast("long")).alias("z")).first().z
    assert big == 0x55555555


@pytest.mark.parametrize("most", [64, 3, 1])
def test_zone_ranges_hold_what_is_sought(most):
    rng = random.Random(most)
    z = lambda x, y: sum((x >> i & 1) << 2 * i | (y >> i & 1) << 2 * i + 1 for i in range(4))
    for _ in range(200):
        x0, x1 = sorted(rng.uniform(-2, 18) for _ in range(2))
        y0, y1 = sorted(rng.uniform(-2, 18) for _ in range(2))
        ranges = curve.zone_ranges((x0, y0, x1, y1), EXTENT, 4, most)
        assert 0 < len(ranges) <= most and ranges == sorted(ranges)
        asked = {n for a, b in ranges for n in range(a, b + 1)}
        clip = lambda v: min(15, max(0, int(v // 1)))
        need = {z(x, y) for x in range(clip(x0), clip(x1) + 1) for y in range(clip(y0), clip(y1) + 1)}
        assert need <= asked and (most < 64 or need == asked)


def test_pruned_extract_is_the_plain_scan(spark, tmp_path):
    rng = random.Random(3)
    rows = [(i, rng.uniform(-1, 17), rng.uniform(-1, 17), f"2024-0{1 + i % 6}-1{i % 10} 12:00:00") for i in range(3000)] + [(9001, None, 1.0, "2024-01-01 00:00:00"), (9002, 1.0, 1.0, None)]
    df = spark.createDataFrame(rows, "i long, x double, y double, s string").select("i", "x", "y", F.col("s").cast("timestamp").alias("at"))
    path = f"{tmp_path}/extract"
    curve.write_extract(df, path, "x", "y", "at", EXTENT)
    assert spark.read.parquet(path).count() == len(rows)
    for bounds, dates in (((3.2, 4.0, 6.9, 8.1), ("2024-02-01 00:00:00", "2024-03-15 00:00:00")), ((0.0, 0.0, 16.0, 16.0), ("2024-01-01 00:00:00", "2024-12-31 00:00:00")), ((-5.0, 12.0, 2.0, 40.0), ("2024-05-11 12:00:00", "2024-05-11 12:00:00"))):
        got = curve.read_extract(spark, path, "x", "y", "at", EXTENT, bounds, dates)
        plain = df.where(F.col("x").between(bounds[0], bounds[2]) & F.col("y").between(bounds[1], bounds[3]) & F.col("at").between(*[F.lit(d).cast("timestamp") for d in dates]))
        assert {r.i for r in got.select("i").collect()} == {r.i for r in plain.collect()}
    narrow = curve.read_extract(spark, path, "x", "y", "at", EXTENT, (3.2, 4.0, 4.9, 5.1), ("2024-02-01 00:00:00", "2024-02-28 00:00:00"))
    assert re.search(r"PartitionFilters: \[[^\]]*month[^\]]*zone", explained(narrow))
    assert 0 < len(narrow.inputFiles()) and len({f for f in narrow.select(F.input_file_name().alias("f")).distinct().collect()}) < 5
