"""Sources and sinks over the star tables; files go to the folder that all executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import rounded
from ..operators.graph import shared_dir
from ..sources import curve, datasource, geojson, manifest, texts, wkb, workbook, xlsx
from .base import Tables, lat, lat_sql, lon, lon_sql, query, r_sql


def _scratch(t: Tables) -> str:
    return f"{shared_dir(t.spark)}/io-{uuid.uuid4().hex}"


@query("io_csv_roundtrip", "SELECT n_nationkey, n_name, n_regionkey FROM nation")
def csv_roundtrip(t: Tables) -> DataFrame:
    """CSV written without nested columns and read under a schema."""
    path = _scratch(t)
    texts.write_csv(t.nation.withColumn("geometry", F.struct("n_nationkey")), path)
    return texts.read_csv(t.spark, path, "n_nationkey int, n_name string, n_regionkey int")


@query("io_parquet_scan", "SELECT 'orders' AS name, count(*) AS n FROM orders UNION ALL SELECT 'events', count(*) FROM events")
def parquet_scan(t: Tables) -> DataFrame:
    """Parquet read, written and counted."""
    path = _scratch(t)
    t.events.select("event_id").write.parquet(path)
    counts = [t.orders.agg(F.lit("orders").alias("name"), F.count(F.lit(1)).alias("n")), t.spark.read.parquet(path).agg(F.lit("events").alias("name"), F.count(F.lit(1)).alias("n"))]
    return counts[0].union(counts[1])


@query("io_json_manifest", "SELECT s_nationkey AS agency_id, CAST(row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) AS INT) AS document_no, s_name AS name, s_suppkey AS size FROM supplier")
def json_manifest(t: Tables) -> DataFrame:
    """Manifests as JSON files, read by pattern and taken apart."""
    path = _scratch(t)
    order = F.array_sort(F.collect_list(F.struct(F.col("s_suppkey").alias("size"), F.col("s_name").alias("name"))))
    t.supplier.groupBy(F.col("s_nationkey").alias("agency_id")).agg(order.alias("documents")).write.json(path)
    read = t.spark.read.schema("agency_id int, documents array<struct<size:long,name:string>>").json(f"{path}/*.json")
    return manifest.documents_of(read).select("agency_id", F.col("document_no").cast("int").alias("document_no"), "name", "size")


@query("io_geojson_features", f"SELECT s_suppkey, s_name, {r_sql(lon_sql('s_suppkey'), 6)} AS lon, {r_sql(lat_sql('s_suppkey'), 6)} AS lat FROM supplier")
def geojson_features(t: Tables) -> DataFrame:
    """Point features written as JSON and parsed from a collection (S02 K02 G-C)."""
    key = F.col("s_suppkey")
    features = t.supplier.select(geojson.point_feature(lon(key), lat(key), F.struct("s_suppkey", "s_name")).alias("f"), (key % 5).alias("part"))
    collections = features.groupBy("part").agg(F.concat(F.lit('{"type":"FeatureCollection","features":['), F.array_join(F.collect_list("f"), ","), F.lit("]}")).alias("doc"))
    parsed = geojson.parse_features(collections, "doc", "s_suppkey long, s_name string")
    return parsed.select("s_suppkey", "s_name", rounded(F.col("point.x"), 6).alias("lon"), rounded(F.col("point.y"), 6).alias("lat"))


@query("io_staleness_todo", "SELECT n_nationkey, CASE WHEN n_nationkey % 3 = 0 THEN 'new' ELSE 'changed' END AS reason FROM nation WHERE n_nationkey % 3 = 0 OR n_nationkey % 4 = 1")
def staleness_todo(t: Tables) -> DataFrame:
    """Extracts that are missing or of another release or bounds."""
    want = t.nation.select("n_nationkey", F.concat(F.lit("r2|"), "n_name").alias("state"))
    held = t.nation.where("n_nationkey % 3 <> 0").select("n_nationkey", F.concat(F.when(F.col("n_nationkey") % 4 == 1, "r1|").otherwise("r2|"), F.col("n_name")).alias("state"))
    return manifest.todo(want, held, "n_nationkey", "state").select("n_nationkey", "reason")


@query("io_orphans", "SELECT n_nationkey FROM nation WHERE n_regionkey = 2")
def orphans(t: Tables) -> DataFrame:
    """Held extracts that nobody asks for."""
    return manifest.orphans(t.nation.where("n_regionkey <> 2"), t.nation.select("n_nationkey"), "n_nationkey")


@query("io_sparse_rows", "SELECT CAST(r_regionkey + 2 AS BIGINT) AS row, CAST(r_regionkey AS VARCHAR) AS id, CASE WHEN r_regionkey % 2 = 0 THEN r_name END AS name FROM region WHERE r_regionkey <> 3")
def sparse_rows(t: Tables) -> DataFrame:
    """Cells under a header; empty ones null, rows without a first cell out."""
    row = (F.col("r_regionkey") + 2).cast("long")
    ids = t.region.select(row.alias("row"), F.lit(0).alias("col"), F.when(F.col("r_regionkey") != 3, F.col("r_regionkey").cast("string")).otherwise("").alias("value"))
    names = t.region.select(row.alias("row"), F.lit(1).alias("col"), F.when(F.col("r_regionkey") % 2 == 0, F.col("r_name")).otherwise(" ").alias("value"))
    return xlsx.header_rows(ids.union(names), ["id", "name"]).select("row", "id", "name")


@query("io_formula_errors", "SELECT p_partkey FROM part WHERE p_partkey % 50 = 0")
def formula_errors(t: Tables) -> DataFrame:
    """Rows that show a spreadsheet error."""
    return texts.formula_errors(t.part.select("p_partkey", F.when(F.col("p_partkey") % 50 == 0, "#DIV/0!").otherwise("fine").alias("cell"))).select("p_partkey")


@query("io_page_text", f"SELECT user_id, md5(string_agg('===== PAGE ' || page || ' =====' || chr(10) || body, chr(10) ORDER BY page)) AS digest, {r_sql('sum(c)::DOUBLE / count(c) / 1000000')} AS mean_confidence FROM (SELECT user_id, day(ts) AS page, string_agg(event_type, chr(10) ORDER BY -(value + 1), event_id) AS body, CAST(floor(sum(CAST(round(value * 1000000) AS BIGINT))::DOUBLE / count(value) + 0.5) AS BIGINT) AS c FROM events GROUP BY ALL) GROUP BY user_id")
def page_text(t: Tables) -> DataFrame:
    """Observations as page-marked text."""
    from ..functions.numeric import rounded

    obs = t.events.select("user_id", F.dayofmonth("ts").alias("page"), F.col("event_type").alias("text"), F.col("value").alias("confidence"), F.col("event_id").cast("double").alias("x"), F.col("value").alias("y"), F.lit(1.0).alias("height"))
    return texts.page_text(obs, "user_id").select("user_id", F.md5("text").alias("digest"), rounded(F.col("mean_confidence")).alias("mean_confidence"))


@query("io_geoparquet", "SELECT p_partkey, 'Polygon' AS kind, (p_partkey % 100)::DOUBLE AS xmin, (p_partkey % 100 + p_size)::DOUBLE AS xmax, 1::BIGINT AS rings FROM part")
def geoparquet(t: Tables) -> DataFrame:
    """Polygons written as well-known binary in Parquet and read."""
    path = _scratch(t)
    x0, x1 = (F.col("p_partkey") % 100).cast("double"), (F.col("p_partkey") % 100 + F.col("p_size")).cast("double")
    ring = F.array(*[F.struct(x.alias("x"), F.lit(y).alias("y")) for x, y in ((x0, 0.0), (x1, 0.0), (x1, 2.0), (x0, 2.0), (x0, 0.0))])
    t.part.select("p_partkey", wkb.to_wkb(polygons=F.array(F.array(ring))).alias("geometry")).write.parquet(path)
    outer = F.col("geometry.polygons")[0][0]
    out = wkb.read_geoparquet(t.spark, path).select("p_partkey", F.col("geometry.kind").alias("kind"), F.transform(outer, lambda p: p["x"]).alias("x"), F.size(F.col("geometry.polygons")[0]).cast("long").alias("rings"))
    return out.select("p_partkey", "kind", F.array_min("x").alias("xmin"), F.array_max("x").alias("xmax"), "rings")


@query("io_workbook", "SELECT CAST(n_nationkey + 2 AS BIGINT) AS row, CAST(n_nationkey AS VARCHAR) AS key, n_name AS name FROM nation")
def workbook_roundtrip(t: Tables) -> DataFrame:
    """A workbook written and its cells read from the file."""
    path = f"{_scratch(t)}.xlsx"
    table = t.nation.orderBy("n_nationkey").select("n_nationkey", "n_name", F.lit(None).cast("string").alias("double"))
    workbook.write_workbook(t.spark, path, [workbook.Sheet("Nations", table, {"n_name": 30.0}, {"n_nationkey": "0"}, {"double": "A{row}*2"})])
    return xlsx.header_rows(xlsx.read_xlsx(t.spark, path, "Nations"), ["key", "name"]).select("row", "key", "name")


@query("io_package", "SELECT 3 AS files, 2 AS done")
def packaged(t: Tables) -> DataFrame:
    """A manifest replaced after every item, and a package of required files."""
    base = _scratch(t)
    for done in (1, 2):
        workbook.write_manifest(t.spark, f"{base}/manifest.json", {"done": done})
    for name in ("a.txt", "b.txt"):
        workbook.replace_file(t.spark, f"{base}/{name}", name.encode())
    files = workbook.package(t.spark, base, ["manifest.json", "a.txt", "b.txt"], f"{base}/out.zip", "bundle")
    return t.spark.read.json(f"{base}/manifest.json", multiLine=True).select(F.lit(files).alias("files"), F.col("done").cast("int").alias("done"))


@query("io_page_files", "SELECT n_nationkey % 3 + 1 AS documents, count(*) AS pages, sum(n_nationkey) AS total FROM nation GROUP BY ALL")
def page_files(t: Tables) -> DataFrame:
    """Recognised text and observations written as files and read whole."""
    base = _scratch(t)
    t.nation.select((F.col("n_nationkey") % 3 + 1).alias("page"), F.concat(F.lit("no "), "n_nationkey").alias("text"), F.lit(1.0).alias("confidence")).write.json(f"{base}/observations")
    obs = texts.read_observations(t.spark, f"{base}/observations")
    return obs.groupBy(F.col("page").cast("int").alias("documents")).agg(F.count(F.lit(1)).alias("pages"), F.sum(F.regexp_extract("text", "[0-9]+", 0).cast("long")).alias("total"))


@query("io_geojson_source", f"SELECT c_custkey, c_mktsegment, {r_sql(lon_sql('c_custkey'), 6)} AS lon, {r_sql(lat_sql('c_custkey'), 6)} AS lat FROM customer WHERE {lon_sql('c_custkey')} >= -88.25 AND {lon_sql('c_custkey')} < -88.15 AND {lat_sql('c_custkey')} <= 41.85")
def geojson_source(t: Tables) -> DataFrame:
    """Features written by df.write and read by spark.read of the format geojson, bounds handed to the reader."""
    path, key = _scratch(t), F.col("c_custkey")
    datasource.register(t.spark)
    geometry = F.to_json(F.struct(F.lit("Point").alias("type"), F.array(lon(key), lat(key)).alias("coordinates")))
    t.customer.select("c_custkey", "c_mktsegment", geometry.alias("geometry")).write.format("geojson").mode("append").save(path)
    found = datasource.read(t.spark, "geojson", path).where("xmin >= -88.25 and xmax < -88.15 and ymax <= 41.85")
    p = F.from_json("properties", "c_custkey long, c_mktsegment string").alias("p")
    return found.select(p, "xmin", "ymin").select("p.*", rounded(F.col("xmin"), 6).alias("lon"), rounded(F.col("ymin"), 6).alias("lat"))


@query("io_xlsx_source", "SELECT CAST(s_suppkey AS VARCHAR) AS key, s_name AS name, CAST(s_nationkey AS VARCHAR) AS nation FROM supplier")
def xlsx_source(t: Tables) -> DataFrame:
    """Sheets written by df.write and read by spark.read of the format xlsx, a partition a sheet."""
    path = _scratch(t)
    datasource.register(t.spark)
    t.supplier.select("s_suppkey", "s_name", "s_nationkey", F.lit(None).cast("string").alias("empty")).repartition(4, "s_suppkey").write.format("xlsx").mode("append").save(path)
    cells = datasource.read(t.spark, "xlsx", path).where("row > 1 and sheet = 'Sheet1'")
    return xlsx.header_rows(cells, ["key", "name", "nation"], ["path"]).select("key", "name", "nation")


_EXTENT, _SOUGHT, _DAYS = (-88.3, 41.7, -88.05, 41.9), (-88.25, 41.72, -88.15, 41.85), ("2024-01-03 00:00:00", "2024-01-20 00:00:00")


@query("io_pruned_extract", f"SELECT event_id, event_type, value FROM events WHERE {lon_sql('user_id')} BETWEEN {_SOUGHT[0]} AND {_SOUGHT[2]} AND {lat_sql('user_id')} BETWEEN {_SOUGHT[1]} AND {_SOUGHT[3]} AND ts BETWEEN TIMESTAMP '{_DAYS[0]}' AND TIMESTAMP '{_DAYS[1]}'")
def pruned_extract(t: Tables) -> DataFrame:
    """An extract laid out along a curve of places and by month, and the rows of some bounds and dates, of which folders say most."""
    path = _scratch(t)
    placed = t.events.withColumns({"lon": lon(F.col("user_id")), "lat": lat(F.col("user_id"))})
    curve.write_extract(placed, path, "lon", "lat", "ts", _EXTENT)
    return curve.read_extract(t.spark, path, "lon", "lat", "ts", _EXTENT, _SOUGHT, _DAYS).select("event_id", "event_type", "value")


_PDF = "'%PDF-1.4 ' || repeat('<< /Type /Page /Parent 1 0 R >> ', CAST(p_size % 9 AS INT)) || '<< /Type/Page>> << /Type /Pages /Kids [] >> /Type /PageLabels'"


@query("io_pdf_pages", f"SELECT p_partkey, CAST(len(regexp_extract_all({_PDF}, '/Type\\s*/Page[^s]')) AS INT) AS pages, length({_PDF}) AS size FROM part")
def pdf_page_counts(t: Tables) -> DataFrame:
    """Page objects counted in the plain part of binary files, each read whole by a task."""
    path = _scratch(t)
    body = F.concat(F.lit("%PDF-1.4 "), F.repeat(F.lit("<< /Type /Page /Parent 1 0 R >> "), (F.col("p_size") % 9).cast("int")), F.lit("<< /Type/Page>> << /Type /Pages /Kids [] >> /Type /PageLabels"))
    t.part.select("p_partkey", F.encode(body, "ISO-8859-1").alias("content")).write.parquet(path)
    return t.spark.read.parquet(path).select("p_partkey", texts.pdf_pages(F.col("content")).alias("pages"), F.length("content").cast("long").alias("size"))


@query("io_text_files", "SELECT n_regionkey AS region, count(*) AS lines, string_agg(n_name, '|' ORDER BY n_nationkey) AS names FROM nation GROUP BY n_regionkey")
def text_files(t: Tables) -> DataFrame:
    """Texts written a file a region and read whole, a row a file."""
    path = _scratch(t)
    t.nation.orderBy("n_nationkey").select(F.concat_ws(" ", F.col("n_nationkey").cast("string"), "n_name").alias("value"), F.col("n_regionkey").alias("region")).repartition(5, "region").sortWithinPartitions("region").write.partitionBy("region").text(path)
    whole = texts.read_pages(t.spark, path).withColumn("line", F.explode(F.split(F.rtrim(F.regexp_replace("text", "\\s+$", "")), "\n")))
    parts = whole.select(F.regexp_extract("path", "region=([0-9]+)", 1).cast("int").alias("region"), F.regexp_extract("line", "^([0-9]+) (.*)$", 1).cast("int").alias("k"), F.regexp_extract("line", "^([0-9]+) (.*)$", 2).alias("name"))
    listed = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "name"))), lambda s: s["name"]), "|")
    return parts.groupBy("region").agg(F.count(F.lit(1)).alias("lines"), listed.alias("names"))
