"""Operators against brute force and closed forms."""

import io
import math
import struct
import unicodedata
import zipfile

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from terrasift.functions import geo as G
from terrasift.functions import polygon_udf as P
from terrasift.functions import text as T
from terrasift.operators import docs, equipment, graph, landcover, match, raster, rollup, spatial, survive, vectors
from terrasift.plans import registry
from terrasift.sources import geojson, html_table, manifest, texts, wkb, xlsx
from terrasift.sources import workbook as sink
from terrasift.streaming import ingest

box = st.tuples(*[st.integers(0, 20)] * 2, *[st.integers(1, 9)] * 2)


def ring(x, y, w, h):
    return [{"x": x, "y": y}, {"x": x + w, "y": y}, {"x": x + w, "y": y + h}, {"x": x, "y": y + h}]


@settings(max_examples=60, deadline=None)
@given(box, box)
def test_overlap_of_boxes(a, b):
    w = max(0, min(a[0] + a[2], b[0] + b[2]) - max(a[0], b[0]))
    h = max(0, min(a[1] + a[3], b[1] + b[3]) - max(a[1], b[1]))
    assert P.overlap([ring(*a)], [ring(*b)]) == pytest.approx(w * h)
    assert P.union_area([[ring(*a)], [ring(*b)]]) == pytest.approx(a[2] * a[3] + b[2] * b[3] - w * h)


def test_overlap_with_hole_and_slopes():
    holed = [ring(0, 0, 10, 10), ring(4, 4, 2, 2)]
    triangle = [[{"x": 0, "y": 0}, {"x": 10, "y": 0}, {"x": 0, "y": 10}]]
    assert P.overlap(holed, [ring(3, 3, 4, 4)]) == pytest.approx(12)
    assert P.overlap(triangle, [ring(0, 0, 10, 10)]) == pytest.approx(50)
    assert P.overlap(triangle, [ring(5, 5, 5, 5)]) == pytest.approx(0)
    assert P.overlap(None, holed) == 0


def test_valid_rings():
    assert P.valid_ring(ring(0, 0, 1, 1))
    assert not P.valid_ring([{"x": 0, "y": 0}, {"x": 1, "y": 1}, {"x": 1, "y": 0}, {"x": 0, "y": 1}])
    assert not P.valid_ring(None) and not P.valid_ring([{"x": 0, "y": 0}] * 4)


def test_buffer_area_near_circle_form():
    exact = 20 + 2 * (4 + 5) * 3 + math.pi * 9
    assert P.buffered_area(ring(0, 0, 4, 5), 3.0) == pytest.approx(exact, rel=2e-3)


def test_projections(spark):
    row = spark.range(1).select(G.albers(F.lit(-96.0), F.lit(23.0)).alias("o"), G.utm(F.lit(-87.0), F.lit(0.0)).alias("u"), G.utm(F.lit(-88.2), F.lit(41.8)).alias("p")).first()
    assert abs(row.o.x) < 1e-6 and abs(row.o.y) < 1e-6
    assert row.u.x == pytest.approx(500000) and abs(row.u.y) < 1e-6
    back = spark.range(1).select(G.inverse_utm(F.lit(row.p.x), F.lit(row.p.y)).alias("b")).first().b
    assert (back.lon, back.lat) == (pytest.approx(-88.2, abs=1e-9), pytest.approx(41.8, abs=1e-9))


def test_equal_area(spark):
    """A small cell keeps its area: a degree cell on the ellipsoid by its closed form."""
    e2, a = G.ECCENTRICITY2, G.SEMI_MAJOR
    q = lambda la: (1 - e2) * (math.sin(la) / (1 - e2 * math.sin(la) ** 2) + math.atanh(math.sqrt(e2) * math.sin(la)) / math.sqrt(e2))
    d = 1e-3
    true = a * a / 2 * math.radians(d) * (q(math.radians(41.8 + d)) - q(math.radians(41.8)))
    corner = lambda x, y: G.albers(F.lit(-88.0 + x), F.lit(41.8 + y))
    got = spark.range(1).select(G.ring_area(F.array(corner(0, 0), corner(d, 0), corner(d, d), corner(0, d))).alias("a")).first().a
    assert got == pytest.approx(true, rel=1e-6)


@settings(max_examples=8, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 15), st.integers(0, 15)), max_size=20))
def test_components_any_order(spark, edges):
    nodes = spark.range(16).withColumnRenamed("id", "node")
    df = spark.createDataFrame(edges, "a long, b long")
    got = {r.node: r.component for r in graph.components(nodes, df).collect()}
    root = list(range(16))
    for _ in range(16):
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    assert got == dict(enumerate(root))


def test_distance_join_is_brute_force(spark):
    rng = np.random.default_rng(1)
    a, b = rng.uniform(-3000, 3000, (60, 2)), rng.uniform(-3000, 3000, (70, 2))
    left = spark.createDataFrame([(i, {"x": float(x), "y": float(y)}) for i, (x, y) in enumerate(a)], "i int, point struct<x:double,y:double>")
    right = spark.createDataFrame([(i, {"x": float(x), "y": float(y)}) for i, (x, y) in enumerate(b)], "j int, other_point struct<x:double,y:double>")
    d = np.hypot(*(a[:, None] - b[None]).transpose(2, 0, 1))
    got = {(r.i, r.j) for r in spatial.distance_join(left, right, 700.0).collect()}
    assert got == set(zip(*map(lambda v: v.tolist(), np.nonzero(d <= 700)), strict=True))
    near = {r.i: r.j for r in spatial.nearest(left, right, "i", "j", 100.0).collect()}
    assert near == dict(enumerate(d.argmin(1).tolist()))


def test_box_pairs(spark):
    boxes = spark.createDataFrame([(i, {"xmin": float(x), "ymin": float(y), "xmax": x + 3.0, "ymax": y + 2.0}) for i, (x, y) in enumerate([(0, 0), (2, 1), (9, 9), (3, 2)])], "id int, box struct<xmin:double,ymin:double,xmax:double,ymax:double>")
    got = sorted((r.a.id, r.b.id) for r in spatial.box_pairs(boxes, "id", 2.0).collect())
    assert got == [(0, 1), (0, 3), (1, 0), (1, 3), (3, 0), (3, 1)]


NAMES = ["ORD-01 Data Center", "Chicago II", "CHI05 & Co", "T5", "", None, "The Site of Park", "alpha beta"]


def test_names(spark):
    df = spark.createDataFrame([(n,) for n in NAMES], "n string")
    rows = df.select(T.normalize_name(F.col("n")).alias("n"), T.facility_codes(F.col("n")).alias("c")).collect()
    assert [r.n for r in rows] == ["ord 01", "chicago ii", "chi05", "t5", "", "", "", "alpha beta"]
    assert [r.c for r in rows] == [["ord1"], ["chicago2"], ["chi5"], [], [], [], [], []]


@settings(max_examples=15, deadline=None)
@given(st.text("abc dc&", max_size=12), st.text("abc dc&", max_size=12))
def test_name_score_is_symmetric(spark, a, b):
    r = spark.createDataFrame([(a, b)], "a string, b string").select(match.name_score(F.col("a"), F.col("b")).alias("x"), match.name_score(F.col("b"), F.col("a")).alias("y")).first()
    assert r.x == r.y and 0 <= r.x <= 1


def test_match_rules(spark):
    kind = "struct<source:string,status:string,tokens:array<string>,codes:array<string>>"
    plant = lambda source, status, tokens, codes: {"source": source, "status": status, "tokens": tokens, "codes": codes}
    far, near = plant("layer", "x", ["a", "b", "c"], []), plant("curated", " Operating", ["a", "b", "c"], [])
    cases = [
        (0.0, 1.0, plant("layer", "x", ["a"], ["a1"]), plant("layer", "x", ["a"], ["a2"]), "candidate_only_code_conflict"),
        (101.0, 1.0, plant("registry", "x", ["a"], []), far, "candidate_only_low_specificity"),
        (100.0, 0.0, far, near, "spatial_100m"),
        (100.0, 0.2, far, plant("curated", "Proposed", ["a"], []), "candidate_only"),
        (100.0, 0.3, far, plant("curated", "Proposed", ["a"], []), "spatial_100m"),
        (500.0, 0.3, far, near, "name_supported_500m"),
        (1000.0, 0.45, far, near, "strong_name_supported_1km"),
        (1000.0, 0.44, far, near, "candidate_only"),
    ]
    df = spark.createDataFrame(cases, f"d double, s double, l {kind}, r {kind}, want string")
    for r in df.select("want", match.match_rule(F.col("d"), F.col("s"), F.col("l"), F.col("r")).alias("got")).collect():
        assert r.got == r.want


def test_breakpoint_rules(spark):
    rows = [("a", y, s) for y, s in ((2016, 10.0), (2017, 43.06), (2019, 40.0))] + [("b", 2016, 45.0), ("b", 2017, 45.0), ("b", 2018, 50.0)] + [("c", 2016, 1.0)] + [("d", 2016, 1.0), ("d", 2017, 17.0), ("d", 2018, 33.0)]
    got = {r.u: r for r in landcover.breakpoints(spark.createDataFrame(rows, "u string, y int, s double"), "u", "y", "s").collect()}
    assert (got["a"].max_year, got["a"].result, round(got["a"].max_rise, 2)) == (2017, "candidate_breakpoint", 33.06)
    assert got["b"].result == "mature_before_archive" and got["c"].result == "no_clear_breakpoint"
    assert got["d"].max_year == 2017  # the first of equal rises
    nan = landcover.breakpoints(spark.createDataFrame([("n", 1, float("nan")), ("n", 2, 50.0)], "u string, y int, s double"), "u", "y", "s").first()
    assert nan.result == "no_clear_breakpoint"


def test_regions_are_brute_force(spark):
    rng = np.random.default_rng(2)
    cells = sorted({(int(r), int(c)) for r, c in rng.integers(0, 12, (60, 2))})
    got = {(r.row, r.col): r.region for r in raster.label_regions(spark.createDataFrame([(0, r, c) for r, c in cells], "u int, row long, col long"), "u").collect()}
    left, want = set(cells), {}
    while left:
        stack = [left.pop()]
        group = set(stack)
        while stack:
            r, c = stack.pop()
            for n in [(r + i, c + j) for i in (-1, 0, 1) for j in (-1, 0, 1)]:
                if n in left:
                    left.discard(n)
                    group.add(n)
                    stack.append(n)
        for cell in group:
            want[cell] = min(r * (1 << 32) + c for r, c in group)
    assert got == want


def test_equipment():
    text = "===== PAGE 1 =====\nThree (3) emergency 2,250 kW (3,017 HP) diesel generators G-1 to G-3 by Cummins with a DPF. Elsewhere one 40 kW lamp."
    assert [g[:7] for g in equipment.equipment_of(text)] == [(1, 3, 2250, 3017, "G-1 to G-3", "Diesel particulate filter", "Cummins")]
    assert equipment.equipment_of("") == [] and equipment.equipment_of(None) == []


@pytest.mark.parametrize(
    "body, want",
    [
        ("thirty-two 2,000 kW standby generators", [(32, 2000, None, True, "Medium")]),
        ("(4) units, 1,340 BHP each, 1,000 kW emergency generators", [(4, 1000, 1340, True, "Medium")]),
        ("(4) 750-HP emergency gensets", [(4, None, 750, True, "Medium")]),
        ("(4) 750 HP emergency gensets, that is (4) 500 kW (750 HP) emergency generators", [(4, 500, 750, True, "Medium")]),
        ("(4) 500 kW (750 HP) emergency generators; a 500 kW engine for an emergency generator", [(4, 500, 750, True, "Medium")]),
        ("1,250 kW, backup power, generator", [(1, 1250, None, False, "Medium")]),
        ("(201) 500 kW emergency generators and (3) 50 kW emergency generators" + "." * 110 + "(3) 500 kW generators", [(1, 500, None, False, "Medium")]),
        ("(2) 600 kW emergency generators. Consisting of (5) 700 kW emergency generators. This permit is subject to (9) 800 kW emergency generators", [(2, 600, None, True, "High"), (5, 700, None, True, "High")]),
        ("(2) 600 kW emergency generators" + "." * 99 + "Description of emission unit to be operated: (6) 900 kW emergency generators", [(6, 900, None, True, "Medium")]),
    ],
)
def test_equipment_shapes(body, want):
    got = equipment.equipment_of(f"cover\n===== PAGE 4 =====\n{body}")
    assert [(g.quantity, g.kw, g.hp, g.stated, g.confidence) for g in got] == want and all(g.page == 1 for g in got)


def test_dates_as_scans_have_them(spark):
    texts = ["5/7/2020", " 05/07/20 ;", "MAY 7, 2020.", "may  7, 2020", "September 30, 1999", "sep 30, 1999", "1/2/69", "13/1/2020", "May 2020", "", None]
    got = [r.d for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").orderBy("i").select(T.parse_date(F.col("t")).alias("d")).collect()]
    assert [str(d) if d else None for d in got] == ["2020-05-07"] * 4 + ["1999-09-30"] * 2 + ["1969-01-02", None, None, None, None]


def test_evidence_pairs_are_brute_force(spark):
    rng = np.random.default_rng(3)
    rows = [(i % 2, i, " ".join(map(str, rng.choice(9, 6, replace=False)))) for i in range(40)]
    got = {(r.a, r.b) for r in docs.near_duplicate_evidence(spark.createDataFrame(rows, "g int, k int, t string"), "g", "k", "t", 0.7).collect()}
    sets = {k: set(t.split()) for _, k, t in rows}
    assert got == {(a, b) for g, a, _ in rows for h, b, _ in rows if g == h and a < b and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.7}


def test_evidence_pairs_meet_in_blocks_not_by_tokens(spark, monkeypatch):
    """A word that all documents of a group share makes no pairs, a block is bounded, and sets of all sizes, repeated keys and nulls come out as by brute force."""
    monkeypatch.setattr(docs, "BLOCK", 16)
    rng = np.random.default_rng(5)
    rows = []
    for k in range(60):
        base = rng.choice(5_000, int(rng.integers(1, 400)), replace=False)
        for copy in range(2):
            own = np.where(rng.random(len(base)) < rng.choice([0.0, 0.1, 0.2]), rng.integers(5_000, 9_000, len(base)), base)
            rows.append((["g", "h"][k % 2], int(rng.integers(0, 90)), " ".join(map(str, own)) + " word"))
    rows += [(None, 1, "word"), (None, 2, "word"), ("g", None, "word"), ("g", 3, None), ("g", 4, " . ")]
    df = docs.near_duplicate_evidence(spark.createDataFrame(rows, "g string, k int, t string"), "g", "k", "t")
    got = sorted((r.g, r.a, r.b, round(r.jaccard, 9)) for r in df.collect())
    sets = [(g, k, set(t.split())) for g, k, t in rows[:120]]
    expected = sorted((g, a, b, round(len(x & y) / len(x | y), 9)) for g, a, x in sets for h, b, y in sets if g == h and a < b and len(x & y) / len(x | y) >= 0.72)
    assert got == expected and len(got) > 15


def test_texts_of_one_file_are_many_tasks(spark, tmp_path):
    """A small file is one partition, but its texts are read by all cores, and a ring is worked out once and not again for each of its corners."""
    spark.range(100).coalesce(1).write.parquet(f"{tmp_path}/t")
    one = spark.read.parquet(f"{tmp_path}/t")
    found = equipment.equipment(one.select("id", F.lit("===== PAGE 1 =====\n(3) 2,000 kW emergency generators").alias("t")), "id", "t")
    tasks = found.select(F.spark_partition_id().alias("p"), "quantity").groupBy("p").agg(F.count(F.lit(1)).alias("n")).collect()
    assert len(tasks) >= 8 and sum(r.n for r in tasks) == 100
    ring = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.struct(F.cos(i + F.col("id")).alias("x"), F.sin(i + F.col("id")).alias("y")))
    plan = one.select(G.ring_area(ring).alias("a"))._jdf.queryExecution().analyzed().toString()
    assert plan.count("COS(") <= 5 and "get(" not in plan


def test_whitening(spark, data):
    df = vectors.whiten(spark.read.parquet(f"{data}/embeddings.parquet"), "embedding", "w")
    x = np.stack([r.w for r in df.select("w").collect()])
    assert np.allclose(np.linalg.norm(x, axis=1), 1)
    cov = np.cov(x.T) * x.shape[1]
    assert np.abs(cov - np.eye(len(cov))).max() < 0.4  # rows are scaled to unit length after whitening


def test_greedy_spread(spark):
    rng = np.random.default_rng(4)
    pts = rng.uniform(0, 3000, (80, 2))
    df = spark.createDataFrame([(0, i, float(x), float(y), i) for i, (x, y) in enumerate(pts)], "u int, k int, x double, y double, rank int")
    kept = []
    for i, p in enumerate(pts):
        if all(np.hypot(*(p - pts[j])) > 500 for j in kept):
            kept.append(i)
    assert sorted(r.k for r in vectors.greedy_spread(df, "u", 500.0).collect()) == kept


def test_ascii_fold_is_nfkd(spark, data):
    rows = spark.read.parquet(f"{data}/documents.parquet").limit(20).select("text", T.ascii_fold(F.col("text")).alias("f")).collect()
    assert all(r.f == unicodedata.normalize("NFKD", r.text).encode("ascii", "ignore").decode() for r in rows)


def test_checks(spark):
    with pytest.raises(AssertionError):
        rollup.require_none(spark.range(1), "rows")
    rollup.require_none(spark.range(0), "rows")


def test_survivor_is_first_in_order(spark):
    rows = [("g", "a", "registry", "r", "", "", "x", 1), ("g", "b", "building", "l", "N", "O", "x", 2), ("g", "c", "campus", "l", "", "", "x", 3)]
    got = survive.summarize(spark.createDataFrame(rows, "group_id string, record_id string, layer string, source string, name string, operator string, status string, ord int")).first()
    assert (got.primary_id, got.name, got.operator, got.confidence) == ("c", "N", "O", "multi_source")


def workbook(rows):
    out, shared = io.BytesIO(), []
    cells = ""
    for r, row in enumerate(rows, 1):
        cells += f'<row r="{r}">'
        for c, v in row:
            shared.append(v)
            cells += f'<c r="{c}{r}" t="s"><v>{len(shared) - 1}</v></c>'
        cells += "</row>"
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {ns}><sheets><sheet name="S" sheetId="1" r:id="rId1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Target="worksheets/sheet1.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", f"<sst {ns}>" + "".join(f"<si><t>{s}</t></si>" for s in shared) + "</sst>")
        z.writestr("xl/worksheets/sheet1.xml", f"<worksheet {ns}><sheetData>{cells}</sheetData></worksheet>")
    return out.getvalue()


def test_xlsx(spark, tmp_path):
    (tmp_path / "a.xlsx").write_bytes(workbook([[("A", "id"), ("AB", "far")], [("A", "7"), ("B", "x")], [("B", "no id")]]))
    cells = xlsx.read_xlsx(spark, f"file://{tmp_path}/a.xlsx", "S")
    assert {(r.row, r.col, r.value) for r in cells.collect()} == {(1, 0, "id"), (1, 27, "far"), (2, 0, "7"), (2, 1, "x"), (3, 1, "no id")}
    assert [tuple(r) for r in xlsx.header_rows(cells, ["id", "name"]).collect()] == [(2, "7", "x")]


def test_geojson_polygons(spark, tmp_path):
    doc = '{"type":"FeatureCollection","features":[{"type":"Feature","properties":{"k":1},"geometry":{"type":"Polygon","coordinates":[[[0,0],[4,0],[4,3],[0,0]]]}},{"type":"Feature","properties":{"k":2},"geometry":{"type":"MultiPolygon","coordinates":[[[[0,0],[1,0],[1,1],[0,0]]],[[[5,5],[6,5],[6,6],[5,5]]]]}}]}'
    (tmp_path / "f.geojson").write_text(doc)
    rows = geojson.read_geojson(spark, f"file://{tmp_path}/f.geojson", "k int").orderBy("k")
    got = rows.select("k", F.size("parts").alias("n"), G.polygon_area(F.col("parts")[0]).alias("a")).collect()
    assert [tuple(r) for r in got] == [(1, 1, 6.0), (2, 2, 0.5)]
    one = rows.select(geojson.polygon_feature(F.col("parts")[0], F.struct("k")).alias("f")).first().f
    assert one.startswith('{"type":"Feature","properties":{"k":1},"geometry":{"type":"Polygon"')


def test_text_sources(spark, tmp_path):
    (tmp_path / "p.txt").write_text("===== PAGE 1 =====\nx")
    assert texts.read_pages(spark, f"file://{tmp_path}/p.txt").first().text.endswith("x")
    assert texts.list_files(spark, f"file://{tmp_path}", "*.txt").count() == 1
    pdf = spark.createDataFrame([(bytearray(b"%PDF-1.4 /Type /Page /x /Type /Pages /Type/Page>"),)], "content binary")
    assert tuple(pdf.select(texts.is_pdf(F.col("content")), texts.pdf_pages(F.col("content"))).first()) == (True, 2)
    state = spark.createDataFrame([(1, bytearray(b"ab"))], "k int, content binary")
    held = spark.createDataFrame([(1, 2, "fb8e20fc2e4c3f248c60c39bd652f3c1347298bb977b8b4d5903b85055620603"), (2, 1, "x")], "k int, size int, sha256 string")
    assert {r.k: r.verified for r in manifest.verified(state, held, "k").collect()} == {1: True, 2: False}
    assert html_table.rows_of('<tr><td>a <b>c</b></td><td><a href="/x">l</a></td></tr>') == [(["a c", "l"], ["/x"])]
    assert html_table.rows_of(None) == []


def test_stream_keeps_new_contents_once(spark, tmp_path):
    source, sink, at = tmp_path / "in", tmp_path / "out", tmp_path / "at"
    df = spark.createDataFrame([("a", "1"), ("b", "2")], "name string, content string")
    df.coalesce(1).write.parquet(f"file://{source}")
    ingest.run_available(spark, f"file://{source}", df.schema, f"file://{sink}", f"file://{at}", "name", "content")
    df.union(spark.createDataFrame([("a", "1"), ("b", "3")], "name string, content string")).coalesce(1).write.mode("append").parquet(f"file://{source}")
    ingest.run_available(spark, f"file://{source}", df.schema, f"file://{sink}", f"file://{at}", "name", "content")
    assert sorted(tuple(r) for r in spark.read.parquet(f"file://{sink}").select("name", "content").collect()) == [("a", "1"), ("b", "2"), ("b", "3")]


def test_stream_windows(spark, data, tmp_path):
    schema = spark.read.parquet(f"{data}/events.parquet").schema
    counts = ingest.windowed_counts(spark.read.schema(schema).parquet(f"{data}/events.parquet"), "ts", "event_type", "1 day")
    assert counts.agg(F.sum("n")).first()[0] == 1000


def test_empty_tables(spark):
    empty = spark.createDataFrame([], "u string, y int, s double")
    assert landcover.breakpoints(empty, "u", "y", "s").count() == 0
    assert rollup.gap_filled(spark.createDataFrame([], "t int, n long"), "t", "n").count() == 0
    assert graph.components(spark.createDataFrame([], "node long"), spark.createDataFrame([], "a long, b long")).count() == 0
    assert registry.QUERIES


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.lists(st.tuples(st.floats(-1e6, 1e6), st.floats(-1e6, 1e6)), min_size=4, max_size=6), min_size=1, max_size=3), min_size=1, max_size=3))
def test_well_known_binary_round_trip(polygons):
    polygons = [[[{"x": x, "y": y} for x, y in r] for r in rings] for rings in polygons]
    kind, point, got, _ = wkb.decode(wkb.encode(None, polygons))
    assert (kind, point, got) == ("Polygon" if len(polygons) == 1 else "MultiPolygon", None, polygons)


def test_well_known_binary_of_points_and_odd_values():
    assert wkb.decode(struct.pack(">BI2d", 0, 1, 3.5, -2.0)) == ("Point", {"x": 3.5, "y": -2.0}, None, None)
    assert wkb.decode(wkb.encode({"x": 1.0, "y": 2.0}, None))[1] == {"x": 1.0, "y": 2.0}
    assert wkb.encode(None, None) is None and wkb.decode(None) == (None, None, None, None)
    line = [{"x": 1.0, "y": 2.0}, {"x": 3.0, "y": 4.0}]
    heights = struct.pack("<BII6d", 1, 1002, 2, 1, 2, 9, 3, 4, 9)
    assert wkb.decode(heights) == wkb.decode(struct.pack("<BIII8d", 1, 0xE0000002, 4326, 2, 1, 2, 9, 9, 3, 4, 9, 9)) == ("LineString", None, None, [line])
    assert wkb.decode(struct.pack("<BII", 1, 5, 1) + struct.pack(">BII4d", 0, 2, 2, 1, 2, 3, 4)) == ("MultiLineString", None, None, [line])
    assert wkb.decode(struct.pack("<BII", 1, 4, 1) + struct.pack("<BI2d", 1, 1, 1, 2)) == ("MultiPoint", None, None, [line[:1]])
    for unknown in (7, 15):
        with pytest.raises(ValueError, match="is not read"):
            wkb.decode(struct.pack("<BII", 1, unknown, 0))


def test_workbook(spark):
    table = spark.createDataFrame([(1, "a & <b>", 2.5, True), (2, None, float("nan"), None)], "k int, t string, v double, f boolean").withColumn("d", F.lit("2024-03-01").cast("date"))
    book = sink.workbook_bytes([sink.Sheet("One", table, {"t": 40.0}, {"v": "#,##0.00"}, {"f": 'IF(A{row}="","",A{row}*2)'}, 2), sink.Sheet("Two", table.limit(0))])
    cells = {(r, c): v for r, c, v in xlsx.sheet_cells(book, "One")}
    assert cells[(1, 1)] == "t" and cells[(2, 0)] == "1" and cells[(2, 1)] == "a & <b>" and cells[(2, 2)] == "2.5" and cells[(2, 4)] == "45352" and (3, 1) not in cells and (3, 2) not in cells
    xml = zipfile.ZipFile(io.BytesIO(book)).read("xl/worksheets/sheet1.xml").decode()
    assert "<f>IF(A2=" in xml and 'xSplit="2"' in xml and "width=\"40.0\"" in xml
    assert [v for _, _, v in xlsx.sheet_cells(book, "Two")] == ["k", "t", "v", "f", "d"]
    assert [sink.column_letters(i) for i in (0, 25, 26, 701, 702)] == ["A", "Z", "AA", "ZZ", "AAA"]


def test_package_and_manifest(spark, tmp_path):
    base = f"file://{tmp_path}"
    for n in (1, 2):
        sink.write_manifest(spark, f"{base}/m.json", {"n": n})
    assert (tmp_path / "m.json").read_text() == '{\n  "n": 2\n}\n' and not (tmp_path / "m.json.tmp").exists()
    with pytest.raises(FileNotFoundError):
        sink.package(spark, base, ["m.json", "missing.txt"], f"{base}/p.zip", "x")
    assert not (tmp_path / "p.zip").exists()
    assert sink.package(spark, base, ["m.json"], f"{base}/p.zip", "x") == 1
    assert zipfile.ZipFile(tmp_path / "p.zip").namelist() == ["x/m.json"]


def test_mask_regions_across_tiles(spark):
    """Tiles of four cells against a flood fill of the whole."""
    rng = np.random.default_rng(6)
    mask = rng.random((23, 31)) < 0.35
    cells = [(int(r), int(c)) for r, c in zip(*np.nonzero(mask), strict=True)]
    got = {(x.row, x.col): x.region for x in raster.label_mask(spark.createDataFrame(cells, "row long, col long"), 4).collect()}
    seen = {}
    for start in cells:
        if start not in seen:
            stack, found = [start], {start}
            while stack:
                r, c = stack.pop()
                for near in ((r + dr, c + dc) for dr in (-1, 0, 1) for dc in (-1, 0, 1)):
                    if near not in found and 0 <= near[0] < 23 and 0 <= near[1] < 31 and mask[near]:
                        found.add(near)
                        stack.append(near)
            seen |= dict.fromkeys(found, min(found))
    assert got == {cell: r * (1 << 32) + c for cell, (r, c) in seen.items()}
