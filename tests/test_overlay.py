"""Unions, buffers and rings against sweeps, distance tests on a lattice and counts of cells."""

import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from terrasift.functions import polygon_udf as P
from terrasift.operators import overlay

XY = "struct<x:double,y:double>"
SCHEMA = f"g long, p long, rings array<array<{XY}>>"


def ring(*pts):
    return [(float(x), float(y)) for x, y in pts]


def box(x, y, w, h):
    return ring((x, y), (x + w, y), (x + w, y + h), (x, y + h), (x, y))


def parts_of(df):
    return {(r.g, round(r.area, 4)): [[(p.x, p.y) for p in x] for x in r.rings] for r in df.collect()}


def areas(df):
    out = Counter()
    for r in df.collect():
        out[r.g] += r.area
    return out


def inside(rings, x, y):
    odd = False
    for pts in rings:
        for (ax, ay), (bx, by) in zip(pts, pts[1:] + pts[:1], strict=True):
            if (ay > y) != (by > y) and x < ax + (y - ay) * (bx - ax) / (by - ay):
                odd = not odd
    return odd


@pytest.mark.parametrize("size", [1000.0, 7.0, 3.0])
def test_union_of_random_polygons(spark, size):
    rng = random.Random(4)
    rows = []
    for g in range(6):
        for p in range(9):
            cx, cy, n = rng.uniform(0, 20), rng.uniform(0, 20), rng.randint(3, 8)
            turns = [2 * math.pi * (i + rng.uniform(0.1, 0.9)) / n for i in range(n)]
            pts = ring(*[(cx + (k := rng.uniform(1, 5)) * math.cos(t), cy + k * math.sin(t)) for t in turns])
            rows.append((g, p, [pts[::-1] if p % 2 else pts]))
    got = overlay.dissolve(spark.createDataFrame(rows, SCHEMA), "g", "p", "rings", size)
    found = areas(got)
    for g in range(6):
        expected = P.union_area([[[{"x": x, "y": y} for x, y in r] for r in rings] for k, _, rings in rows if k == g])
        assert found[g] == pytest.approx(expected, abs=1e-3)
    rings = [[[(p.x, p.y) for p in x] for x in r.rings] for r in got.where("g = 0").collect()]
    for _ in range(400):
        x, y = rng.uniform(-5, 25), rng.uniform(-5, 25)
        assert any(inside(r, x, y) for r in rings) == any(inside(r, x, y) for k, _, r in rows if k == 0)


@pytest.mark.parametrize("size", [50.0, 2.5])
def test_union_of_boxes_that_share_sides(spark, size):
    """Shared and overlapping sides, equal boxes, a hole, an island in it, corners that touch."""
    rows = [(1, i, [b]) for i, b in enumerate([box(0, 0, 4, 1), box(0, 3, 4, 1), box(0, 0, 1, 4), box(3, 0, 1, 4), box(0, 0, 1, 4), box(1.5, 1.5, 1, 1), box(4, 4, 2, 2), box(6, 5, 2, 1), box(6, 4, 2, 1)])]
    rows += [(2, 0, [box(0, 0, 10, 10), box(2, 2, 3, 3)]), (2, 1, [box(3, 3, 1, 1)]), (2, 2, [box(20, 20, 1, 1)]), (None, 0, [box(0, 0, 1, 1)])]
    got = parts_of(overlay.dissolve(spark.createDataFrame(rows, SCHEMA), "g", "p", "rings", size))
    assert set(got) == {(1, 1.0), (1, 8.0), (1, 12.0), (2, 1.0), (2, 91.0), (None, 1.0)}
    assert [len(r) for r in got[1, 12.0]] == [4, 4] and [len(r) for r in got[1, 8.0]] == [4] and len(got[2, 91.0]) == 2
    assert got[1, 8.0][0] == [(4.0, 4.0), (8.0, 4.0), (8.0, 6.0), (4.0, 6.0)]


def test_one_union_of_a_whole_table(spark):
    """A ring of boxes through many cells is one part with one hole."""
    pts = [(200 * math.cos(2 * math.pi * i / 300), 200 * math.sin(2 * math.pi * i / 300)) for i in range(300)]
    rows = [(0, i, [box(x, y, 6, 6)]) for i, (x, y) in enumerate(pts)]
    got = overlay.dissolve(spark.createDataFrame(rows, SCHEMA), "g", "p", "rings", 25.0).collect()
    assert len(got) == 1 and len(got[0].rings) == 2
    expected = P.union_area([[[{"x": x, "y": y} for x, y in r] for r in rings] for _, _, rings in rows])
    assert got[0].area == pytest.approx(expected, rel=1e-6)


def distance(pts, x, y):
    best = math.inf
    for (ax, ay), (bx, by) in zip(pts, pts[1:] + pts[:1], strict=True):
        dx, dy = bx - ax, by - ay
        t = max(0, min(1, ((x - ax) * dx + (y - ay) * dy) / (dx * dx + dy * dy or 1)))
        best = min(best, math.hypot(x - ax - t * dx, y - ay - t * dy))
    return best


SHAPES = {
    1: [ring((0, 0), (10, 0), (10, 10), (5, 2), (0, 10))],  # concave
    2: [ring((0, 0), (0, 12), (12, 12), (12, 0)), ring((3, 3), (9, 3), (9, 9), (3, 9))],  # a hole that stays, clockwise
    3: [box(0, 0, 12, 12), box(5, 5, 2, 2)],  # a hole that closes
    4: [ring((0, 0), (20, 0), (20, 3), (3, 3), (3, 17), (17, 17), (17, 6), (20, 6), (20, 20), (0, 20))],  # a gap that closes and leaves a hole
    5: [ring((0, 0), (30, 0.5), (0, 1))],  # a spike
}


@pytest.mark.parametrize("size", [500.0, 6.0])
def test_buffers_by_distance(spark, size):
    df = spark.createDataFrame([(k, 0, v) for k, v in SHAPES.items()], SCHEMA)
    got = {r.g: r for r in overlay.buffered(df, "g", "rings", 2.0, size).collect()}
    assert {k: len(r.rings) for k, r in got.items()} == {1: 1, 2: 2, 3: 1, 4: 2, 5: 1}
    rng = random.Random(1)
    for k, rings in SHAPES.items():
        own = [[(p.x, p.y) for p in x] for x in got[k].rings]
        for _ in range(500):
            x, y = rng.uniform(-4, 34), rng.uniform(-4, 24)
            away = 0 if inside(rings, x, y) else min(distance(r, x, y) for r in rings)
            if abs(away - 2) > 0.01:  # the corners' arcs are polygons
                assert inside(own, x, y) == (away < 2)


def test_buffer_area_of_a_box(spark):
    df = spark.createDataFrame([(1, 0, [box(100_000, 200_000, 30, 10)])], SCHEMA)
    area = overlay.buffered(df, "g", "rings", 120.0, 90.0).first().area
    assert area == pytest.approx(300 + 80 * 120 + 32 * math.sin(math.pi / 32) * 14400, abs=0.01)


def test_point_buffers(spark):
    p = F.struct(F.lit(5.0).alias("x"), F.lit(-2.0).alias("y"))
    from terrasift.functions import geo as G

    r = spark.range(1).select(G.ring_area(overlay.point_buffer(p, 3.0)).alias("round"), G.ring_area(overlay.point_buffer(p, 3.0, square=True)).alias("square")).first()
    assert r.square == 36 and r.round == pytest.approx(32 * math.sin(math.pi / 32) * 9)


def test_odd_polygons(spark):
    """Nulls, empty and degenerate rings take part in nothing."""
    rows = [(1, 0, None), (1, 1, []), (1, 2, [[]]), (1, 3, [ring((0, 0), (1, 1))]), (1, 4, [ring((2, 2), (2, 2), (2, 2))]), (1, 5, [ring((0, 0), (5, 0), (9, 0))])]
    df = spark.createDataFrame(rows, SCHEMA)
    assert overlay.dissolve(df, "g", "p", "rings", 10.0).count() == 0
    assert overlay.dissolve(spark.createDataFrame([], SCHEMA), "g", "p", "rings", 10.0).count() == 0
    got = overlay.dissolve(spark.createDataFrame([*rows, (1, 6, [box(0, 0, 2, 2)])], SCHEMA), "g", "p", "rings", 10.0).collect()
    assert [r.area for r in got] == [4.0]


def test_spans(spark):
    rows = [(1, 0, [box(0.5, 0.5, 8, 8), box(2.5, 2.5, 3, 3)])]
    edges = overlay.polygon_edges(spark.createDataFrame(rows, SCHEMA), "g", "p", "rings")
    got = {(r.row, r.x_from, r.x_to) for r in overlay.scan_spans(edges, 1.0, 0.0, "g").collect()}
    assert got == {(y, 0.5, 8.5) for y in (1, 2, 6, 7, 8)} | {(y, a, b) for y in (3, 4, 5) for a, b in ((0.5, 2.5), (5.5, 8.5))}


def test_tidy():
    x, y = overlay._tidy(np.array([2, 1, 0, 0, 0, 1, 2, 2]), np.array([2, 2, 2, 1, 0, 0, 0, 1]), 0.0)
    assert list(zip(x.tolist(), y.tolist(), strict=True)) == [(0, 0), (2, 0), (2, 2), (0, 2)]


def test_crowded_cells_are_quartered(spark, monkeypatch):
    """Polygons that lie over one another by the hundred cost what is near their outline, and come out as if each cell were worked on whole."""
    rng = np.random.default_rng(11)
    corner = rng.integers(0, 60, (400, 2)).astype(float)
    size = rng.integers(3, 25, (400, 2)).astype(float)
    boxes = [(i, *map(float, (x, y, x + w, y + h))) for i, ((x, y), (w, h)) in enumerate(zip(corner, size, strict=True))]
    turned = [(i, [[{"x": x0, "y": (y0 + y1) / 2}, {"x": (x0 + x1) / 2, "y": y0}, {"x": x1, "y": (y0 + y1) / 2}, {"x": (x0 + x1) / 2, "y": y1}]]) for i, x0, y0, x1, y1 in boxes]
    upright = [(i, [[{"x": x0, "y": y0}, {"x": x1, "y": y0}, {"x": x1, "y": y1}, {"x": x0, "y": y1}]]) for i, x0, y0, x1, y1 in boxes]
    looked = []
    arranged = overlay._arranged
    monkeypatch.setattr(overlay, "_arranged", lambda p, e, *rest: looked.append(len(e)) or arranged(p, e, *rest))
    for shapes in (turned, upright):
        edges = np.array([(*a.values(), *b.values()) for _, (ring,) in shapes for a, b in zip(ring, ring[1:] + ring[:1], strict=True)])
        p = np.repeat(np.arange(len(shapes)), 4)
        box = (-1.31, -1.27, 98.71, 98.73)
        monkeypatch.setattr(overlay, "CROWDED", 10**9)
        whole = np.vstack(list(overlay._quarters(p, edges, np.empty(0, int), *box)))
        looked.clear()
        monkeypatch.setattr(overlay, "CROWDED", 40)
        parts = np.vstack(list(overlay._quarters(p, edges, np.empty(0, int), *box)))
        area = lambda e: float((e[:, 0] * 1e-6 * e[:, 3] * 1e-6 - e[:, 2] * 1e-6 * e[:, 1] * 1e-6).sum() / 2)
        length = lambda e: float(np.hypot(e[:, 2] - e[:, 0], e[:, 3] - e[:, 1]).sum() * 1e-6)
        assert area(parts) == pytest.approx(area(whole), abs=1e-3) and length(parts) == pytest.approx(length(whole), abs=1e-3)
        assert sum(n * n for n in looked) < len(edges) ** 2 / 2


def test_equal_polygons_are_grown_once(spark, monkeypatch):
    """A thousand polygons of two shapes are worked on as two, and each gets its own row; null and empty ones get none."""
    shape = lambda w: [[{"x": 0.0, "y": 0.0}, {"x": w, "y": 0.0}, {"x": w, "y": 3.0}, {"x": 0.0, "y": 3.0}]]
    rows = [(k, shape(5.0 + k % 2)) for k in range(1000)] + [(2000, None), (2001, [])]
    df = spark.createDataFrame(rows, "k long, rings array<array<struct<x:double,y:double>>>")
    worked = []
    union = overlay.union_edges
    monkeypatch.setattr(overlay, "union_edges", lambda edges, size: worked.append(edges.select("g").distinct().count()) or union(edges, size))
    got = overlay.buffered(df, "k", "rings", 1.0, 50.0).select("g", F.round("area", 4).alias("area")).collect()
    round_part = 32 * math.sin(math.pi / 32)
    assert worked == [2] and sorted(r.g for r in got) == list(range(1000))
    assert all(abs(r.area - ((5 + r.g % 2) * 3 + 2 * (5 + r.g % 2 + 3) + round_part)) < 1e-3 for r in got)
