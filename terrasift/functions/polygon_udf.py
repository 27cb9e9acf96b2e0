"""Polygon algorithms that built-in expressions can't say, as Arrow UDFs over numpy."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def _edges(rings) -> np.ndarray:
    """Rows x1, y1, x2, y2 of all edges of all rings."""
    out = []
    for ring in rings:
        pts = np.array([(p["x"], p["y"]) for p in ring], float)
        if len(pts) > 2:
            out.append(np.hstack([pts, np.roll(pts, -1, 0)]))
    return np.vstack(out) if out else np.empty((0, 4))


def _crossings(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Heights at which edges of a cross edges of b."""
    d1, d2 = a[:, None, 2:] - a[:, None, :2], b[None, :, 2:] - b[None, :, :2]
    det = d1[..., 0] * d2[..., 1] - d1[..., 1] * d2[..., 0]
    gap = b[None, :, :2] - a[:, None, :2]
    with np.errstate(divide="ignore", invalid="ignore"):
        t = (gap[..., 0] * d2[..., 1] - gap[..., 1] * d2[..., 0]) / det
        u = (gap[..., 0] * d1[..., 1] - gap[..., 1] * d1[..., 0]) / det
        y = a[:, None, 1] + t * d1[..., 1]
    return y[(det != 0) & (t >= 0) & (t <= 1) & (u >= 0) & (u <= 1)]


def _inside(edges: np.ndarray, y: float) -> np.ndarray:
    """Sorted x at which the height y enters and leaves."""
    cut = edges[(edges[:, 1] > y) != (edges[:, 3] > y)]
    return np.sort(cut[:, 0] + (y - cut[:, 1]) * (cut[:, 2] - cut[:, 0]) / (cut[:, 3] - cut[:, 1]))


def _sweep(polygons: list, common: bool) -> float:
    """Area of the intersection of two polygons or of the union of many. Between neighbouring corner and crossing heights both are
    trapezoids, so the width at mid height times the slab's height is exact; even-odd rule, holes and parts included."""
    edges = [e for e in map(_edges, polygons) if len(e)]
    if len(edges) < (2 if common else 1):
        return 0.0
    heights = [e[:, 1] for e in edges]
    heights += [_crossings(edges[i], edges[j]) for i in range(len(edges)) for j in range(i + 1, len(edges))]
    ys = np.unique(np.concatenate(heights))
    area = 0.0
    for low, high in zip(ys, ys[1:], strict=False):
        spans = [_inside(e, (low + high) / 2) for e in edges]
        marks = sorted((x, d) for s in spans for pair in zip(s[::2], s[1::2], strict=False) for x, d in zip(pair, (1, -1), strict=True))
        depth, width, need = 0, 0.0, len(edges) if common else 1
        for (x, d), (after, _) in zip(marks, marks[1:], strict=False):
            depth += d
            if depth >= need:
                width += after - x
        area += width * (high - low)
    return area


def overlap(a, b) -> float:
    return 0.0 if a is None or b is None else _sweep([a, b], True)


def union_area(polygons) -> float:
    return 0.0 if polygons is None else _sweep(list(polygons), False)


def valid_ring(ring) -> bool:
    """At least three different corners, some area, and no two edges that cross but in a shared corner."""
    pts = [(p["x"], p["y"]) for p in ring] if ring is not None else []
    pts = [p for i, p in enumerate(pts) if i == 0 or p != pts[i - 1]]
    if len(pts) > 1 and pts[0] == pts[-1]:
        pts.pop()
    if len(set(pts)) < 3 or len(set(pts)) != len(pts):
        return False
    n = len(pts)
    if sum(pts[i][0] * pts[(i + 1) % n][1] - pts[(i + 1) % n][0] * pts[i][1] for i in range(n)) == 0:
        return False

    def side(p, q, r):
        return np.sign((q[0] - p[0]) * (r[1] - p[1]) - (q[1] - p[1]) * (r[0] - p[0]))

    for i in range(n):
        for j in range(i + 2, n):
            if (i, j) != (0, n - 1):
                a, b, c, d = pts[i], pts[(i + 1) % n], pts[j], pts[(j + 1) % n]
                if side(a, b, c) * side(a, b, d) < 0 and side(c, d, a) * side(c, d, b) < 0:
                    return False
    return True


def buffered_area(ring, radius: float, segments: int = 16) -> float:
    """Area of a convex ring grown by a radius, round corners of so many segments a quadrant."""
    pts = np.array([(p["x"], p["y"]) for p in ring], float)
    if (pts[0] == pts[-1]).all():
        pts = pts[:-1]
    area = abs(np.dot(pts[:, 0], np.roll(pts[:, 1], -1)) - np.dot(pts[:, 1], np.roll(pts[:, 0], -1))) / 2
    around = np.hypot(*(np.roll(pts, -1, 0) - pts).T).sum()
    n = 4 * segments
    return float(area + around * radius + n / 2 * math.sin(2 * math.pi / n) * radius * radius)


def overlap_area(a: Column, b: Column) -> Column:
    """Area that two polygons share."""

    @F.pandas_udf("double")
    def run(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([overlap(p, q) for p, q in zip(x, y, strict=True)], dtype=float)

    return run(a, b)


def dissolved_area(polygons: Column) -> Column:
    """Area of the union of an array of polygons."""

    @F.pandas_udf("double")
    def run(x: pd.Series) -> pd.Series:
        return pd.Series([union_area(p) for p in x], dtype=float)

    return run(polygons)


def ring_is_valid(ring: Column) -> Column:
    @F.pandas_udf("boolean")
    def run(x: pd.Series) -> pd.Series:
        return pd.Series([bool(valid_ring(r)) for r in x], dtype=bool)

    return run(ring)


def buffer_area(ring: Column, radius: float) -> Column:
    @F.pandas_udf("double")
    def run(x: pd.Series) -> pd.Series:
        return pd.Series([buffered_area(r, radius) for r in x], dtype=float)

    return run(ring)
