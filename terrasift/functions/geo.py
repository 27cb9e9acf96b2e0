"""Projections and plane geometry as Column expressions.

A ring is an array of struct(x, y), closed or not; a polygon an array of rings, the first its shell."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# GRS80 ellipsoid, and the parallels and origin of the conterminous equal-area projection.
SEMI_MAJOR = 6378137.0
FLATTENING = 1 / 298.257222101
PARALLELS = (29.5, 45.5)
ORIGIN = (23.0, -96.0)

_E2 = FLATTENING * (2 - FLATTENING)
_E = math.sqrt(_E2)


def _q(sin: float) -> float:
    return (1 - _E2) * (sin / (1 - _E2 * sin * sin) - math.log((1 - _E * sin) / (1 + _E * sin)) / (2 * _E))


def _m2(sin: float) -> float:
    return (1 - sin * sin) / (1 - _E2 * sin * sin)


_S1, _S2 = (math.sin(math.radians(p)) for p in PARALLELS)
ALBERS_N = (_m2(_S1) - _m2(_S2)) / (_q(_S2) - _q(_S1))
ALBERS_C = _m2(_S1) + ALBERS_N * _q(_S1)
ALBERS_RHO0 = SEMI_MAJOR * math.sqrt(ALBERS_C - ALBERS_N * _q(math.sin(math.radians(ORIGIN[0])))) / ALBERS_N
ECCENTRICITY, ECCENTRICITY2 = _E, _E2


def albers(lon: Column, lat: Column) -> Column:
    """struct(x, y) in metres of the equal-area projection."""
    sin = F.sin(F.radians(lat))
    q = (sin / (1 - sin * sin * _E2) - F.ln((1 - sin * _E) / (1 + sin * _E)) / (2 * _E)) * (1 - _E2)
    rho = F.sqrt(F.lit(ALBERS_C) - q * ALBERS_N) * (SEMI_MAJOR / ALBERS_N)
    theta = F.radians(lon - ORIGIN[1]) * ALBERS_N
    return F.struct((rho * F.sin(theta)).alias("x"), (F.lit(ALBERS_RHO0) - rho * F.cos(theta)).alias("y"))


_N3 = FLATTENING / (2 - FLATTENING)
UTM_A = SEMI_MAJOR / (1 + _N3) * (1 + _N3**2 / 4 + _N3**4 / 64)
UTM_ALPHA = (_N3 / 2 - 2 * _N3**2 / 3 + 5 * _N3**3 / 16 + 41 * _N3**4 / 180, 13 * _N3**2 / 48 - 3 * _N3**3 / 5 + 557 * _N3**4 / 1440, 61 * _N3**3 / 240 - 103 * _N3**4 / 140, 49561 * _N3**4 / 161280)
UTM_BETA = (_N3 / 2 - 2 * _N3**2 / 3 + 37 * _N3**3 / 96 - _N3**4 / 360, _N3**2 / 48 + _N3**3 / 15 - 437 * _N3**4 / 1440, 17 * _N3**3 / 480 - 37 * _N3**4 / 840, 4397 * _N3**4 / 161280)
UTM_DELTA = (2 * _N3 - 2 * _N3**2 / 3 - 2 * _N3**3 + 116 * _N3**4 / 45, 7 * _N3**2 / 3 - 8 * _N3**3 / 5 - 227 * _N3**4 / 45, 56 * _N3**3 / 15 - 136 * _N3**4 / 35, 4279 * _N3**4 / 630)
UTM_SCALE, UTM_EASTING = 0.9996, 500000.0


def _sinh(x: Column) -> Column:
    return (F.exp(x) - F.exp(-x)) / 2


def _cosh(x: Column) -> Column:
    return (F.exp(x) + F.exp(-x)) / 2


def _atanh(x: Column) -> Column:
    return F.ln((1 + x) / (1 - x)) / 2


def utm(lon: Column, lat: Column, zone: int = 16) -> Column:
    """struct(x, y) in metres of a northern transverse Mercator zone (Krueger series of order 4)."""
    c = 2 * math.sqrt(_N3) / (1 + _N3)
    sin = F.sin(F.radians(lat))
    t = _sinh(_atanh(sin) - _atanh(sin * c) * c)
    dl = F.radians(lon - (6 * zone - 183))
    xi, eta = F.atan2(t, F.cos(dl)), _atanh(F.sin(dl) / F.sqrt(1 + t * t))
    x, y = eta, xi
    for j, a in enumerate(UTM_ALPHA, 1):
        x = x + F.cos(xi * (2 * j)) * _sinh(eta * (2 * j)) * a
        y = y + F.sin(xi * (2 * j)) * _cosh(eta * (2 * j)) * a
    return F.struct((x * (UTM_SCALE * UTM_A) + UTM_EASTING).alias("x"), (y * (UTM_SCALE * UTM_A)).alias("y"))


def inverse_utm(x: Column, y: Column, zone: int = 16) -> Column:
    """struct(lon, lat) of metres in a northern zone."""
    xi, eta = y / (UTM_SCALE * UTM_A), (x - UTM_EASTING) / (UTM_SCALE * UTM_A)
    u, v = xi, eta
    for j, b in enumerate(UTM_BETA, 1):
        u = u - F.sin(xi * (2 * j)) * _cosh(eta * (2 * j)) * b
        v = v - F.cos(xi * (2 * j)) * _sinh(eta * (2 * j)) * b
    chi = F.asin(F.sin(u) / _cosh(v))
    lat = chi
    for j, d in enumerate(UTM_DELTA, 1):
        lat = lat + F.sin(chi * (2 * j)) * d
    return F.struct((F.degrees(F.atan2(_sinh(v), F.cos(u))) + (6 * zone - 183)).alias("lon"), F.degrees(lat).alias("lat"))


def coordinate_valid(lat: Column, lon: Column) -> Column:
    """Both numbers, in the range that sites of the continent have."""
    return F.coalesce(lat.try_cast("double").between(18, 72) & lon.try_cast("double").between(-180, -60), F.lit(False))


def distance(a: Column, b: Column) -> Column:
    dx, dy = a["x"] - b["x"], a["y"] - b["y"]
    return F.sqrt(dx * dx + dy * dy)


def box_ring(xmin: Column, ymin: Column, xmax: Column, ymax: Column) -> Column:
    corner = lambda x, y: F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))
    return F.array(corner(xmin, ymin), corner(xmax, ymin), corner(xmax, ymax), corner(xmin, ymax), corner(xmin, ymin))


def _edges(ring: Column) -> Column:
    """struct(a, b) of consecutive corners, the last with the first."""
    # not by F.get(ring, i + 1), which works the ring out again for each of its corners
    after = F.concat(F.slice(ring, 2, F.greatest(F.size(ring), F.lit(0))), F.slice(ring, 1, 1))
    return F.zip_with(ring, after, lambda p, q: F.struct(p.alias("a"), q.alias("b")))


def _cross(e: Column) -> Column:
    return e["a"]["x"] * e["b"]["y"] - e["b"]["x"] * e["a"]["y"]


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, x: s + x)


def ring_area(ring: Column) -> Column:
    """Shoelace area, not signed."""
    return F.abs(_sum(F.transform(_edges(ring), _cross))) / 2


def polygon_area(rings: Column) -> Column:
    return ring_area(rings[0]) - _sum(F.transform(F.slice(rings, 2, F.greatest(F.size(rings) - 1, F.lit(0))), ring_area))


def ring_centroid(ring: Column) -> Column:
    edges = _edges(ring)
    twice = _sum(F.transform(edges, _cross))
    x = _sum(F.transform(edges, lambda e: (e["a"]["x"] + e["b"]["x"]) * _cross(e)))
    y = _sum(F.transform(edges, lambda e: (e["a"]["y"] + e["b"]["y"]) * _cross(e)))
    return F.struct((x / (twice * 3)).alias("x"), (y / (twice * 3)).alias("y"))


def bounds(ring: Column) -> Column:
    xs, ys = F.transform(ring, lambda p: p["x"]), F.transform(ring, lambda p: p["y"])
    return F.struct(F.array_min(xs).alias("xmin"), F.array_min(ys).alias("ymin"), F.array_max(xs).alias("xmax"), F.array_max(ys).alias("ymax"))


def point_in_ring(p: Column, ring: Column) -> Column:
    """Even-odd rule by ray casting."""
    crosses = lambda e: ((e["a"]["y"] > p["y"]) != (e["b"]["y"] > p["y"])) & (p["x"] < (e["b"]["x"] - e["a"]["x"]) * (p["y"] - e["a"]["y"]) / F.nullif(e["b"]["y"] - e["a"]["y"], F.lit(0.0)) + e["a"]["x"])
    return F.pmod(F.size(F.filter(_edges(ring), crosses)), F.lit(2)) == 1


def point_segment_distance(p: Column, e: Column) -> Column:
    dx, dy = e["b"]["x"] - e["a"]["x"], e["b"]["y"] - e["a"]["y"]
    along = ((p["x"] - e["a"]["x"]) * dx + (p["y"] - e["a"]["y"]) * dy) / F.nullif(dx * dx + dy * dy, F.lit(0.0))
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(along, F.lit(0.0))))
    fx, fy = p["x"] - (e["a"]["x"] + dx * t), p["y"] - (e["a"]["y"] + dy * t)
    return F.sqrt(fx * fx + fy * fy)


def distance_to_ring(p: Column, ring: Column) -> Column:
    """0 inside, else to the nearest edge."""
    return F.when(point_in_ring(p, ring), F.lit(0.0)).otherwise(F.array_min(F.transform(_edges(ring), lambda e: point_segment_distance(p, e))))


def within_tolerance(inner: Column, outer: Column, tolerance: float) -> Column:
    """Every corner of inner in outer or nearer than the tolerance."""
    return F.forall(inner, lambda p: distance_to_ring(p, outer) <= tolerance)


def box_overlap(a: Column, b: Column) -> Column:
    """Area that two bounds share."""
    w = F.least(a["xmax"], b["xmax"]) - F.greatest(a["xmin"], b["xmin"])
    h = F.least(a["ymax"], b["ymax"]) - F.greatest(a["ymin"], b["ymin"])
    return F.greatest(w, F.lit(0.0)) * F.greatest(h, F.lit(0.0))


def box_distance(a: Column, b: Column) -> Column:
    dx = F.greatest(F.lit(0.0), a["xmin"] - b["xmax"], b["xmin"] - a["xmax"])
    dy = F.greatest(F.lit(0.0), a["ymin"] - b["ymax"], b["ymin"] - a["ymax"])
    return F.sqrt(dx * dx + dy * dy)


def box_within_tolerance(inner: Column, outer: Column, tolerance: float) -> Column:
    """within_tolerance() of bounds: the corner of inner that is farthest out in both directions decides."""
    dx = F.greatest(F.lit(0.0), outer["xmin"] - inner["xmin"], inner["xmax"] - outer["xmax"])
    dy = F.greatest(F.lit(0.0), outer["ymin"] - inner["ymin"], inner["ymax"] - outer["ymax"])
    return F.sqrt(dx * dx + dy * dy) <= tolerance


def rotated_rectangle(cx: Column, cy: Column, width: Column, height: Column, degrees: Column) -> Column:
    s, c = F.sin(F.radians(degrees)), F.cos(F.radians(degrees))
    corner = lambda u, v: F.struct((cx + width / 2 * u * c - height / 2 * v * s).alias("x"), (cy + width / 2 * u * s + height / 2 * v * c).alias("y"))
    return F.array(corner(-1, -1), corner(1, -1), corner(1, 1), corner(-1, 1))


def review_half(span: Column) -> Column:
    """Half side of a square review window around a span in metres."""
    return F.least(F.greatest(F.greatest(span, F.lit(450.0)) * 0.68, F.lit(300.0)), F.lit(1400.0))


def bbox_text(*values: Column) -> Column:
    return F.format_string(",".join(["%.7f"] * len(values)), *[v.cast("double") for v in values])


def bbox_values(text: Column) -> Column:
    return F.transform(F.split(text, ","), lambda v: v.cast("double"))
