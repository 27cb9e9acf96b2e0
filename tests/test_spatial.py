"""Joins by distance: crowded cells are dealt out, and what is found is what all pairs give."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from terrasift.functions import geo as G
from terrasift.operators import spatial

XY = "struct<x: double, y: double>"


def _boxes(spark, rows):
    return spark.createDataFrame([(i, tuple(map(float, (x, y, x + w, y + h)))) for i, x, y, w, h in rows], "id long, box struct<xmin: double, ymin: double, xmax: double, ymax: double>")


@pytest.mark.parametrize("block", [3, 2_000])
def test_crowded_keys_meet_in_many_tasks(spark, monkeypatch, block):
    monkeypatch.setattr(spatial, "BLOCK", block)
    left = spark.range(40).select(F.col("id").alias("i"), (F.col("id") % 2).alias("g"))
    right = spark.range(30).select(F.col("id").alias("j"), (F.col("id") % 2).alias("h"))
    rows = spatial.dealt_join(left, right, [("g", "h")], F.col("i") < F.col("j")).withColumn("p", F.spark_partition_id()).collect()
    assert sorted((r.i, r.j) for r in rows) == sorted((i, j) for i in range(40) for j in range(30) if i % 2 == j % 2 and i < j)
    if block == 3:
        assert len({r.p for r in rows}) >= 4  # a key is no longer one task's


def test_small_boxes_meet_large_ones_only(spark):
    rnd = random.Random(3)
    big = [(i, rnd.randint(0, 90), rnd.randint(0, 90), rnd.randint(1, 20), rnd.randint(1, 20)) for i in range(40)]
    small = [(i, rnd.randint(0, 90), rnd.randint(0, 90), 2, 1) for i in range(40)]
    close = G.box_within_tolerance(F.col("b.box"), F.col("a.box"), 5.0)
    got = {(r.a.id, r.b.id) for r in spatial.box_meetings(_boxes(spark, big), _boxes(spark, small), 16.0, 10.0, close).collect()}
    out = lambda px, py, b: math.hypot(max(0, b[1] - px, px - b[1] - b[3]), max(0, b[2] - py, py - b[2] - b[4]))
    want = {(b[0], s[0]) for b in big for s in small if all(out(px, py, b) <= 5 for px in (s[1], s[1] + 2) for py in (s[2], s[2] + 1))}
    assert got == want and want


def test_k_nearest_looks_at_few_points(spark, monkeypatch):
    """400 right points within the first radius, half of them twice: rings begin where cells hold few."""
    rnd = random.Random(4)
    left = [(i, (rnd.uniform(0, 50), rnd.uniform(0, 50))) for i in range(60)] + [(60, (5_000.0, 0.0)), (61, None)]
    right = [(j, (rnd.uniform(0, 50), rnd.uniform(0, 50))) for j in range(200)]
    right += [(200 + j, p) for j, p in right]
    looked = []
    join = spatial.distance_join
    monkeypatch.setattr(spatial, "distance_join", lambda a, b, r, *more, **how: looked.append((r, (hits := join(a, b, r, *more, **how)).count())) or hits)
    a, b = spark.createDataFrame(left, f"i long, point {XY}"), spark.createDataFrame(right, f"j long, other_point {XY}")
    got = {(r.i, r.j, r["rank"]) for r in spatial.k_nearest(a, b, "i", "j", 3, 500.0, 2_000.0).collect()}
    want = set()
    for i, p in left[:60]:
        near = sorted((math.dist(p, q), j) for j, q in right)[:3]
        want |= {(i, j, n + 1) for n, (_, j) in enumerate(near)}
    assert got == want
    assert sum(n for _, n in looked) < 60 * 200 / 2
    assert spatial.k_nearest(a, b.limit(0), "i", "j", 3, 500.0, 2_000.0).count() == 0


def test_units_meet_items_by_cells_of_their_radius(spark):
    rnd = random.Random(5)
    units = [(i, i % 2, rnd.choice([0.0, 3.0, 8.0, 150.0]), (rnd.uniform(-99, 99), rnd.uniform(-99, 99))) for i in range(50)]
    items = [(j, j % 2, (rnd.uniform(-99, 99), rnd.uniform(-99, 99))) for j in range(80)] + [(80 + i, z, p) for i, z, _, p in units[:5]]
    found = spatial.within_unit_radius(spark.createDataFrame(units, f"i long, zone long, radius double, point {XY}"), spark.createDataFrame(items, f"j long, zone long, other_point {XY}"), "zone", "radius")
    assert {(r.i, r.j) for r in found.collect()} == {(i, j) for i, z, r, p in units for j, y, q in items if z == y and math.dist(p, q) <= r}
    assert "zone" in found.columns


def test_widened_groups_are_those_of_all_links(spark):
    """Links up to the last radius join what all of them join, and the second round sees no pair of one group."""
    from terrasift.operators import graph

    rnd = random.Random(6)
    left = [(f"l{i}", (rnd.uniform(0, 100), rnd.uniform(0, 100))) for i in range(40)]
    right = [(f"r{i}", (rnd.uniform(0, 100), rnd.uniform(0, 100))) for i in range(40)]
    a, b = spark.createDataFrame(left, f"u string, point {XY}"), spark.createDataFrame(right, f"v string, other_point {XY}")
    nodes = a.select("u").union(b.select("v")).withColumnRenamed("u", "node")
    made = []

    def links(x, y, radius, how):
        found = spatial.distance_join(x, y, radius, how=how).select(F.col("u").alias("a"), F.col("v").alias("b"))
        made.append(found.count())
        return found

    got = {r.node: r.component for r in graph.widened(nodes, a, b, "u", "v", [8.0, 16.0], links).collect()}
    every = spatial.distance_join(a, b, 16.0).select(F.col("u").alias("a"), F.col("v").alias("b"))
    assert got == {r.node: r.component for r in graph.components(nodes, every).collect()}
    assert sum(made) < every.count()


def test_near_components_make_no_pairs_of_dense_points(spark, monkeypatch):
    """The groups of all pairs within the radius, of dense heaps as of chains, of rows of points across a gap of just the radius or just more, and of points without a place."""
    rng = np.random.default_rng(17)
    at = [*rng.normal((0, 0), 4, (400, 2)), *rng.uniform(-60, 60, (120, 2)), *[(200.0 + i, 0.0) for i in range(20)], *[(200.0 + i, 10.0) for i in range(5, 9)], *[(200.0 + i, -10.001) for i in range(20)]]
    rows = [(i, (float(x), float(y))) for i, (x, y) in enumerate(at)] + [(10_000, None)]
    df = spark.createDataFrame(rows, "k long, p struct<x:double,y:double>")
    xy = np.array(at, float)
    near = np.sqrt(((xy[:, None] - xy[None]) ** 2).sum(2)) <= 10
    label = np.arange(len(xy))
    while (new := np.where(near, label[None], len(xy)).min(1)).tolist() != label.tolist():
        label = new
    joined = []
    dealt = spatial.dealt_join
    monkeypatch.setattr(spatial, "dealt_join", lambda left, right, *rest: joined.append(left.count()) or dealt(left, right, *rest))
    got = {r.node: r.component for r in spatial.near_components(df, "k", "p", 10.0).collect()}
    assert got == dict(enumerate(label.tolist())) | {10_000: 10_000}
    assert sum(joined) < 200
