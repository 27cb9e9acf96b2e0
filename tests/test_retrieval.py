"""Ranks, correlations and searches against pandas and numpy."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from terrasift.operators import vectors as V
from terrasift.operators.order import running_total


def test_running_total_of_hot_and_negative_amounts(spark):
    rng = np.random.default_rng(2)
    rows = [(int(k), int(n), i) for i, (k, n) in enumerate(zip(rng.integers(0, 50, 4000), rng.integers(-5, 9, 4000), strict=True))]
    got = {r.i: r.before for r in running_total(spark.createDataFrame(rows, "k long, n long, i long"), "before", "n", "k", "i").collect()}
    total = 0
    for _, n, i in sorted(rows, key=lambda r: (r[0], r[2])):
        assert got[i] == total
        total += n
    assert running_total(spark.createDataFrame([], "k long, n long"), "before", "n", "k").count() == 0


def test_spearman_with_ties(spark):
    rng = np.random.default_rng(5)
    x = np.concatenate([rng.integers(0, 6, 600), np.full(900, 3)])  # a value that most rows share
    df = pd.DataFrame({"g": np.where(np.arange(1500) % 3 == 0, "a", "b"), "x": x, "y": x * 2 + rng.integers(0, 9, 1500)})
    rows = [*df.itertuples(index=False, name=None), (None, 1, 2), (None, 2, 1), ("c", 5, 5), ("c", 5, 6), ("a", None, 3), ("a", 3, None), ("d", None, None)]
    got = {r.g: (r.n, r.rho) for r in V.spearman(spark.createDataFrame(rows, "g string, x long, y long"), ["g"], "x", "y").collect()}
    for g, own in df.groupby("g"):
        assert got[g][0] == len(own) and got[g][1] == pytest.approx(own.x.rank().corr(own.y.rank()), abs=1e-12)
    assert got[None] == (2, pytest.approx(-1)) and got["c"] == (2, None) and "d" not in got


def clusters(n=240, dim=8, labels=4, seed=1):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(labels, dim))
    label = np.arange(n) % labels
    return label, centres[label] + 0.9 * rng.normal(size=(n, dim))


def cos(a, b):
    return a @ b / np.linalg.norm(a, axis=-1) / np.linalg.norm(b)


def test_feedback_takes_false_hits_off(spark):
    label, x = clusters()
    seeds, pool = np.flatnonzero(np.arange(len(x)) % 5 == 0), np.flatnonzero(np.arange(len(x)) % 5)
    frame = lambda at: spark.createDataFrame([(int(i), int(label[i]), x[i].tolist()) for i in at], "k long, label int, v array<double>")
    first, second = V.feedback_search(frame(pool), frame(seeds), "label", "k", "v", 12)
    for q in range(4):
        p = x[seeds][label[seeds] == q].mean(0)
        one = pool[np.lexsort((pool, -cos(x[pool], p)))][:12]
        assert [r.k for r in first.where(f"query = {q}").orderBy("rank").collect()] == one.tolist()
        wrong = one[label[one] != q]
        s = cos(x[pool], p) if not len(wrong) else 2 * cos(x[pool], p) - cos(x[pool], x[wrong].mean(0))
        assert [r.k for r in second.where(f"query = {q}").orderBy("rank").collect()] == pool[np.lexsort((pool, -s))][:12].tolist()


def test_feedback_without_false_hits(spark):
    rows = [(i, i % 2, [1.0, 0.01 * i] if i % 2 else [0.01 * i, 1.0]) for i in range(20)]
    df = spark.createDataFrame(rows, "k long, label int, v array<double>")
    first, second = V.feedback_search(df.where("k > 3"), df.where("k <= 3"), "label", "k", "v", 3)
    assert sorted(map(tuple, first.collect())) == sorted(map(tuple, second.collect())) and first.count() == 6


def test_ensemble_takes_the_best_rank(spark):
    label, x = clusters(seed=3)
    pool = spark.createDataFrame([(i, int(label[i]), v.tolist()) for i, v in enumerate(x)], "k long, label int, v array<double>")
    prompts = spark.createDataFrame([(q, p, x[q + 4 * p].tolist()) for q in range(2) for p in range(3)], "query int, prompt int, prototype array<double>")
    got = V.fused_search(pool, prompts, "query", "prompt", "k", "v", 10, "label").collect()
    for q in range(2):
        ranks = [np.lexsort((np.arange(len(x)), -cos(x, x[q + 4 * p]))).argsort() for p in range(3)]
        best = np.min(ranks, 0)
        assert [r.k for r in sorted((r for r in got if r.query == q), key=lambda r: r.rank)] == np.lexsort((np.arange(len(x)), best))[:10].tolist()


def test_places_are_found_by_other_tiles(spark):
    label, x = clusters(n=120, seed=7)
    rng = np.random.default_rng(0)
    at = rng.uniform(0, 100, (120, 2))
    tiles = spark.createDataFrame([(i, int(label[i]), (float(at[i, 0]), float(at[i, 1])), x[i].tolist()) for i in range(120)], "k long, label int, point struct<x:double,y:double>, v array<double>")
    spots = [(j, j % 4, (float(rng.uniform(0, 100)), float(rng.uniform(0, 100)))) for j in range(12)] + [(99, 1, (1e6, 1e6)), (98, 7, (50.0, 50.0))]
    places = spark.createDataFrame(spots, "place long, label int, other_point struct<x:double,y:double>")
    got = {r.place: (r.removed, r.first_hit) for r in V.held_out_places(tiles, places, "label", "k", "place", "v", 15.0).collect()}
    expected = {}
    for place, q, (px, py) in spots:
        near = np.flatnonzero((label == q) & (np.hypot(at[:, 0] - px, at[:, 1] - py) <= 15))
        if len(near):
            rest = np.setdiff1d(np.flatnonzero(label == q), near)
            order = np.lexsort((np.arange(120), -cos(x, x[rest].mean(0)))).tolist()
            expected[place] = (len(near), 1 + min(order.index(i) for i in near))
    assert got == expected and len(got) >= 8


def test_many_places_meet_tiles_in_blocks(spark, monkeypatch):
    """Places are not broadcast one pass over the tiles a thousand; equal scores go by key, in whatever blocks they are; vectors without a cosine to a place count for nothing."""
    monkeypatch.setattr(V, "BLOCK_ROWS", 40)
    rng = np.random.default_rng(7)
    x = rng.integers(-2, 3, (150, 4)).astype(float) + 0.5
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(500, None), (501, [1.0]), (502, [None, 1.0, 1.0, 1.0])]
    q = x[rng.integers(0, 150, 130)]
    cos = np.array([V._cosines(x, np.tile(one, (150, 1))) for one in q])
    best = rng.integers(0, 150, 130)
    asked = spark.createDataFrame([(i, one.tolist(), (float(cos[i, best[i]]), -int(best[i]))) for i, one in enumerate(q)], "place long, _q array<double>, _best struct<s:double,k:long>")
    found = V.better_counts(spark.createDataFrame(rows, "k long, v array<double>"), asked, "place", "k", "v")
    assert "NestedLoop" not in found._jdf.queryExecution().toString()
    expected = {i: int(((cos[i] > cos[i, b]) | ((cos[i] == cos[i, b]) & (np.arange(150) < b))).sum()) for i, b in enumerate(best)}
    assert {r.place: r.better for r in found.collect()} == expected


def test_components_are_dropped(spark):
    _, x = clusters(n=300, dim=6)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "k long, v array<double>")
    rest = np.array([r.out for r in V.without_components(df, "v", "out", 2).orderBy("k").collect()])
    values, basis = np.linalg.eigh(np.cov(x.T, bias=True))
    assert np.abs(rest - (x - x.mean(0)) @ basis[:, :4] @ basis[:, :4].T).max() < 1e-9
    got = {(r.i, r.j): r.value for r in V.covariance_cells(V.whiten(df, "v", "w", unit=False), "w").collect()}
    assert all(v == pytest.approx(float(i == j), abs=1e-9) for (i, j), v in got.items()) and len(got) == 36
