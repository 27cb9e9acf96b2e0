"""Quantiles closed in step by step against the ones that a sort gives."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from terrasift.operators.quantiles import exact_quantiles

PROBABILITIES = [0.0, 0.02, 0.25, 0.5, 0.5, 0.98, 1.0]


def groups():
    rng = np.random.default_rng(9)
    return {
        "even": rng.uniform(-5, 5, 900), "few": rng.uniform(0, 1, 7), "one": np.array([3.25]), "ties": rng.integers(0, 4, 700).astype(float), "same": np.full(500, 0.1),
        "steep": 10.0 ** rng.uniform(-300, 300, 400) * rng.choice([-1, 1], 400), "far": np.concatenate([np.full(600, 1.0), [1.7e308, -1.7e308]]), "near": 1 + np.arange(300) * 2.0**-52, None: rng.normal(size=300),
    }


@pytest.mark.parametrize(("small", "bins"), [(100_000, 1024), (20, 1024), (0, 200)])
def test_quantiles_are_those_of_a_sort(spark, small, bins):
    rows = [(k, float(v)) for k, values in groups().items() for v in values] + [("few", None), ("few", math.nan), ("none", None), ("none", math.nan)]
    df = spark.createDataFrame(rows, "k string, v double").repartition(5)
    got = {r.k: r.q for r in exact_quantiles(df, ["k"], "v", PROBABILITIES, small, bins).collect()}
    expected = df.where(~F.isnan("v")).groupBy("k").agg(F.percentile("v", F.array(*[F.lit(p) for p in PROBABILITIES])).alias("q"))
    assert got == {r.k: r.q for r in expected.collect()} | {"none": None}


def test_one_group_of_all_rows(spark):
    values = np.random.default_rng(1).normal(size=5001)
    df = spark.createDataFrame([(float(v),) for v in values], "v double")
    assert exact_quantiles(df, [], "v", [0.5], 100, 16).first().q == [float(np.median(values))]
    assert exact_quantiles(df.limit(0), [], "v", [0.5]).collect()[0].q is None
