"""Groups and notes of records without the pairs they come from."""

import pyarrow as pa
import pytest

from terrasift.operators import graph, spatial
from terrasift.plans import entities
from terrasift.plans.base import Tables


@pytest.fixture
def crowd(spark, tmp_path):
    """60 records a side at two spots, some 50 m between sides, and a few that stand alone."""
    keys = [997_000 * i + (i % 2) * 3 for i in range(60)] + [17, 430, 911]
    spark.createDataFrame([(k, "BUILDING" if k % 3 else "MACHINERY") for k in keys], "c_custkey long, c_mktsegment string").write.parquet(f"{tmp_path}/customer.parquet")
    spark.createDataFrame([(k,) for k in keys], "s_suppkey long").write.parquet(f"{tmp_path}/supplier.parquet")
    return Tables(spark, str(tmp_path))


def test_links_of_a_crowd_are_few(crowd, monkeypatch):
    """Components are handed a forest and not every match; groups and pairs are those of scoring each pair."""
    seen = []
    monkeypatch.setattr(graph, "components", lambda nodes, edges, *more, to=graph.components, **named: (seen.append(edges.count()), to(nodes, edges, *more, **named))[1])
    monkeypatch.setattr(spatial, "ARRAY_BLOCK", 40)
    got = sorted(map(tuple, entities.groups(crowd).collect()))
    assert sum(seen) < 500
    ahead = sorted(map(tuple, entities.candidates(crowd).collect()))
    assert len(ahead) > 1_500
    monkeypatch.setattr(entities, "RULES_AHEAD", 0)
    assert got == sorted(map(tuple, entities.groups(crowd).collect()))
    assert ahead == sorted(map(tuple, entities.candidates(crowd).collect()))


def test_notes_are_those_of_all_pairs(crowd, monkeypatch):
    asked = []
    monkeypatch.setattr(entities, "candidates", lambda t, to=entities.candidates: (asked.append(t), to(t))[1])
    got = sorted(map(tuple, entities.match_notes(crowd).collect()))
    assert not asked
    monkeypatch.setattr(entities, "RULES_AHEAD", 0)
    assert got == sorted(map(tuple, entities.match_notes(crowd).collect())) and asked


def test_blocks_meet_once(spark, monkeypatch):
    monkeypatch.setattr(spatial, "ARRAY_BLOCK", 7)
    a, b = (spark.createDataFrame([(i, float(i % 5), float(i % 3)) for i in range(30)] + [(99, None, 1.0)], "k long, x double, y double") for _ in "ab")
    met = lambda a, b: pa.table({"a": [x for x in a["k"].to_pylist() for _ in range(len(b))], "b": b["k"].to_pylist() * len(a)}, pa.schema({"a": pa.int64(), "b": pa.int64()}))
    pairs = spatial.met_in_blocks(a, b, 10.0, met, "a long, b long").collect()
    assert sorted(map(tuple, pairs)) == [(i, j) for i in range(30) for j in range(30)]


def test_one_task_joins_as_rounds_do(spark, monkeypatch):
    links = [(f"n{i * 7 % 50}", f"n{i * 11 % 60}") for i in range(40)] + [("é", "n1"), ("z", "n1"), (None, "q")]
    edges, nodes = spark.createDataFrame(links, "a string, b string"), spark.createDataFrame([(x,) for x in {x for e in links for x in e if x} | {"alone"}], "node string")
    got = sorted(map(tuple, graph.components(nodes, edges).collect()))
    monkeypatch.setattr(graph, "ONE_TASK", 0)
    assert got == sorted(map(tuple, graph.components(nodes, edges).collect()))
