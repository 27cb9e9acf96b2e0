"""What the operators leave on disk while they run, and hand to workers at once."""

import os

import corpus_pipeline
from pyspark.sql import functions as F

from terrasift.llm import buckets, decontam, langid, line_dedup
from terrasift.llm.common import Scratch

BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def test_scratch_frees_disk_as_it_goes(spark):
    before = spark.conf.get(CLEANUP, None)
    with Scratch(spark) as scratch:
        assert spark.conf.get(CLEANUP) == "true"
        rows = scratch.keep(spark.range(100).groupBy("id").count(), "rows", spark.range(100, 120).groupBy("id").count())
        assert sorted(r.id for r in rows.collect()) == list(range(120))
        path = scratch.paths[id(rows)][0].removeprefix("file:").replace("//", "/")
        assert os.path.isdir(path)
        scratch.drop(rows)
        assert not os.path.exists(path)
    assert spark.conf.get(CLEANUP, None) == before


def test_lines_meet_kind_by_kind(spark):
    """Each key of a line stands in one kind, and lines that two kinds of key are for stand in both."""
    lines = [(1, "abcdefghi"), (2, "b" * 18), (3, "ab cd " * 6), (4, "some words " * 7), (5, "some words " * 9), (6, "x" * 200), (7, "short")]
    kinds = line_dedup.line_keys(spark.createDataFrame(lines, "k1 long, norm string"))
    assert [{r.node for r in kind.collect()} for kind in kinds] == [{1, 2}, {2, 3}, {3, 4, 6}, {4, 5}]
    for kind in kinds:
        assert kind.groupBy("node", "key").count().where("count > 1").isEmpty()


def test_pairs_are_verified_in_slices(spark):
    seen = []

    def similar(pairs):
        seen.append(pairs.count())
        return pairs.where("(a + b) % 2 = 0")

    pairs = [(a, b) for a in range(20) for b in range(a)]
    with Scratch(spark) as scratch:
        got = buckets._verified(spark.createDataFrame(pairs, "a long, b long"), similar, scratch, 40)
        assert sorted(map(tuple, got.collect())) == sorted(p for p in pairs if sum(p) % 2 == 0)
    assert len(seen) == 5 and sum(seen) == 190 and max(seen) < 80


def test_stages_hand_out_few_texts(spark, data, monkeypatch):
    """What a stage writes with whole texts in Python is planned with batches of 1,000 rows; the session's own setting stays."""
    docs, seen, before = spark.read.parquet(f"{data}/documents.parquet"), [], spark.conf.get(BATCH)
    for module in (langid, decontam):
        monkeypatch.setattr(module, "materialize", lambda df, name, to=module.materialize: (seen.append((name, spark.conf.get(BATCH))), to(df, name))[1])
    stages = dict(corpus_pipeline.STAGES)
    stages["language_id"](spark, docs, data)
    stages["decontamination"](spark, docs.where(F.col("doc_id") < 50), data)
    assert seen == [("accepted", "1000"), ("hits", "1000")] and spark.conf.get(BATCH) == before
