"""Operator 13 against features counted one by one, and against its SQL."""

import hashlib
import math
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest

from terrasift.llm import resample

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def features(text, max_n):
    w = words(text)
    return [" ".join(w[i : i + n]) for n in range(1, max_n + 1) for i in range(len(w) - n + 1)]


def expected(rows, target, max_n=1, buckets=10_000, percent=10, least=20):
    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    s, t = (Counter(bucket(f) for text in texts for f in features(text, max_n)) for texts in ([x for _, x in rows], target))
    all_s, all_t = sum(s.values()), sum(t.values())
    out = []
    for key, text in rows:
        own = features(text, max_n)
        gains = [math.floor(1000 * math.log((t[b] + 1) * (all_s + buckets) / ((s[b] + 1) * (all_t + buckets)))) for b in map(bucket, own)]
        weight = sum(gains) // len(gains) if gains else 0
        h = int(hashlib.sha256(f"2024:{'' if key is None else key}".encode()).hexdigest()[:8], 16)
        out.append([key, len(own), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(words(text)) >= least])
    able = sorted((r for r in out if r[5]), key=lambda r: (-r[3], r[0] is not None, r[0] or 0))
    for i, r in enumerate(able[: percent * len(able) // 100], 1):
        r[4] = i
    return [tuple(r[:5]) for r in out]


def check(spark, rows, target, **how):
    own = {{"least_words": "least"}.get(k, k): v for k, v in how.items()}
    docs, wanted = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(t,) for t in target], "text string")
    got = [tuple(r) for r in resample.resample(docs, wanted, **how).select("doc_id", "n_features", "weight", "score", "rank").collect()]
    assert sorted(got, key=repr) == sorted(expected(rows, target, **own), key=repr)
    return got


def test_resampling_is_its_sql(spark, data):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{data}/{t}.parquet'")
    got = resample.op13_importance_resampling(spark, data)
    assert sorted(map(tuple, got.collect())) == sorted(con.sql(resample.OP13_SQL).fetchall())


@pytest.mark.parametrize("max_n", [1, 2, 3])
def test_resampling_of_runs(spark, max_n):
    rows = [(i, " ".join(f"W{(i * j) % 17}ä{j % 3}" for j in range(i % 60))) for i in range(200)]
    got = check(spark, rows, ["w1ä1 w2ä2 w3ä0", "w4ä1"], max_n=max_n, buckets=97, percent=30, least_words=5)
    assert sum(r[4] is not None for r in got) == 30 * sum(len(words(t)) >= 5 for _, t in rows) // 100


@pytest.mark.parametrize(("max_n", "chunk"), [(1, 3), (2, 10), (3, 25), (4, 1)])
def test_long_texts_in_pieces(spark, max_n, chunk):
    """Runs over the end of a piece count once; a text may go on through many queries."""
    texts = ["one Two, three four-five six seven", "", "x" * 40 + " y", "a b", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in resample.bucket_counts(docs, max_n, 101, chunk=chunk).collect():
        own = Counter(zlib.crc32(f.encode()) % 101 for f in features(texts[r.doc_id], max_n))
        assert (r.n_words, r.n_features) == (len(words(texts[r.doc_id])), sum(own.values()))
        assert dict(zip(r.buckets, r.counts, strict=True)) == dict(own) and r.buckets == sorted(r.buckets)


def test_resampling_of_odd_rows(spark):
    long = " ".join(f"w{i % 977}" for i in range(30_000))
    hot = [(7, "the same row again and again " * 5)] * 70
    rows = [(1, None), (2, ""), (None, "no id " * 20), (3, " \n\t "), (4, long), (5, "\x00 nul\x00 " * 12), *hot, *[(100 + i, "hot " * 30) for i in range(60)]]
    check(spark, rows, ["the same", None, ""])
    check(spark, rows, [])
    check(spark, [(1, None), (2, "")], ["a"])
    check(spark, rows, ["hot"], percent=100)
    docs, wanted = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([("a",)], "text string")
    assert resample.resample(docs, wanted).count() == 0
    clash = spark.createDataFrame([(1, "a b " * 20, 1, "x", "y")], "doc_id long, text string, rank int, score string, buckets string")
    assert resample.resample(clash, wanted, percent=100).first().rank == 1


def test_numbers_in_order(spark):
    """All rows, hot keys as well, from 1 without gaps."""
    from terrasift.llm.common import Scratch, numbered

    keys = np.random.default_rng(3).integers(0, 40, 5000).tolist() + [7] * 3000
    df = spark.createDataFrame(list(zip(keys, range(len(keys)), strict=True)), "k long, i long")
    with Scratch(spark) as scratch:
        got = sorted((r.n, r.k, r.i) for r in numbered(df, scratch, "n", "k", "i").collect())
    assert [n for n, _, _ in got] == list(range(1, len(keys) + 1)) and [(k, i) for _, k, i in got] == sorted((k, i) for k, i in zip(keys, range(len(keys)), strict=True))
