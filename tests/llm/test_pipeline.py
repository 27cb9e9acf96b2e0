"""The corpus pipeline: every stage on its own input, against brute force."""

import random
import re
from collections import Counter, defaultdict

import corpus_pipeline
import numpy as np
from pyspark.sql import functions as F

from terrasift.llm import decontam, langid, mixing, near_copies
from terrasift.llm.common import materialize


def brute_copies(docs):
    """The smallest id of each group that Jaccard similarity of 0.8 over five-word shingles joins, by all pairs."""
    sets = []
    for _, t in docs:
        w = re.findall("[^\x20\x09-\x0d]+", (t or "").translate({c: c + 32 for c in range(65, 91)}))
        sets.append(frozenset(tuple(w[i : i + 5]) for i in range(max(len(w) - 4, 1))) if w else frozenset())
    root = list(range(len(docs)))

    def find(a):
        while root[a] != a:
            root[a] = root[root[a]]
            a = root[a]
        return a

    for a, x in enumerate(sets):
        for b in range(a):
            y = sets[b]
            if (x == y or (5 * min(len(x), len(y)) >= 4 * max(len(x), len(y)) and 9 * len(x & y) >= 4 * (len(x) + len(y)))) and find(a) != find(b):
                root[find(a)] = find(b)
    least = {}
    for a, (i, _) in enumerate(docs):
        least[find(a)] = min(i, least.get(find(a), i))
    return set(least.values())


def test_stages(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    extra = [(9001, "12345 67890 !!", "en", "src1", 1), (9002, None, "en", "src1", 1), (9003, "", None, None, 0)]
    docs = docs.union(spark.createDataFrame(extra, docs.schema))
    columns = docs.columns
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["language_id", "near_dedup", "decontamination", "mixing", "sharding"]
    out = {}
    for name, stage in corpus_pipeline.STAGES:
        out[name] = materialize(stage(spark, docs, data), name)
        if name == "language_id":
            assert {r.doc_id for r in docs.collect()} - {r.doc_id for r in out[name].collect()} == {9001, 9002, 9003}
        if name == "near_dedup":
            assert sorted(r.doc_id for r in out[name].collect()) == sorted(brute_copies([(r.doc_id, r.text) for r in docs.collect()]))
        if name == "decontamination":
            items = [decontam.normalize(r.text) for r in spark.read.parquet(f"{data}/benchmark.parquet").collect()]
            kept = {r.doc_id for r in out[name].collect()}
            for r in docs.collect():
                if any(i in decontam.normalize(r.text) for i in items):
                    assert r.doc_id not in kept
                else:
                    assert r.doc_id in kept
        if name == "mixing":
            want = {r.doc_id: r["copies"] for r in mixing.mix(docs).collect() if r["copies"]}
            assert Counter(r.doc_id for r in out[name].collect()) == Counter(want)
        if name == "sharding":
            assert out[name].count() == docs.count()
            assert all(len({r.shard for r in g}) == 1 for g in _by_id(out[name]).values())
        else:
            assert out[name].columns == columns
        docs = out[name]


def test_near_dedup_is_brute_force_jaccard(spark):
    """Planted near copies around similarity 0.8, in chains, beside texts that share a passage only."""
    rng = random.Random(3)
    word = lambda: f"w{rng.randrange(400)}"
    passage = " ".join(word() for _ in range(30))
    texts = ["", None, "one two", "One  two"]
    for g in range(12):
        text = [word() for _ in range(rng.randrange(40, 160))]
        texts.append(" ".join(text) + (" " + passage if g % 3 == 0 else ""))
        for _ in range(6):
            if rng.random() < 0.3:
                text = list(text)
            copy = list(text)
            for at in rng.sample(range(len(copy)), rng.randrange(1, 1 + max(1, len(copy) // 25))):
                copy[at] = word()
            text = copy if rng.random() < 0.4 else text
            texts.append(" ".join(copy))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = dict(corpus_pipeline.STAGES)["near_dedup"](spark, docs, "")
    kept = brute_copies(list(enumerate(texts)))
    assert sorted(r.doc_id for r in got.collect()) == sorted(kept)
    assert len(kept) < len(texts) - 20


def test_buckets_are_dealt_out_in_blocks(spark, monkeypatch):
    """A group of near copies whose buckets take many blocks gives the same as in one."""
    monkeypatch.setattr(near_copies, "BLOCK", 3)
    rng = random.Random(9)
    base = [f"w{rng.randrange(500)}" for _ in range(120)]
    texts = []
    for _ in range(90):
        copy = list(base)
        for at in rng.sample(range(120), rng.randrange(1, 9)):
            copy[at] = f"w{rng.randrange(500)}"
        texts.append(" ".join(copy))
    got = dict(corpus_pipeline.STAGES)["near_dedup"](spark, spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), "")
    kept = brute_copies(list(enumerate(texts)))
    assert sorted(r.doc_id for r in got.collect()) == sorted(kept) and 1 < len(kept) < 90


def _by_id(df):
    groups = defaultdict(list)
    for r in df.collect():
        groups[r.doc_id].append(r)
    return groups


def test_run(spark, data):
    rows = corpus_pipeline.run(spark, data)
    assert rows.groupBy("shard").agg((F.max("slot") + 1 == F.count("*")).alias("ok")).where("not ok").count() == 0
    assert langid.UNDETERMINED == "und"


def test_minima_agree_as_often_as_sets_are_similar(monkeypatch):
    """Bins of few orders do as well as an order for each minimum: sets of 5 hashes and of 5,000, in parts and whole."""
    rng = np.random.default_rng(0)
    for n in (5, 40, 300, 5000):
        far = []
        for _ in range(40):
            every = rng.integers(0, 1 << 63, n, dtype=np.uint64)
            left_out = max(1, n // 10)
            a, b = np.sort(every[left_out:]), np.sort(every[: n - left_out])
            (keys, x), (other, y) = near_copies.sketch(a), near_copies.sketch(b)
            far.append(np.bitwise_count(x.view(np.uint64) ^ y.view(np.uint64)).sum() / near_copies.SKETCH)
            assert (near_copies.minima(a) == near_copies.minima(a[::-1])).all() and len(set(keys.tolist())) == near_copies.BANDS
        similarity = (n - 2 * left_out) / n
        assert abs(np.mean(far) - (1 - similarity) / 2) < 0.02
    whole = near_copies.minima(a)
    monkeypatch.setattr(near_copies, "_AT_ONCE", 100)
    assert (near_copies.minima(a) == whole).all()


def test_simhashes_and_gray_index_find_what_is_similar(spark):
    """F16: candidates come from the Gray index over SimHashes alone, and pairs of similarity 0.8, where some 10 bits of 64 differ, are found by it."""
    rng = random.Random(16)
    texts = []
    for _ in range(150):
        text = [f"w{rng.randrange(3000)}" for _ in range(94)]
        texts += [" ".join(text), " ".join(text[:-10] + [f"x{rng.randrange(3000)}" for _ in range(10)])]
    rows = spark.createDataFrame(list(enumerate(texts)), "node long, text string")
    prints = near_copies._prints(rows, "node").selectExpr("node", "n as len", "words", "node as c")
    got = near_copies._met(near_copies._table_rows(prints, range(near_copies.TABLES), near_copies.MOST + 1), 300, True).toPandas()
    assert {(2 * g, 2 * g + 1) for g in range(150)} <= set(zip(got.a, got.b, strict=True))
    out = near_copies.near_copies(rows, "node").where("node <> component_id")
    assert {(r.component_id, r.node) for r in out.collect()} == {(2 * g, 2 * g + 1) for g in range(150)}


def test_gray_index_leaves_out_pairs_of_one_label():
    """With labels the index gives the pairs of different labels that are near, all of them, and few others."""
    rng = np.random.default_rng(5)
    codes = rng.integers(0, 1 << 12, 3000, dtype=np.uint64)
    groups, labels = codes & np.uint64(15), np.where(rng.random(3000) < 0.9, 1, rng.integers(2, 9, 3000))
    index = near_copies.GrayIndex(codes, groups, labels)
    seen = [np.stack(p) for p in index.walk(np.arange(3000), 2)]
    i, j = np.concatenate(seen, axis=1)
    apart = index.labels[i] != index.labels[j]
    got = set(zip(i[apart].tolist(), j[apart].tolist(), strict=True))
    near = (np.bitwise_count(index.codes[:, None] ^ index.codes) <= 2) & (index.groups[:, None] == index.groups) & (index.labels[:, None] != index.labels)
    assert got == set(zip(*(x.tolist() for x in np.nonzero(np.triu(near, 1))), strict=True))
