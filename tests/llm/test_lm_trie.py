"""Operator 12 against counts and probabilities worked out without a trie."""

import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from terrasift.llm import lm_trie
from terrasift.llm.elias_fano import EliasFano, encode

WORD = re.compile("[^\x20\x09-\x0d]+")


def tokens(text):
    return [*WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or "")), "\n"]


def fold(key):
    return None if key is None else zlib.crc32(str(key).encode()) % 5


class Plain:
    """The same model by dictionaries, unquantised."""

    def __init__(self, texts, order):
        self.order, self.counts, self.after = order, [Counter() for _ in range(order + 1)], defaultdict(set)
        for text in texts:
            seq = ["\r", *tokens(text)]
            for j in range(1, len(seq)):
                for k in range(1, order + 1):
                    if j - k + 1 >= (1 if k == 1 else 0):
                        gram = tuple(seq[j - k + 1 : j + 1])
                        self.counts[k][gram] += 1
                        self.after[gram[:-1]].add(gram[-1])
        self.begins, self.total, self.types = len(texts), sum(self.counts[1].values()), len(self.counts[1])

    def count(self, context):
        return self.begins if context == ("\r",) else self.counts[len(context)][context]

    def p(self, context, word):
        if not context:
            return (self.counts[1][(word,)] + 0.5) / (self.total + 0.5 * (self.types + 1))
        lower, n = self.p(context[1:], word), self.count(context)
        if not n or not self.after[context]:
            return lower
        return max(self.counts[len(context) + 1][(*context, word)] - 0.75, 0) / n + 0.75 * len(self.after[context]) / n * lower

    def score(self, text):
        seq = ["\r", *tokens(text)]
        return sum(math.log10(self.p(tuple(seq[max(0, j - self.order + 1) : j]), seq[j])) for j in range(1, len(seq)))


def check(spark, rows, order=3, **how):
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    plain = Plain([t for k, t in rows if fold(k) not in (None, 1)], order)
    got = lm_trie.score_documents(docs, order, **how).collect()
    assert len(got) == len(rows)
    by = defaultdict(list)
    for k, t in rows:
        by[k].append(t)
    texts = {k: iter(v) for k, v in by.items()}
    for r in got:
        if len(by[r.doc_id]) == 1 or len(set(by[r.doc_id])) == 1:
            text = next(texts[r.doc_id])
            own = tokens(text)
            assert r.held_out == (fold(r.doc_id) == 1) and r.n_tokens == len(own) and r.train_tokens == plain.total
            assert r.n_known == sum(plain.counts[1][(w,)] > 0 for w in own)
            assert r.base_score == pytest.approx(sum(math.log10(plain.p((), w)) for w in own), rel=1e-9, abs=1e-9)
            assert r.score == pytest.approx(plain.score(text), rel=1e-3, abs=1e-3 * len(own))
    return got, plain


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 2**40), max_size=300), st.lists(st.integers(0, 2**41), min_size=1, max_size=50), st.data())
def test_sequences(values, asked, data):
    values = np.sort(np.array(values, np.uint64))
    held = EliasFano(encode(values))
    assert (held.get(np.arange(len(values))) == values).all()
    asked = np.array([*asked, *values[:20].tolist()], np.uint64)
    lo = np.array([data.draw(st.integers(0, len(values))) for _ in asked])
    hi = np.array([data.draw(st.integers(a, len(values))) for a in lo])
    place, equal = held.successor(asked, lo, hi)
    for x, a, b, p, same in zip(asked, lo, hi, place, equal, strict=True):
        expected = a + np.searchsorted(values[a:b], x)
        assert p == expected and same == (expected < b and values[expected] == x)


def test_levels_are_mapped(tmp_path):
    arrays = {"a.meta": np.arange(5, dtype=np.uint64), "b": np.arange(7, dtype=np.uint16), "none": np.zeros(0, np.uint32)}
    for _ in range(2):  # a task that runs again
        lm_trie.write_level(f"file://{tmp_path}/deep", "x-0", arrays)
    got = lm_trie.read_level(f"file://{tmp_path}/deep", "x-0")
    assert all((got[k] == v).all() and got[k].dtype == v.dtype for k, v in arrays.items())
    assert lm_trie.read_level(f"file://{tmp_path}/deep", "x-1") is None


@pytest.mark.parametrize("size", [1 << 22, 40, 7])
def test_tokens_of_chunks(monkeypatch, size):
    """Texts of a chunk, or pieces of a long one: the same tokens, with those ahead that n-grams need."""
    texts = ["AbÄ c\x1cd\x85e\x0bf  \t\n" * 20, "", " \n", "One", "x" * 60 + " Y"]
    monkeypatch.setattr(lm_trie, "CHUNK_BYTES", size)
    found = defaultdict(list)
    for chunk in lm_trie.chunks(pa.array(texts), 3):
        begun = False
        for i, (t, row, counted, start) in enumerate(zip(chunk.token, chunk.row, chunk.counted, chunk.starts, strict=True)):
            begun = start or begun
            assert begun
            if counted:
                found[int(row)].append(chunk.words[t])
            elif start:
                ahead = [chunk.words[k] for k in chunk.token[i : i + 2][~chunk.counted[i : i + 2]]]
                assert ahead == [lm_trie.BEGIN, *found[int(row)]][-2:]
    assert dict(found) == {i: [w.encode() for w in tokens(t)] for i, t in enumerate(texts)}


@pytest.mark.parametrize("order", [1, 2, 3, 4])
def test_scores_are_the_models(spark, data, order):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").limit(60).collect()]
    check(spark, rows, order)


def test_scores_of_chunks_and_parts(spark, monkeypatch):
    """Few tokens a chunk, many parts: the same as in one."""
    rows = [(i, " ".join(f"w{(i * 7 + j * j) % (11 + i % 5)}" for j in range(i % 40))) for i in range(120)]
    whole = {r.doc_id: r.score for r in check(spark, rows)[0]}
    monkeypatch.setattr(lm_trie, "CHUNK_BYTES", 40)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    train = docs.where(lm_trie._fold("doc_id") != 1).select("text")
    import tempfile

    base = f"file://{tempfile.mkdtemp()}"  # in this process, where the sizes are small
    texts = pa.array([r.text for r in train.collect()])
    words = Counter(w.encode() for t in texts for w in tokens(t.as_py()))
    bits = 3
    hashes = lm_trie.token_hashes(list(words))
    parts = []
    for p in range(1 << bits):
        at = sorted((int(h), n) for h, n in zip(hashes, words.values(), strict=True) if h >> np.uint64(64 - bits) == p)
        if at:
            own = np.array([h for h, _ in at], np.uint64)
            sums = np.concatenate([[0], np.cumsum([n for _, n in at])])
            lm_trie.write_level(base, f"words-{p}", lm_trie._named("hash", encode(lm_trie._rest_of(own, bits))) | lm_trie._named("sum", encode(sums)))
            parts.append((p, len(at), int(sums[-1])))
    vocabulary = lm_trie.Vocabulary(base, bits, parts, len(texts))
    shards = 9
    packed = defaultdict(list)
    for chunk in lm_trie.chunks(texts, 3):
        grams = lm_trie.Grams(chunk, vocabulary, 3)
        own = lm_trie._shards_of(grams, vocabulary, shards)
        for s in set(own.tolist()):
            at = np.flatnonzero(own == s)
            new = np.full(len(grams.last[2]), -1)
            new[at] = np.arange(len(at))
            inside = lm_trie._children(grams.parent[3], at)
            packed[s].append(lm_trie._packed([grams.word[grams.parent[2][at]], grams.last[2][at], grams.n[2][at], new[grams.parent[3][inside]], grams.last[3][inside], grams.n[3][inside]]))
    for s, blobs in packed.items():
        lm_trie.write_shard(base, s, blobs, vocabulary, 3)
    trie = lm_trie.Trie(vocabulary, 3, shards)
    got = trie.scores(pa.array([t or "" for _, t in rows]))[3]
    assert len(packed) > 4
    for (k, _), x in zip(rows, got, strict=True):
        assert x == pytest.approx(whole[k], abs=1e-9)


def test_probabilities_sum_to_one(spark):
    rows = [(i, " ".join("abcde"[(i * j) % 5] for j in range(9))) for i in range(40)]
    _, plain = check(spark, rows)
    for context in (("\r",), ("\r", "a"), ("a", "b"), ("never", "seen")):
        assert sum(plain.p(context, w) for (w,) in plain.counts[1]) + plain.p(context, "unseen") == pytest.approx(1)


def test_held_out_texts_are_likelier_than_by_words_alone(spark, data):
    rows = lm_trie.op12_lm_scores(spark, data).where("held_out").agg(F.sum("score").alias("s"), F.sum("base_score").alias("b")).first()
    assert rows.s > rows.b


def test_scores_of_odd_rows(spark):
    long = " ".join(f"w{i % 977}" for i in range(30_000))
    rows = [(1, None), (2, ""), (None, "no id"), (None, "no id"), (3, " \n\t "), (4, long), (5, "same same"), (5, "same same"), (6, "ÄÖ x\x0by"), *[(100 + i, "hot hot") for i in range(60)]]
    check(spark, rows)
    check(spark, [(None, "nothing to learn from"), (None, "nothing to learn from")])
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert lm_trie.score_documents(empty).count() == 0
    clash = spark.createDataFrame([(7, "a b", "x", 1)], "doc_id long, text string, score string, held_out int")
    out = lm_trie.score_documents(clash)
    assert out.count() == 1 and dict(out.dtypes)["score"] == "double" and out.columns.count("held_out") == 1
