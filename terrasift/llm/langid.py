"""Operator 10: language identification by multinomial naive Bayes over hashed character n-grams."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import TEXTS_AT_ONCE, materialize, plus, small_batches, table

ORDERS = (1, 2, 3)
BUCKETS = 1 << 15
SMOOTHING = 0.5
UNDETERMINED = "und"
#: The classifier is fitted on about so many labelled documents at most, those of the lowest hashes of their ids: a label's share of them,
#: but LEAST_DOCS of each if it has as many.
MAX_TRAIN_DOCS = 20_000
LEAST_DOCS = 200
#: Characters that are scored at once.
CHUNK = 200_000
_MULTIPLIERS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], np.uint64)


def ngram_buckets(text: str, starts: int | None = None) -> np.ndarray:
    """Bucket of every character n-gram of a lower-cased text, repeats included; only of those in its first `starts` places, if that is given."""
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    found = []
    for order in ORDERS:
        if len(codes) >= order:
            mixed = np.full(len(codes) - order + 1, order, np.uint64)
            for i in range(order):
                mixed = (mixed + codes[i : len(codes) - order + 1 + i]) * _MULTIPLIERS[i]
            found.append((mixed[:starts] >> np.uint64(64 - 15)).astype(np.int32))
    return np.concatenate(found) if found else np.empty(0, np.int32)


def _chunks(text: str) -> Iterator[str]:
    """The lower-cased text in parts of CHUNK characters and the few that n-grams at their end reach into."""
    text = text.lower()
    for at in range(0, len(text), CHUNK):
        yield text[at : at + CHUNK + max(ORDERS) - 1]


def text_buckets(text: str) -> Iterator[np.ndarray]:
    """Buckets of the whole text's n-grams, each once, in parts of a bounded size."""
    for part in _chunks(text):
        yield ngram_buckets(part, CHUNK)


class Model:
    """Labels in order, log priors and the BUCKETS x labels matrix of log-probabilities."""

    def __init__(self, labels: list[str], docs: np.ndarray, counts: np.ndarray):
        self.labels = labels
        smooth = counts + np.float32(SMOOTHING)
        self.log_prior = np.log(docs / docs.sum()) if len(labels) else np.empty(0)
        self.log_p = np.ascontiguousarray(np.log(smooth / smooth.sum(1, keepdims=True, dtype=np.float64).astype(np.float32)).T.astype(np.float32)) if len(labels) else np.empty((BUCKETS, 0), np.float32)

    def predict(self, text: str | None) -> tuple[str, float]:
        """(label, posterior); ties go to the first label. Null text, text without a letter, or no labels: (und, 0)."""
        if not self.labels or not text or not any(map(str.isalpha, text)):
            return UNDETERMINED, 0.0
        score = self.log_prior.copy()
        for ids in text_buckets(text):
            if len(ids) > BUCKETS:  # each row of the matrix once
                score += np.bincount(ids, minlength=BUCKETS) @ self.log_p.astype(np.float64)
            else:
                score += self.log_p[ids].sum(0, dtype=np.float64)
        best = int(np.argmax(score))
        return self.labels[best], float(1 / np.exp(score - score[best]).sum())


def fit(labelled: DataFrame, max_docs: int = MAX_TRAIN_DOCS, key: str = "doc_id") -> Model:
    """Fit on rows (key, text, lang); null text or lang is left out. Any number of labels: the model has BUCKETS numbers for each. n-grams are
    counted on the executors, per task and then per (label, bucket); the driver gets labels x BUCKETS sums at most."""
    labelled = labelled.where("text is not null and lang is not null")
    docs = dict(labelled.groupBy("lang").count().collect())
    total = sum(docs.values())
    if total > max_docs:
        common, least = max_docs / total, min(LEAST_DOCS, max_docs / len(docs))
        rare = {lang: min(1.0, least / n) for lang, n in docs.items() if least / n > common}
        share = F.lit(int(common * 2**30))
        if rare:
            own = F.create_map(*[F.lit(x) for lang, part in rare.items() for x in (lang, int(part * 2**30))])
            share = F.coalesce(F.try_element_at(own, F.col("lang")), share)
        labelled = labelled.where(F.pmod(F.xxhash64(key), F.lit(2**30)) < share)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for lang, text in zip(batch.lang, batch.text, strict=True):
                for ids in text_buckets(text):
                    sums.setdefault(lang, np.zeros(BUCKETS, np.int64))
                    sums[lang] += np.bincount(ids, minlength=BUCKETS)
        for lang, n in sums.items():
            there = np.flatnonzero(n)
            yield pd.DataFrame({"lang": lang, "bucket": there, "n": n[there]})

    rows = labelled.select("lang", "text").mapInPandas(count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    labels = sorted(docs)
    counts = np.zeros((len(labels), BUCKETS), np.float32)
    counts[rows.lang.map({x: i for i, x in enumerate(labels)}).to_numpy(int), rows.bucket.to_numpy(int)] = rows.n
    return Model(labels, np.array([docs[x] for x in labels], float), counts)


def predicted(spark: SparkSession, text: Column, model: Model) -> Column:
    """struct(lang_pred, score) of the whole text."""
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf("lang_pred string, score double")
    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        own = shared.value
        for batch in batches:
            yield pd.DataFrame([own.predict(t) for t in batch], columns=["lang_pred", "score"]).astype({"lang_pred": object, "score": float})

    return predict(text)


def _fold(key: str) -> Column:
    return F.pmod(F.crc32(F.encode(F.col(key).cast("string"), "UTF-8")), F.lit(4))


def identify(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """docs (key, text, lang, ...) -> all columns, held_out, lang_pred, score.

    Learns from the text and lang of documents whose crc32 of the key as text is not 2 modulo 4; a null key belongs to no fold,
    is not learned from and not held out. lang, source and the key are no inputs of a prediction, so equal texts get equal
    results. Without any labelled document all is und with score 0. Very long texts are scored in overlapping chunks, whole."""
    model = fit(docs.where(_fold(key) != 2).select(F.col(key).alias("doc_id"), "text", "lang"))
    held_out = F.coalesce(_fold(key) == 2, F.lit(False))
    out = plus(docs, held_out=held_out, __found=predicted(docs.sparkSession, F.col("text"), model))
    return plus(out, lang_pred=F.col("__found.lang_pred"), score=F.col("__found.score")).drop("__found")


def accepted(docs: DataFrame, least: float = 0.5, key: str = "doc_id") -> DataFrame:
    """The rows of docs, columns as they are, whose language is determined with a score of `least` at least. Learns from all labelled
    rows of docs, sampled as in fit(). Without any label no language can be told, and every row with a letter stays. The result is written
    here, while workers are handed few texts at a time."""
    with small_batches(docs.sparkSession, TEXTS_AT_ONCE):
        model = fit(docs.select(F.col(key).alias("doc_id"), "text", "lang"))
        if not model.labels:
            return docs.where(F.col("text").rlike(r"\p{L}"))
        found = plus(docs, __found=predicted(docs.sparkSession, F.col("text"), model))
        return materialize(found.where((F.col("__found.lang_pred") != UNDETERMINED) & (F.col("__found.score") >= least)).select(*docs.columns), "accepted")


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted language of every document."""
    return identify(table(spark, sf_dir, "documents").select("doc_id", "text", "lang")).select("doc_id", "held_out", "lang_pred", "score")
