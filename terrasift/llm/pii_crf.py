"""Operator 3: personal data by exact patterns, spread within each document by a skip-chain conditional random field."""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import plus, table

KINDS = ("email", "ip", "card", "phone")
#: Label 0 is none.
LABELS = ("none", *KINDS)
FEATURES = 1 << 12
#: The field is fitted on so many documents with a base span at most, those of the lowest hashes of their ids.
MAX_TRAIN_DOCS = 2_000
MAX_TRAIN_TOKENS = 200_000
MAX_FIELD = 1_000
ROUNDS = 12
DAMPING = 0.3
THRESHOLD = 0.5
#: Tokens are similar if one's digits end in all the other's, these being so many at least, and differ in so few.
MIN_DIGITS, MAX_EXTRA = 7, 4
#: Means of the Gaussian priors of the pairwise weights: like labels attract.
CHAIN_PRIOR, SKIP_PRIOR = 1.0, 8.0

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)")  # a run of digits fails or matches as a whole
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_HINT = re.compile(r"[0-9@]")
_TOKEN = re.compile(r"\S+")
_CORE = re.compile(r"[0-9A-Za-z+(].*[0-9A-Za-z]|[0-9A-Za-z]", re.S)


def luhn(digits: str) -> bool:
    odd, even = digits[-1::-2], digits[-2::-2]
    return (sum(map(int, odd)) + sum(sum(divmod(2 * int(d), 10)) for d in even)) % 10 == 0


def _octet(digits: str) -> bool:
    """Whether digits, with any number of zeros ahead, are 255 at most."""
    digits = digits.lstrip("0") or "0"
    return len(digits) <= 3 and int(digits) <= 255


def base_spans(text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int]]]:
    """Spans (start, kind, end) in order of start and kind, and the matches that failed their check."""
    spans, failed = [], []
    if not _HINT.search(text):
        return spans, failed
    last, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in _LOCAL:
            start -= 1
        after = at + 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            spans.append((start, 0, m.end()))
            last = after = m.end()
        else:
            last = at + 1
        at = text.find("@", after)
    for m in _IP.finditer(text):
        if all(map(_octet, m[0].split("."))):
            spans.append((m.start(), 1, m.end()))
        else:
            failed.append(m.span())
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 12 <= len(digits) <= 19 and luhn(digits):
            spans.append((m.start(), 2, m.end()))
        elif len(digits) >= 12:
            failed.append(m.span())
    for m in _PHONE.finditer(text):
        if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
            spans.append((m.start(), 3, m.end()))
    return sorted(spans), failed


def spans_text(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for start, kind, end in sorted(spans))


class Field:
    """Graph of a document's tokens that hold a digit or @: adjacent ones are chained; those of a value that is repeated or similar, also in groups of
    digits, are joined by skip edges to the value's mention before."""

    def __init__(self, text: str, spans: list[tuple[int, int, int]], failed: list[tuple[int, int]]):
        self.spans, words = [], []
        self.features: list[list[int]] = []
        self.chain: list[tuple[int, int]] = []
        self.skip: list[tuple[int, int]] = []
        before, before_end, was = "", -1, -1
        pending = None
        for m in _TOKEN.finditer(text):
            if pending is not None:
                self.features[pending].append(_feature("next", m[0].lower()))
                pending = None
            if _HINT.search(m[0]):
                core = _CORE.search(m[0])
                k = len(words)
                self.spans.append((m.start() + core.start(), m.start() + core.end()) if core else m.span())
                words.append(core[0] if core else m[0])
                self.features.append([_feature("bias", ""), _feature("shape", _shape(words[-1])), _feature("digits", str(min(20, sum(map(str.isdigit, words[-1]))))), _feature("before", before)])
                if was == before_end and was >= 0:
                    self.chain.append((k - 1, k))
                was, pending = m.end(), k
                before_end = m.end()
            else:
                before_end = -1
            before = m[0].lower()
            if was != m.end():
                was = -1
        last: dict[str, tuple[list[int], str]] = {}
        self.unit = np.zeros(len(words), np.int64)
        for u, (unit, said) in enumerate(_units(words, set(self.chain))):
            self.unit[unit] = u
            numeric = said.isdigit()
            key = said[-MIN_DIGITS:] if numeric else said
            if (before_it := last.get(key)) is not None and len(key) > 3:
                there, other = before_it
                if not numeric or (abs(len(other) - len(said)) <= MAX_EXTRA and (other.endswith(said) or said.endswith(other))):
                    self.skip += [(there[-1], k) for k in unit]
            last[key] = unit, said
        self.label = np.full(len(words), -1)
        starts, ends = (np.array(x, np.int64) for x in (zip(*self.spans, strict=True) if self.spans else ((), ())))
        for a, label, b in [(a, 0, b) for a, b in failed] + [(a, kind + 1, b) for a, kind, b in spans]:
            # tokens are in order and apart: those that a span touches stand together
            self.label[np.searchsorted(ends, a, "right") : np.searchsorted(starts, b, "left")] = label

    def __len__(self) -> int:
        return len(self.spans)


def _units(words: list[str], chain: set[tuple[int, int]]) -> Iterator[tuple[list[int], str]]:
    """(tokens, what they say) of the values of a text: a number of MIN_DIGITS digits, or adjacent shorter ones that have as many together, as its digits
    without the zeros ahead, so that national and international forms end alike; any other token by itself, in lower case."""
    digits = ["" if "@" in w else "".join(c for c in w if c in "0123456789") for w in words]
    digits = ["" if len(d) < MIN_DIGITS and any(map(str.isalpha, w)) else d for d, w in zip(digits, words, strict=True)]
    k = 0
    while k < len(words):
        end = k + 1
        if digits[k] and len(digits[k]) < MIN_DIGITS:
            while end < len(words) and (end - 1, end) in chain and 0 < len(digits[end]) < MIN_DIGITS:
                end += 1
        said = "".join(digits[k:end])
        if len(said) >= MIN_DIGITS:
            yield list(range(k, end)), said.lstrip("0") or said
        else:
            yield from (([i], words[i].lower()) for i in range(k, end))
        k = end


def _shape(word: str) -> str:
    out: list[str] = []
    for c in word:
        kind = "9" if c.isdigit() else "a" if c.isalpha() else c
        if kind == "9" or not out or out[-1] != kind:
            out.append(kind)
    return "".join(out[:40])


def _feature(name: str, value: str) -> int:
    return int.from_bytes(hashlib.blake2b(f"{name}\0{value[:64]}".encode("utf-8", "surrogatepass"), digest_size=4).digest(), "big") % FEATURES


class SkipChainCrf:
    """Unary weights (FEATURES x labels) and two pairwise tables, of chain and skip edges."""

    def __init__(self, unary: np.ndarray, chain: np.ndarray, skip: np.ndarray):
        self.unary, self.chain, self.skip = unary, chain, skip

    @classmethod
    def fit(cls, fields: list[Field], steps: int = 120, rate: float = 0.5) -> SkipChainCrf:
        """Pseudo-likelihood with Gaussian priors: each token's label given its features and the labels of its neighbours. Labels are
        the base spans'; tokens that touch none are none, but one that a skip edge joins to a base span says nothing, for whether it
        belongs to it is what the field is to find out."""
        n = len(LABELS)
        prior = [np.zeros((FEATURES, n)), CHAIN_PRIOR * np.eye(n), SKIP_PRIOR * np.eye(n)]
        w = [p.copy() for p in prior]
        labels = np.concatenate([np.maximum(f.label, 0) for f in fields]) if fields else np.empty(0, int)
        if len(labels) == 0:
            return cls(*w)
        offsets = np.cumsum([0, *(len(f) for f in fields)])
        token = np.concatenate([np.repeat(np.arange(len(f)), [len(x) for x in f.features]) + o for f, o in zip(fields, offsets, strict=False)])
        feature = np.concatenate([np.concatenate([np.array(x, int) for x in f.features]) if len(f) else np.empty(0, int) for f in fields])
        edges = [np.concatenate([np.array(getattr(f, kind), int).reshape(-1, 2) + o for f, o in zip(fields, offsets, strict=False)]) for kind in ("chain", "skip")]
        truth = np.eye(n)[labels]
        told = np.concatenate([f.label for f in fields])
        counts = np.ones((len(labels), 1))
        for a, b in edges[1].tolist():
            for x, y in ((a, b), (b, a)):
                if told[x] < 0 and told[y] > 0:
                    counts[x] = 0
        for _ in range(steps):
            score = np.zeros((len(labels), n))
            np.add.at(score, token, w[0][feature])
            for table_, e in zip(w[1:], edges, strict=True):
                np.add.at(score, e[:, 0], table_[:, labels[e[:, 1]]].T)
                np.add.at(score, e[:, 1], table_[labels[e[:, 0]]])
            p = np.exp(score - score.max(1, keepdims=True))
            error = counts * (truth - p / p.sum(1, keepdims=True))
            grad = np.zeros_like(w[0])
            np.add.at(grad, feature, error[token])
            seen = np.bincount(feature, minlength=FEATURES)[:, None]
            w[0] += rate * ((grad - 0.1 * w[0]) / (seen + 5))
            for k, e in enumerate(edges, 1):
                grad = np.zeros((n, n))
                np.add.at(grad.T, labels[e[:, 1]], error[e[:, 0]])
                np.add.at(grad, labels[e[:, 0]], error[e[:, 1]])
                w[k] += rate * (grad - 2.0 * (w[k] - prior[k])) / (len(e) + 10)
        return cls(*w)

    def marginals(self, field: Field) -> np.ndarray:
        """Loopy sum-product in logs, damped; labelled tokens are evidence."""
        n = len(LABELS)
        unary = np.stack([self.unary[f].sum(0) for f in field.features])
        known = field.label >= 0
        unary[known] = -50.0
        unary[known, field.label[known]] = 50.0
        edges = np.array(field.chain + field.skip, int).reshape(-1, 2)
        if len(edges):
            tables = np.concatenate([np.broadcast_to(self.chain, (len(field.chain), n, n)), np.broadcast_to(self.skip, (len(field.skip), n, n))])
            source, target = np.r_[edges[:, 0], edges[:, 1]], np.r_[edges[:, 1], edges[:, 0]]
            tables = np.concatenate([tables, tables.transpose(0, 2, 1)])
            back = np.r_[np.arange(len(edges)) + len(edges), np.arange(len(edges))]
            message = np.zeros((len(source), n))
            for _ in range(ROUNDS):
                belief = unary.copy()
                np.add.at(belief, target, message)
                out = (belief[source] - message[back])[:, :, None] + tables
                top = out.max(1, keepdims=True)
                new = np.log(np.exp(out - top).sum(1)) + top[:, 0]
                new -= new.max(1, keepdims=True)
                if np.abs(new - message).max() < 1e-4:
                    break
                message = DAMPING * message + (1 - DAMPING) * new
            np.add.at(unary, target, message)
        p = np.exp(unary - unary.max(1, keepdims=True))
        return p / p.sum(1, keepdims=True)

    def added(self, text: str, spans: list[tuple[int, int, int]], failed: list[tuple[int, int]]) -> list[tuple[int, int, int]]:
        """Runs of unlabelled tokens of one kind, of which at least one has a skip edge to a token of that kind."""
        field = Field(text, spans, failed)
        if not field.skip:
            return []
        p = self.marginals(field)
        best = np.where(p.max(1) >= THRESHOLD, p.argmax(1), 0)
        linked = np.zeros(len(field), bool)
        for a, b in field.skip:
            if best[a] == best[b] > 0:
                linked[a] = linked[b] = True
        chained = set(field.chain)
        out, k = [], 0
        while k < len(field):
            if field.label[k] >= 0 or best[k] == 0:
                k += 1
                continue
            end = k + 1
            while end < len(field) and (end - 1, end) in chained and field.label[end] < 0 and best[end] == best[k] and (field.unit[end] == field.unit[end - 1] or not (linked[end] and linked[k:end].any())):
                end += 1  # a second linked value is a mention of its own
            if linked[k:end].any():
                out.append((field.spans[k][0], int(best[k]) - 1, field.spans[end - 1][1]))
            k = end
        return out


def fit(docs: DataFrame, key: str = "doc_id", most: int = MAX_TRAIN_DOCS) -> SkipChainCrf:
    """Fit on the fields of at most `most` documents with a base span, those of the lowest hashes of key and text, and of these on as many as have
    MAX_TRAIN_TOKENS tokens together; documents of over MAX_FIELD tokens are left out. All are found by one job, which sends the driver tokens'
    features and labels alone, in an order that does not depend on partitions."""
    likely = docs.where(F.col("text").rlike("@[A-Za-z0-9-]+\\.|[0-9]\\.[0-9]+\\.[0-9]|[0-9][ -]?[0-9][ -]?[0-9][ -]?[0-9][ -]?[0-9]"))
    likely = likely.select("text", F.xxhash64(key, "text").alias("rank"))
    n = likely.count()
    if n > most:
        likely = likely.where(F.pmod("rank", F.lit(2**30)) < int(most / n * 2**30))

    def fields(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import pickle

        for batch in batches:
            rows = []
            for text, rank in zip(batch.text, batch["rank"], strict=True):
                spans, failed = base_spans(text)
                if spans and len(field := Field(text, spans, failed)) <= MAX_FIELD:
                    rows.append((rank, pickle.dumps(field), len(field)))
            yield pd.DataFrame(rows, columns=["rank", "field", "tokens"])

    import pickle

    found = likely.mapInPandas(fields, "rank long, field binary, tokens int").withColumn("_order", F.pmod("rank", F.lit(2**30))).orderBy("_order", "rank").limit(most)
    held, tokens = [], 0
    for row in found.select("field", "tokens").collect():
        tokens += row.tokens
        if tokens > MAX_TRAIN_TOKENS:
            break
        held.append(pickle.loads(row.field))
    return SkipChainCrf.fit(held)


def pii_column(spark: SparkSession, text: Column, model: SkipChainCrf) -> Column:
    shared = spark.sparkContext.broadcast(model)
    names = [f"n_{k}" for k in KINDS]

    @F.pandas_udf(", ".join(f"{x} long" for x in names) + ", base_sha256 string, spans string")
    def find(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        crf = shared.value
        for batch in batches:
            rows = []
            for t in batch:
                spans, failed = base_spans(t or "")
                more = crf.added(t, spans, failed) if spans else []
                count = Counter(kind for _, kind, _ in spans)
                base = spans_text(spans)
                rows.append((*(count[k] for k in range(len(KINDS))), hashlib.sha256(base.encode()).hexdigest(), spans_text(spans + more) if more else base))
            yield pd.DataFrame(rows, columns=[*names, "base_sha256", "spans"])

    return find(text)


def find_pii(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """docs (key, text, ...) -> all columns, n_email, n_ip, n_card, n_phone, base_sha256, spans.

    The counts and the hash are of the base spans: leftmost, non-overlapping per kind, in the whole text. spans also has what the
    field adds: tokens that repeat or resemble a base span's in the same document, with neighbours of the same kind. A document
    without a base span gets none. Positions are code points, ends exclusive. Null text is empty. Nothing is shuffled."""
    model = fit(docs.select(key, "text").where("text is not null"), key)
    found = plus(docs, __found=pii_column(docs.sparkSession, F.col("text"), model))
    names = [*(f"n_{k}" for k in KINDS), "base_sha256", "spans"]
    return plus(found, **{name: F.col(f"__found.{name}") for name in names}).drop("__found")


def redact(text: str, spans: str) -> str:
    """text with each span replaced by its kind in brackets; of overlapping spans the first counts."""
    out, at = [], 0
    for kind, start, end in (s.split(":") for s in spans.split(",") if s):
        if int(start) >= at:
            out += [text[at : int(start)], f"[{kind}]"]
            at = int(end)
    return "".join([*out, text[at:]])


def op3_pii_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data of every document."""
    return find_pii(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")
