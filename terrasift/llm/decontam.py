"""Operator 9: benchmark decontamination by q-gram counts in overlapping diagonal bands and banded alignment."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import TEXTS_AT_ONCE, materialize, small_batches, table

#: Characters of a q-gram; items that are too short for it at the full rate of edits go by shorter ones.
Q, SHORT_Q = 8, 5
#: Edits allowed, as a share of the benchmark item's characters.
EDIT_RATE = 0.1
#: Benchmark characters that are broadcast at once; a larger benchmark is taken in as many passes.
BLOCK_CHARS = 16_000_000
#: Text is looked through in chunks of so many characters, which overlap by more than the longest region.
CHUNK = 500_000
#: Matches of q-grams that are looked at at once, and regions whose alignment is remembered.
MATCHES = 1 << 20
VERIFIED = 1 << 16
_LEADING_BITS = 20
_BASE = 0x9E3779B97F4A7C15


def normalize(text: str) -> str:
    """Lower case, white space collapsed to one space, ends trimmed."""
    return " ".join(text.lower().split())


def _normalize_at(text: str) -> tuple[str, list[int]]:
    """normalize() and, for each of its characters, where it stands in the text."""
    out, at = [], []
    for m in re.finditer(r"\S+", text):
        if out:
            out.append(" ")
            at.append(m.start() - 1)
        for i, c in enumerate(m[0], m.start()):
            low = c.lower()
            out.append(low)
            at.extend([i] * len(low))
    return "".join(out), at


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def _qgrams(codes: np.ndarray, q: int = Q) -> np.ndarray:
    """Hash of each q-gram."""
    n = len(codes) - q + 1
    h = np.zeros(n, np.uint64)
    for i in range(q):
        h = (h * np.uint64(_BASE)) + codes[i : i + n]
    return h ^ (h >> np.uint64(29))


def edit_budget(length: int, rate: float = EDIT_RATE) -> int:
    """Edits allowed: the rate's share of an item's characters, as far as the q-gram lemma asks for one shared q-gram at least, which up to a rate
    of 0.1 is no limit."""
    return max(0, min(int(length * rate + 1e-9), (length - SHORT_Q) // SHORT_Q))


def _q_of(length: int, budget: int) -> int:
    """The longer q if some q-gram is left by all edits of the budget, else the shorter."""
    return Q if length - Q + 1 - Q * budget >= 1 else SHORT_Q


def banded_alignment(item: np.ndarray, region: np.ndarray, budget: int) -> tuple[int, int, int] | None:
    """(edits, start, end) of the part of region nearest to item within budget (fewest edits, then earliest end), or None.

    Rows are the item's characters. Each row keeps the diagonals of the region only; runs of insertions are closed by a
    running minimum. Starts are free, and travel with the edits as their low part."""
    m, width = len(item), len(region) - len(item) + 1 + 2 * budget
    if width <= 0:
        return None
    big = np.int64(1) << 62
    unit = np.int64(1) << 31  # starts are below it, so regions of up to two thousand million characters fit
    padded = np.full(len(region) + 2 * (budget + 2) + m, -1, np.int64)
    shift = budget + 1
    padded[shift : shift + len(region)] = region
    columns = np.arange(width + 2) - shift  # column j = i + columns before row i
    cells = np.where((columns >= 0) & (columns <= len(region)), columns.astype(np.int64), big)
    slope = np.arange(width + 2, dtype=np.int64) * unit
    for i in range(m):
        here = padded[i : i + width + 2]
        same = cells + np.where(here == item[i], 0, unit)
        above = np.r_[cells[1:], big] + unit
        row = np.minimum(same, above)
        j = columns + i + 1
        row = np.where((j >= 0) & (j <= len(region)), row, big)
        cells = np.minimum.accumulate(row - slope) + slope
        if cells.min() >= (budget + 1) * unit:
            return None
    j = columns + m
    cells = np.where((j >= 0) & (j <= len(region)), cells, big)
    best = int(np.argmin(cells >> 31))
    edits, start = int(cells[best] >> 31), int(cells[best] & (unit - 1))
    return (edits, start, int(j[best])) if edits <= budget else None


class BenchmarkIndex:
    """The q-grams of a bounded block of benchmark items, by q."""

    def __init__(self, items: list[tuple[int, str]], rate: float = EDIT_RATE):
        self.items = [(i, t) for i, t in ((i, normalize(t)) for i, t in items) if t]
        self.codes = [_codes(t) for _, t in self.items]
        self.budget = np.array([edit_budget(len(c), rate) for c in self.codes], np.int64)
        self.length = np.array([len(c) for c in self.codes], np.int64)
        q = np.array([_q_of(n, b) for n, b in zip(self.length.tolist(), self.budget.tolist(), strict=True)], np.int64)
        self.short = np.flatnonzero(self.length < q).tolist()
        self.need = self.length - q + 1 - q * self.budget
        self.grams = {x: Postings(self, x, np.flatnonzero((q == x) & (self.length >= x))) for x in (Q, SHORT_Q)}
        self.overlap = int((self.length + 4 * self.budget + 2 * Q).max(initial=0)) + 2

    def find(self, text: str) -> dict[int, tuple[int, int, int]]:
        """Item place -> (edits, start, end) of its best region in normalised text. Of an item that has been found without an edit nothing later is
        better, so it is not looked for any more."""
        found: dict[int, tuple[int, int, int]] = {}
        chunk = max(CHUNK, 4 * self.overlap)
        for at in range(0, max(1, len(text)), chunk):
            part = text[at : at + chunk + self.overlap]
            codes = _codes(part)
            for k in self.short:
                if k not in found and (i := part.find(self.items[k][1])) >= 0:
                    found[k] = (0, at + i, at + i + int(self.length[k]))
            for postings in self.grams.values():
                verified: dict[tuple[int, str], tuple[int, int, int] | None] = {}  # what a repetitive text says again and again is aligned once
                for met in postings.meet(codes, self.overlap):
                    for k, (edits, start, end) in self._banded(part, codes, found, verified, *met):
                        hit = (edits, at + start, at + end)
                        if k not in found or hit < found[k]:
                            found[k] = hit
        return found

    def _banded(self, text: str, codes: np.ndarray, found: dict, verified: dict, where: np.ndarray, owner: np.ndarray, place: np.ndarray) -> Iterator[tuple[int, tuple[int, int, int]]]:
        """Regions of the items `owner` whose q-grams at `place` stand at `where`, by item and from the left."""
        done = [k for k, hit in found.items() if hit[0] == 0]
        if done and len(where):
            open_ = ~np.isin(owner, done)
            where, owner, place = where[open_], owner[open_], place[open_]
        if not len(where):
            return
        band = np.floor_divide(where - place, self.budget[owner] + 1)
        names, own = np.unique(owner, return_inverse=True)
        # bands are two steps wide and overlap by one: diagonals that drift by a step at most share a band
        low, bands, places = int(band.min()) - 1, int(band.max() - band.min()) + 2, int(place.max()) + 1
        key = own * bands + (band - low)
        if len(names) * bands * places < 1 << 62:
            met = np.concatenate([key * places + place, (key - 1) * places + place])
            met.sort()
            met = met[np.concatenate([[True], met[1:] != met[:-1]])] // places
        else:
            order = np.lexsort((np.tile(place, 2), both := np.concatenate([key, key - 1])))
            both, twice = both[order], np.tile(place, 2)[order]
            met = both[np.concatenate([[True], (both[1:] != both[:-1]) | (twice[1:] != twice[:-1])])]
        # a frequent q-gram may meet the same place of the item again and again: only different places count
        first = np.flatnonzero(np.concatenate([[True], met[1:] != met[:-1]]))
        keys, shared = met[first], np.diff(np.append(first, len(met)))
        k, b = names[keys // bands], keys % bands + low
        keep = shared >= self.need[k]
        for k, b in zip(k[keep].tolist(), b[keep].tolist(), strict=True):
            if k in found and found[k][0] == 0:
                continue
            budget = int(self.budget[k])
            start = max(0, b * (budget + 1) - budget)
            end = min(len(codes), (b + 2) * (budget + 1) + int(self.length[k]) + budget)
            if end > start:
                region = (k, text[start:end])
                if region not in verified:
                    if len(verified) >= VERIFIED:
                        verified.clear()
                    verified[region] = self._verify(k, codes[start:end], region[1])
                if hit := verified[region]:
                    yield k, (hit[0], start + hit[1], start + hit[2])

    def _verify(self, k: int, region: np.ndarray, text: str) -> tuple[int, int, int] | None:
        if (at := text.find(self.items[k][1])) >= 0:
            return 0, at, at + int(self.length[k])
        return banded_alignment(self.codes[k], region, int(self.budget[k]))


class Postings:
    """Sorted q-grams of some items, with the item and the place of each."""

    def __init__(self, index: BenchmarkIndex, q: int, chosen: np.ndarray):
        self.q = q
        grams = [_qgrams(index.codes[k], q) for k in chosen]
        owner = np.repeat(chosen, [len(g) for g in grams])
        place = np.concatenate([np.arange(len(g)) for g in grams]) if grams else np.empty(0, np.int64)
        gram = np.concatenate(grams) if grams else np.empty(0, np.uint64)
        # q-grams that many items share say little: an item leaves out its most frequent ones, and needs so many fewer of the rest
        _, which, often = np.unique(gram, return_inverse=True, return_counts=True)
        frequency = often[which] if len(gram) else np.empty(0, np.int64)
        kept = np.ones(len(gram), bool)
        for k, at in zip(chosen, np.split(np.arange(len(gram)), np.cumsum([len(g) for g in grams])[:-1]) if grams else (), strict=True):
            worst = at[np.argsort(-frequency[at], kind="stable")[: max(0, int(index.need[k]) // 2)]]
            worst = worst[frequency[worst] > 1]
            kept[worst] = False
            index.need[k] -= len(worst)
        order = np.flatnonzero(kept)[np.argsort(gram[kept], kind="stable")]
        self.gram, self.owner, self.place = gram[order], owner[order].astype(np.int64), place[order].astype(np.int64)
        # where the q-grams of each leading bits begin
        self.first = np.searchsorted(self.gram >> np.uint64(64 - _LEADING_BITS), np.arange((1 << _LEADING_BITS) + 1, dtype=np.uint64)).astype(np.int32) if len(order) else None

    def meet(self, codes: np.ndarray, overlap: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(place in the text, item, place in the item) of every q-gram that both have, in parts of the text with about MATCHES of them, which
        overlap by the longest region."""
        if self.first is None or len(codes) < self.q:
            return
        grams = _qgrams(codes, self.q)
        lead = (grams >> np.uint64(64 - _LEADING_BITS)).astype(np.int32)
        lows = self.first[lead]
        counts = self.first[lead + 1] - lows
        upto = np.concatenate([[0], np.cumsum(counts, dtype=np.int64)])
        at = 0
        while at < len(grams):
            stop = min(len(grams), max(at + 2 * overlap, int(np.searchsorted(upto, upto[at] + MATCHES))))
            where = at + np.flatnonzero(counts[at:stop])
            low, count = lows[where].astype(np.int64), counts[where].astype(np.int64)
            post = np.repeat(low - np.r_[0, np.cumsum(count)[:-1]], count) + np.arange(count.sum()) if len(count) else np.empty(0, np.int64)
            where = np.repeat(where, count)
            same = self.gram[post] == grams[where]
            yield where[same], self.owner[post[same]], self.place[post[same]]
            at = stop - overlap if stop < len(grams) else stop


def _blocks(benchmark: DataFrame) -> Iterator[list[tuple[int, str]]]:
    """The items in blocks of BLOCK_CHARS characters at most, or of one item."""
    held, chars = [], 0
    for row in benchmark.where("text is not null").select("item_id", "text").toLocalIterator():
        if held and chars + len(row.text) > BLOCK_CHARS:
            yield held
            held, chars = [], 0
        held.append((row.item_id, row.text))
        chars += len(row.text)
    if held:
        yield held


def find_contamination(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", rate: float = EDIT_RATE) -> DataFrame:
    """(key, text) x (item_id, text) -> key, item_id, edits, start, end, item_chars: each pair of which the whole item stands in the
    document within `rate` of its characters in edits, at its best region (fewest edits, then first).

    Case and white space don't count; start and end are code points of the text as it is, end exclusive. Items shorter than 10
    characters allow no edit at a rate of 0.1; empty or null items and texts match nothing. Repeated rows give repeated pairs. The
    benchmark is broadcast in blocks of a bounded size, a pass over the documents for each; the documents aren't shuffled."""
    spark = docs.sparkSession
    schema = f"{key} {docs.schema[key].dataType.simpleString()}, item_id {benchmark.schema['item_id'].dataType.simpleString()}, edits int, start long, end long, item_chars int"
    found = None
    for items in _blocks(benchmark):
        shared = spark.sparkContext.broadcast(BenchmarkIndex(items, rate))

        def look(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            index = shared.value
            for batch in batches:
                rows = []
                for doc, text in zip(batch[key], batch.text, strict=True):
                    if text and (hits := index.find(normalize(text))):
                        at = _normalize_at(text)[1]
                        rows += [(doc, index.items[k][0], e, at[a], at[b - 1] + 1, int(index.length[k])) for k, (e, a, b) in hits.items()]
                yield pd.DataFrame(rows, columns=[key, "item_id", "edits", "start", "end", "item_chars"])

        hits = docs.select(key, "text").mapInPandas(look, schema)
        found = hits if found is None else found.union(hits)
    return spark.createDataFrame([], schema) if found is None else found


def decontaminate(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id") -> DataFrame:
    """The rows of docs whose key has no benchmark item in it; rows of a null key stay if no null-key row is hit. The hit keys are
    written first, so that Spark knows their size and broadcasts them below its limit only, while workers are handed few texts at a time."""
    with small_batches(docs.sparkSession, TEXTS_AT_ONCE):
        hit = materialize(find_contamination(docs, benchmark, key).select(F.col(key).alias("__hit")).distinct(), "hits")
    return docs.join(hit, docs[key].eqNullSafe(hit["__hit"]), "left_anti")


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every pair of a document and a benchmark item that it holds."""
    return find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
