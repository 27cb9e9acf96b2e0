"""Operator 12: n-gram language-model scores from a trie of Elias-Fano levels, built in parts by Spark and read through memory maps."""

from __future__ import annotations

import os
import re
import uuid
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyarrow import fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, materialize, plus, table
from .elias_fano import EliasFano, encode

ORDER = 3
#: What is taken off the count of each n-gram seen, for what has not been seen.
DISCOUNT = 0.75
#: Of a word's count, for words that training did not see.
ADDED = 0.5
#: A stored probability is 10 ** (-code * STEP), code a 16-bit number.
STEP = 2e-4
#: Bytes of text that are worked on at once; training tokens, and different words, that a part of the trie holds, about.
CHUNK_BYTES = 1 << 22
SHARD_TOKENS = 1 << 21
SHARD_WORDS = 1 << 20
HASH_SEED = 42
#: Files that a worker holds open.
OPEN = 128
_SPACE = re.compile(rb"[\x20\x09-\x0D]")
#: No words: they hold white space.
END, BEGIN = b"\n", b"\r"


# files -------------------------------------------------------------------------------------------------------------------


def _store(base: str) -> tuple[pafs.FileSystem, str]:
    if "://" not in base and not base.startswith("file:"):
        return pafs.LocalFileSystem(), base
    return pafs.FileSystem.from_uri(base)


def write_level(base: str, name: str, arrays: dict[str, np.ndarray]) -> None:
    """The arrays one after another in one file, 64 bytes aligned, with their places ahead. It appears as a whole, so a task that runs again
    writes the same again."""
    head, at = [], 0
    for key, x in arrays.items():
        head.append(f"{key} {x.dtype.str} {len(x)} {at}")
        at += x.nbytes + -x.nbytes % 64
    first = "\n".join(head).encode()
    first += b"\n" * (-(len(first) + 8) % 64)
    store, path = _store(base)
    store.create_dir(path, recursive=True)
    part = f"{path}/.{name}-{uuid.uuid4().hex}"
    with store.open_output_stream(part) as out:
        out.write(len(first).to_bytes(8, "little") + first)
        for x in arrays.values():
            out.write(np.ascontiguousarray(x).tobytes() + bytes(-x.nbytes % 64))
    store.move(part, f"{path}/{name}")


@lru_cache(OPEN)
def read_level(base: str, name: str) -> dict[str, np.ndarray] | None:
    """The arrays of a file as views of a memory map; None if there is no such file. A store that cannot be mapped is read as it is."""
    store, path = _store(base)
    if isinstance(store, pafs.LocalFileSystem):
        if not os.path.exists(f"{path}/{name}"):
            return None
        data = np.memmap(f"{path}/{name}", np.uint8, "r").view(np.ndarray)
    else:
        if store.get_file_info(f"{path}/{name}").type == pafs.FileType.NotFound:
            return None
        with store.open_input_file(f"{path}/{name}") as f:
            data = np.frombuffer(f.read(), np.uint8)
    size = int(data[:8].view("<u8")[0])
    found = {}
    words = bytes(data[8 : 8 + size]).decode().split()
    for key, kind, n, at in zip(*(words[i::4] for i in range(4)), strict=True):
        kind, start = np.dtype(kind), 8 + size + int(at)
        found[key] = data[start : start + int(n) * kind.itemsize].view(kind)
    return found


def _named(name: str, arrays: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    return {f"{name}.{k}": x for k, x in arrays.items()}


@lru_cache(16 * OPEN)
def _sequence(base: str, file: str, name: str) -> EliasFano:
    arrays = read_level(base, file)
    return EliasFano({k: arrays[f"{name}.{k}"] for k in ("meta", "low", "high", "ones", "zeros")})


# tokens ------------------------------------------------------------------------------------------------------------------


def token_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter((xxhash.xxh64_intdigest(w, HASH_SEED) for w in words), np.uint64, len(words))


class Chunk:
    """Tokens of several texts, or of a piece of one: the different words, and for each token its place among these, the text it is of, whether it is
    counted here or only goes ahead of those that are, and whether a text or piece begins with it."""

    def __init__(self, texts: pa.Array, row: int, ahead: list[bytes], ended: bool):
        """texts: whole, or the next piece of text `row`, behind the tokens `ahead`; ended: whether the end belongs to it."""
        lists = pc.ascii_split_whitespace(pc.ascii_lower(texts))
        coded = lists.flatten().dictionary_encode()
        place = coded.indices.to_numpy().astype(np.int64)
        some = pc.not_equal(coded.dictionary, "").to_numpy(zero_copy_only=False)[place] if len(place) else np.zeros(0, bool)
        ends = np.searchsorted(np.flatnonzero(some), lists.offsets.to_numpy() - lists.offsets[0].as_py())
        place, n, extra = place[some], np.diff(ends), len(ahead) + ended
        self.words = [*coded.dictionary.cast(pa.binary()).to_pylist(), *ahead, END]
        starts = np.concatenate([[0], np.cumsum(n + extra)])
        self.token = np.full(int(starts[-1]), len(self.words) - 1)
        self.counted, self.starts = np.ones(len(self.token), bool), np.zeros(len(self.token), bool)
        self.starts[starts[:-1]] = True
        for i in range(len(ahead)):
            self.token[starts[:-1] + i] = len(coded.dictionary) + i
            self.counted[starts[:-1] + i] = False
        self.token[np.repeat(starts[:-1] + len(ahead) - ends[:-1], n) + np.arange(len(place))] = place
        self.row = np.repeat(np.arange(row, row + len(n)), n + extra)

    def last(self, n: int) -> list[bytes]:
        return [self.words[i] for i in self.token[len(self.token) - n :]] if n else []


def pieces(text: bytes, most: int) -> Iterator[bytes]:
    """The text cut at white space into pieces of `most` bytes, or longer for a word that is."""
    at = 0
    while at < len(text):
        gap = _SPACE.search(text, at + most)
        end = gap.start() if gap else len(text)
        yield text[at:end]
        at = end


def chunks(texts: pa.Array, order: int) -> Iterator[Chunk]:
    """The texts (string, no nulls) in chunks of about CHUNK_BYTES. A text longer than that comes in pieces, each behind the order - 1 tokens before."""
    sizes = pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)
    at = 0
    while at < len(sizes):
        if sizes[at] > CHUNK_BYTES:
            parts, ahead = list(pieces(texts[at].as_py().encode("utf-8", "surrogatepass"), CHUNK_BYTES)), [BEGIN]
            for i, part in enumerate(parts):
                chunk = Chunk(pa.array([part], pa.binary()).cast(pa.string()), at, ahead, i == len(parts) - 1)
                ahead = chunk.last(min(order - 1, len(chunk.token)))
                yield chunk
            at += 1
        else:
            stop = at + max(1, int(np.searchsorted(np.cumsum(sizes[at:]), CHUNK_BYTES, "right")))
            yield Chunk(texts.slice(at, stop - at), at, [BEGIN], True)
            at = stop


# vocabulary --------------------------------------------------------------------------------------------------------------


class Vocabulary:
    """Words by their 64-bit hashes, in parts by the hashes' first bits: a word's number is its hash's place in the order of all. Counts are
    stored as running sums, so both sequences are monotone."""

    def __init__(self, base: str, bits: int, parts: list[tuple[int, int, int]], texts: int):
        """parts: (part, words, tokens) of each; texts: how often a text begins."""
        self.base, self.bits, self.texts = base, bits, texts
        self.first = np.zeros((1 << bits) + 1, np.int64)
        self.sum = np.zeros((1 << bits) + 1, np.int64)
        for part, words, tokens in parts:
            self.first[part + 1], self.sum[part + 1] = words, tokens
        self.first, self.sum = np.cumsum(self.first), np.cumsum(self.sum)
        self.size, self.tokens = int(self.first[-1]), int(self.sum[-1])
        self.begin, self.unknown, self.range = self.size, self.size + 1, self.size + 2

    def numbers(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Number, count, and sum of the counts of all words before, of each word."""
        hashes = token_hashes(words)
        part = _part_of(hashes, self.bits)
        number, count, before = np.full(len(words), self.unknown), np.zeros(len(words), np.int64), np.full(len(words), self.tokens)
        order = np.argsort(part, kind="stable")
        for at in np.split(order, np.flatnonzero(np.diff(part[order])) + 1):
            p = int(part[at[0]]) if len(at) else 0
            if len(at) and self.first[p + 1] > self.first[p]:
                own = _sequence(self.base, f"words-{p}", "hash")
                place, there = own.successor(_rest_of(hashes[at], self.bits), np.zeros(len(at), np.int64), np.full(len(at), own.n))
                at, place = at[there], place[there]
                sums = _sequence(self.base, f"words-{p}", "sum")
                low = sums.get(place).astype(np.int64)
                number[at], before[at], count[at] = self.first[p] + place, self.sum[p] + low, sums.get(place + 1).astype(np.int64) - low
        begins = np.array([w == BEGIN for w in words], bool)
        number[begins], count[begins] = self.begin, self.texts
        return number, count, before


def _part_of(hashes: np.ndarray, bits: int) -> np.ndarray:
    return (hashes >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(hashes), np.int64)


def _rest_of(hashes: np.ndarray, bits: int) -> np.ndarray:
    return hashes & np.uint64((1 << (64 - bits)) - 1)


def build_vocabulary(texts: DataFrame, base: str, scratch: Scratch) -> Vocabulary:
    """Count the words of texts (text) and write their levels to `base`. The driver gets a row for each part."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in chunks(batch.column("text"), 1):
                n = np.bincount(chunk.token[chunk.counted], minlength=len(chunk.words))
                some = np.flatnonzero(n)
                yield pa.RecordBatch.from_arrays([pa.array(token_hashes([chunk.words[i] for i in some]).view(np.int64)), pa.array(n[some])], ["hash", "n"])

    counts = scratch.keep(texts.mapInArrow(count, "hash long, n long").groupBy("hash").agg(F.sum("n").alias("n")), "words")
    size = counts.count()
    bits = max(0, (max(1, size // SHARD_WORDS)).bit_length() - 1)

    def write(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        hashes = frame["hash"].to_numpy(np.int64).view(np.uint64)
        order = np.argsort(hashes)
        n = frame["n"].to_numpy(np.int64)[order]
        sums = np.concatenate([[0], np.cumsum(n)])
        write_level(base, f"words-{key[0]}", _named("hash", encode(_rest_of(hashes[order], bits))) | _named("sum", encode(sums)))
        return pd.DataFrame({"part": [key[0]], "words": [len(n)], "tokens": [int(n.sum())]})

    part = F.expr(f"shiftrightunsigned(hash, {64 - bits})").cast("long") if bits else F.lit(0).cast("long")
    parts = counts.withColumn("part", part).groupBy("part").applyInPandas(write, "part long, words long, tokens long").collect()
    return Vocabulary(base, bits, [tuple(r) for r in parts], texts.count())


# n-grams -----------------------------------------------------------------------------------------------------------------


class Grams:
    """The different n-grams of a chunk, level by level. word: number of each different word; at level k, parent[k] is the place at level k - 1 of what an
    n-gram begins with, last[k] its last word's number, n[k] how often it is counted here, spot[k] a token it ends at; place[k] the n-gram that ends
    at each token, -1 where the text has begun too shortly before."""

    def __init__(self, chunk: Chunk, vocabulary: Vocabulary, order: int):
        self.row, self.counted = chunk.row, chunk.counted
        numbers, counts, before = vocabulary.numbers(chunk.words)
        self.word, first, own = np.unique(numbers, return_index=True, return_inverse=True)
        self.count, self.before, self.order = counts[first], before[first], order
        place = own[chunk.token]
        self.place, self.parent, self.last, self.n, self.spot = {1: place}, {}, {}, {}, {}
        number = self.word[place]
        for k in range(2, order + 1):
            ahead = np.concatenate([[-1], self.place[k - 1][:-1]])
            ahead[chunk.starts] = -1
            some = np.flatnonzero(ahead >= 0)
            keys, spot, back = np.unique(ahead[some] * vocabulary.range + number[some], return_index=True, return_inverse=True)
            self.parent[k], self.last[k], self.spot[k] = keys // vocabulary.range, keys % vocabulary.range, some[spot]
            self.n[k] = np.bincount(back, weights=self.counted[some], minlength=len(keys)).astype(np.int64)
            self.place[k] = np.full(len(place), -1)
            self.place[k][some] = back


def _shard_at(before: np.ndarray, count: np.ndarray, inner: np.ndarray, vocabulary: Vocabulary, shards: int) -> np.ndarray:
    """The part of the trie with the n-grams that begin with a word (its count and the sum before it) and another (the sum before it): parts have like
    numbers of tokens, and a frequent first word has several."""
    at = (before + count * (inner / max(vocabulary.tokens, 1))) / (vocabulary.tokens + vocabulary.texts + 1)
    return np.minimum((at * shards).astype(np.int64), shards - 1)


def _shards_of(grams: Grams, vocabulary: Vocabulary, shards: int) -> np.ndarray:
    """The part of each two words."""
    first, second = grams.parent[2], grams.place[1][grams.spot[2]]
    return _shard_at(grams.before[first], grams.count[first], grams.before[second], vocabulary, shards)


def _packed(arrays: list[np.ndarray]) -> bytes:
    """Arrays of whole numbers from 0 as bytes: the lowest bytes of all, then the next, so that what is always 0 takes no room."""
    parts = []
    for x in arrays:
        width = max(1, (int(x.max()).bit_length() + 7) // 8) if len(x) else 1
        body = x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes()
        parts.append(np.array([len(x), width], "<u8").tobytes() + body)
    return zstandard.ZstdCompressor(level=1).compress(b"".join(parts))


def _unpacked(data: bytes) -> list[np.ndarray]:
    data, out, at = zstandard.ZstdDecompressor().decompress(data), [], 0
    while at < len(data):
        n, width = np.frombuffer(data, "<u8", 2, at).tolist()
        wide = np.zeros((n, 8), np.uint8)
        wide[:, :width] = np.frombuffer(data, np.uint8, n * width, at + 16).reshape(width, n).T
        out.append(wide.view("<u8").ravel().astype(np.int64))
        at += 16 + n * width
    return out


def gram_counts(texts: DataFrame, vocabulary: Vocabulary, order: int, shards: int) -> DataFrame:
    """(shard, grams): the counts of the n-grams of texts (text), packed; a row for each chunk and part of the trie."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in chunks(batch.column("text"), order):
                grams = Grams(chunk, vocabulary, order)
                own = _shards_of(grams, vocabulary, shards)
                by = np.argsort(own, kind="stable")
                rows = []
                for at in np.split(by, np.flatnonzero(np.diff(own[by])) + 1):
                    arrays, held = [grams.word[grams.parent[2][at]], grams.last[2][at], grams.n[2][at]], at
                    for k in range(3, order + 1):
                        new = np.full(len(grams.last[k - 1]), -1)
                        new[held] = np.arange(len(held))
                        inside = np.flatnonzero(new[grams.parent[k]] >= 0) if k > 3 else _children(grams.parent[3], held)
                        arrays += [new[grams.parent[k][inside]], grams.last[k][inside], grams.n[k][inside]]
                        held = inside
                    rows.append((int(own[at[0]]), _packed(arrays)))
                yield pa.RecordBatch.from_arrays([pa.array([s for s, _ in rows], pa.int64()), pa.array([g for _, g in rows], pa.binary())], ["shard", "grams"])

    return texts.mapInArrow(count, "shard long, grams binary")


def _children(parent: np.ndarray, chosen: np.ndarray) -> np.ndarray:
    """Places whose parent, sorted, is one of the chosen."""
    lo, hi = np.searchsorted(parent, chosen), np.searchsorted(parent, chosen, "right")
    return np.repeat(lo - np.cumsum(np.concatenate([[0], (hi - lo)[:-1]])), hi - lo) + np.arange((hi - lo).sum())


def _codes(p: np.ndarray) -> np.ndarray:
    return np.clip(np.rint(-np.log10(np.maximum(p, 1e-300)) / STEP), 0, 65535).astype(np.uint16)


def _values(codes: np.ndarray) -> np.ndarray:
    return 10.0 ** (-STEP * codes)


def _children_level(groups: np.ndarray, last: np.ndarray, n_groups: int) -> dict[str, np.ndarray]:
    """Pointers to each group's children, and the children's last words made monotone: each group's stand above the last of the group before."""
    ends = np.searchsorted(groups, np.arange(n_groups + 1))
    full = np.flatnonzero(np.diff(ends))
    tops = np.concatenate([[0], np.cumsum(last[ends[full + 1] - 1])[:-1]]) if len(full) else np.zeros(0, np.int64)
    raised = last + np.repeat(tops, np.diff(ends)[full])
    return _named("pointer", encode(ends)) | _named("word", encode(raised))


def write_shard(base: str, shard: int, packed: list[bytes], vocabulary: Vocabulary, order: int) -> None:
    """Merge the packed counts of a part, smooth and quantise them, and write its levels."""
    blobs = [_unpacked(x) for x in packed]
    first = np.concatenate([b[0] for b in blobs])
    roots, up = np.unique(first, return_inverse=True)
    above = _counts_at(vocabulary, roots)
    write_level(base, f"roots-{shard}", _named("root", encode(roots)))
    places: list[np.ndarray] = []
    for k in range(2, order + 1):
        last = np.concatenate([b[3 * (k - 2) + 1] for b in blobs])
        n = np.concatenate([b[3 * (k - 2) + 2] for b in blobs])
        if k > 2:
            up = np.concatenate([own[b[3 * (k - 2)]] for own, b in zip(places, blobs, strict=True)]) if len(last) else np.zeros(0, np.int64)
        keys, back = np.unique(up * vocabulary.range + last, return_inverse=True)
        total = np.bincount(back, weights=n, minlength=len(keys))
        group, word = keys // vocabulary.range, keys % vocabulary.range
        kinds = np.bincount(group, minlength=len(above))
        if k > 2:  # what is left of a context for words not seen after it
            write_level(base, f"rest-{k - 1}-{shard}", {"code": np.where(kinds > 0, _codes(DISCOUNT * kinds / np.maximum(above, 1)), 0).astype(np.uint16)})
        write_level(base, f"level-{k}-{shard}", _children_level(group, word, len(above)) | {"code": _codes(np.maximum(total - DISCOUNT, 1e-12) / np.maximum(above[group], 1))})
        places = np.split(back, np.cumsum([len(b[3 * (k - 2) + 1]) for b in blobs])[:-1])
        above = total


def _counts_at(vocabulary: Vocabulary, numbers: np.ndarray) -> np.ndarray:
    """The counts of words by their numbers."""
    out = np.full(len(numbers), float(vocabulary.texts))
    part = np.searchsorted(vocabulary.first, numbers, "right") - 1
    for p in np.unique(part[numbers < vocabulary.size]):
        at = np.flatnonzero((part == p) & (numbers < vocabulary.size))
        sums, place = _sequence(vocabulary.base, f"words-{p}", "sum"), numbers[at] - vocabulary.first[p]
        out[at] = (sums.get(place + 1) - sums.get(place)).astype(float)
    return out


def build_trie(texts: DataFrame, vocabulary: Vocabulary, order: int, shards: int) -> None:
    """Count the n-grams of texts (text) and write the trie's parts to the vocabulary's folder, each by a task of its own."""

    def write(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packed = [g for batch in batches for g in batch.column("grams").to_pylist()]
        write_shard(vocabulary.base, key[0].as_py(), packed, vocabulary, order)
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int64())], ["shard"])

    gram_counts(texts, vocabulary, order, shards).groupBy("shard").applyInArrow(write, "shard long").write.format("noop").mode("overwrite").save()


# scores ------------------------------------------------------------------------------------------------------------------


class Trie:
    """The parts of the trie that a worker reads, by memory maps."""

    def __init__(self, vocabulary: Vocabulary, order: int, shards: int):
        self.vocabulary, self.order, self.shards = vocabulary, order, shards

    def _found(self, file: str, groups: np.ndarray, word: np.ndarray) -> np.ndarray:
        """Place of the child `word` of each group, -1 without: the successor, among the group's places, of the word raised as its group is."""
        base = self.vocabulary.base
        pointer, words = _sequence(base, file, "pointer"), _sequence(base, file, "word")
        own, back = np.unique(groups, return_inverse=True)
        lo, hi = pointer.get(own).astype(np.int64), pointer.get(own + 1).astype(np.int64)
        raised = np.zeros(len(own), np.uint64)
        raised[lo > 0] = words.get(lo[lo > 0] - 1)
        place, there = words.successor(raised[back] + word.astype(np.uint64), lo[back], hi[back])
        return np.where(there, place, -1)

    def chances(self, grams: Grams) -> dict[int, np.ndarray]:
        """The probability of the last word of each n-gram after the words before it, by level."""
        base, v = self.vocabulary.base, self.vocabulary
        p = {1: (grams.count + ADDED) / (v.tokens + ADDED * (v.size + 1))}
        seen = {k: np.zeros(len(grams.last[k])) for k in range(2, self.order + 1)}
        left = {k: np.ones(len(grams.last[k]) if k > 1 else len(grams.word)) for k in range(1, self.order)}
        if self.order > 1:
            kinds = np.zeros(len(grams.word), np.int64)
            known = np.flatnonzero((grams.word != v.unknown) & (grams.count > 0))
            zero = np.zeros(len(known), np.int64)
            from_, to = (_shard_at(grams.before[known], grams.count[known], zero + x, v, self.shards) for x in (0, v.tokens))
            own = _shards_of(grams, v, self.shards)
            own[grams.word[grams.parent[2]] == v.unknown] = -1
            by, spans = np.argsort(own, kind="stable"), np.argsort(from_, kind="stable")
            wide = known[to > from_]
            low, high = from_[to > from_], to[to > from_]
            node = {k: np.full(len(grams.last[k]) if k > 1 else len(grams.word), -1) for k in range(1, self.order)}
            for s in range(self.shards):
                if read_level(base, f"roots-{s}") is None:
                    continue
                roots = _sequence(base, f"roots-{s}", "root")
                pointer = _sequence(base, f"level-2-{s}", "pointer")
                inside = known[spans[slice(*np.searchsorted(from_[spans], (s, s + 1)))]]
                asked = np.union1d(inside, wide[(low < s) & (high >= s)])
                root, there = roots.successor(grams.word[asked], np.zeros(len(asked), np.int64), np.full(len(asked), roots.n))
                node[1][asked] = np.where(there, root, -1)
                asked, root = asked[there], root[there]
                kinds[asked] += (pointer.get(root + 1) - pointer.get(root)).astype(np.int64)
                at = by[slice(*np.searchsorted(own[by], (s, s + 1)))]
                for k in range(2, self.order + 1):
                    above = node[k - 1][grams.parent[k][at]]
                    at, above = at[above >= 0], above[above >= 0]
                    found = self._found(f"level-{k}-{s}", above, grams.last[k][at]) if len(at) else above
                    at, found = at[found >= 0], found[found >= 0]
                    if not len(at):
                        break
                    seen[k][at] = _values(read_level(base, f"level-{k}-{s}")["code"][found])
                    if k < self.order:
                        codes = read_level(base, f"rest-{k}-{s}")["code"][found]
                        left[k][at] = np.where(codes > 0, _values(codes), 1.0)
                        node[k][at] = found
                        at = _children(grams.parent[k + 1], np.sort(at))
            some = kinds > 0
            left[1][some] = DISCOUNT * kinds[some] / grams.count[some]
        for k in range(2, self.order + 1):
            shorter = p[k - 1][grams.place[k - 1][grams.spot[k]]]
            p[k] = np.minimum(1.0, seen[k] + left[k - 1][grams.parent[k]] * shorter)
        return p

    def scores(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """n_tokens, n_known, base_score and score of each text."""
        n, known, plain, score = (np.zeros(len(texts), kind) for kind in (np.int64, np.int64, float, float))
        for chunk in chunks(texts, self.order):
            grams = Grams(chunk, self.vocabulary, self.order)
            p = self.chances(grams)
            best = np.log10(p[1])[grams.place[1]]
            own = best[grams.counted]
            for k in range(2, self.order + 1):
                long = grams.place[k] >= 0
                best[long] = np.log10(p[k])[grams.place[k][long]]
            row = grams.row[grams.counted]
            for out, x in ((n, None), (known, grams.count[grams.place[1]][grams.counted] > 0), (plain, own), (score, best[grams.counted])):
                out += np.bincount(row, weights=x, minlength=len(texts)).astype(out.dtype)
        return n, known, plain, score


def _fold(key: str) -> Column:
    return F.pmod(F.crc32(F.encode(F.col(key).cast("string"), "UTF-8")), F.lit(5))


def score_documents(docs: DataFrame, order: int = ORDER, key: str = "doc_id", folder: str | None = None) -> DataFrame:
    """docs (key, text, ...) -> all columns but text, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Learns from documents whose crc32 of the key as text is not 1 modulo 5; a null key belongs to no fold, is not learned from and not held out. Null
    text is empty and has its end alone. Interpolated absolute discounting over all n-grams of the training tokens, none cut off: what an n-gram's
    count holds above DISCOUNT, and what is left of its context times the probability after one word less; at last the
    contract's base. Without training tokens every token has probability 1.

    Words count by their 64-bit XXH64. Counts meet in parts of the trie, ranges of the first two words of like numbers of tokens, each merged and
    written by one task to a folder of its own below the shared one (`folder`, or the model's own), which the scoring tasks map into memory: nothing
    of the model goes through the driver but a row for each part of the vocabulary. An n-gram's first two words are in one part, however frequent."""
    spark = docs.sparkSession
    with Scratch(spark) as scratch:
        base = folder or scratch.path("trie")
        train = docs.where(_fold(key) != 1).select(F.coalesce(F.col("text"), F.lit("")).alias("text"))
        vocabulary = build_vocabulary(train, base, scratch)
        shards = max(1, -(-vocabulary.tokens // SHARD_TOKENS))
        if order > 1 and vocabulary.tokens:
            build_trie(train, vocabulary, order, shards)
        shared = spark.sparkContext.broadcast(Trie(vocabulary, order, shards))  # its numbers; the levels stay in their files

        @F.arrow_udf("struct<n_tokens:long,n_known:long,base_score:double,score:double>")
        def scored(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            for batch in batches:
                found = shared.value.scores(batch)
                yield pa.StructArray.from_arrays([pa.array(x) for x in found], names=["n_tokens", "n_known", "base_score", "score"])

        out = plus(docs, held_out=F.coalesce(_fold(key) == 1, F.lit(False)), __lm=scored(F.coalesce(F.col("text"), F.lit(""))))
        names = ("n_tokens", "n_known", "base_score", "score")
        out = plus(out, train_tokens=F.lit(vocabulary.tokens).cast("long"), **{c: F.col(f"__lm.{c}") for c in names}).drop("__lm")
        return materialize(out.drop("text"), "scored")  # the levels go with the call


def op12_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log-probabilities of all documents under a trigram model of four fifths of them."""
    out = score_documents(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")
