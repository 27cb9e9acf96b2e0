"""Operator 8: SimHash near-dedup with a Gray-order hierarchical index over the fingerprints."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, plus, table
from .components import LocalForest, connected_components

SHINGLE = 3
HASH_SEED = 42
MAX_BITS = 3
BLOCKS = 4
#: A group of more distinct fingerprints than this is divided again, by blocks of the bits that it doesn't share yet, until so few are left
#: that it can't be larger.
HOT_BLOCK = 8_000
LEAST_BITS = 12
FANOUT = 16
#: Fingerprints that set out on a walk through the index at once, and (fingerprint, node) states that a step takes on at once.
WALK = 20_000
FRONTIER = 1 << 18
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def shingle_hashes(text: str | None, shingle: int = SHINGLE) -> np.ndarray:
    """XXH64 hashes of the text's word shingles, repeats included. A-Z are lower-cased, words are split at ASCII white space; a text of
    fewer words is one shingle, no words give none."""
    import xxhash

    words = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()
    if not words:
        return np.zeros(0, np.uint64)
    shingles = map(b" ".join, zip(*(words[i:] for i in range(shingle)), strict=False)) if len(words) > shingle else [b" ".join(words)]
    return np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(HASH_SEED)), np.uint64)


def majority_bits(hashes: np.ndarray) -> int:
    """64 bits, each set if it is set in over half the hashes; none: 0."""
    count = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        count += np.unpackbits(hashes[at : at + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * count > len(hashes), bitorder="little").view("<u8")[0])


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """The SimHash of a text's shingles; no words give 0."""
    return majority_bits(shingle_hashes(text, shingle))


def fingerprint_column(text: Column, shingle: int = SHINGLE) -> Column:
    """The fingerprint as a signed long; null text has no words."""

    @F.pandas_udf("long")
    def prints(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series(np.array([fingerprint(t, shingle) for t in batch], np.uint64).view(np.int64))

    return prints(text)


class GrayIndex:
    """Fingerprints in Gray order, group by group, under nodes that hold what the fingerprints below share.

    Sorted by Gray rank, neighbours differ in few bits. A node over FANOUT nodes keeps the groups it spans, and the mask and
    pattern of the bits in which all below agree, less those that its parent keeps already; a query adds up its differences on
    the way down and leaves a whole node as soon as they exceed the limit or its own group is not below. If labels are given, it also
    leaves what has but its own label below, so that pairs of one label are not met one by one."""

    def __init__(self, codes: np.ndarray, groups: np.ndarray, labels: np.ndarray | None = None):
        rank = codes.copy()
        for shift in (1, 2, 4, 8, 16, 32):
            rank ^= rank >> np.uint64(shift)
        self.order = np.lexsort((rank, groups))
        self.codes, self.groups = codes[self.order], groups[self.order]
        shared = [(self.codes, self.codes, self.groups, self.groups)]
        while len(shared[-1][0]) > FANOUT:
            ones, any_, low, high = shared[-1]
            starts = np.arange(0, len(ones), FANOUT)
            shared.append((np.bitwise_and.reduceat(ones, starts), np.bitwise_or.reduceat(any_, starts), low[starts], high[np.r_[starts[1:], len(ones)] - 1]))
        self.levels, above = [], None
        for ones, any_, low, high in reversed(shared):
            mask = ~(ones ^ any_)
            new = mask if above is None else mask & ~above[np.arange(len(mask)) // FANOUT]
            self.levels.append((new, ones, low, high))
            above = mask
        self.labels = None if labels is None else labels[self.order]
        self.spans = [] if labels is None else [(self.labels, self.labels)]  # the least and the greatest label below each node
        while self.spans and len(self.spans) < len(self.levels):
            starts = np.arange(0, len(self.spans[0][0]), FANOUT)
            self.spans.insert(0, (np.minimum.reduceat(self.spans[0][0], starts), np.maximum.reduceat(self.spans[0][1], starts)))

    def walk(self, first: np.ndarray, most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(places, places) of all pairs of a place in `first` and a later one of its group that differ in at most `most` bits, in batches. Never
        more than FRONTIER states are carried to the next level, the rest wait."""
        codes, groups = self.codes[first], self.groups[first]
        nodes = np.arange(len(self.levels[0][0]))
        waiting = [(0, np.repeat(np.arange(len(first)), len(nodes)), np.tile(nodes, len(first)), np.zeros(len(first) * len(nodes), np.uint8))]
        while waiting:
            depth, q, node, sum_ = waiting.pop()
            if len(q) > FRONTIER:
                waiting += [(depth, q[at : at + FRONTIER], node[at : at + FRONTIER], sum_[at : at + FRONTIER]) for at in range(0, len(q), FRONTIER)]
                continue
            mask, pattern, low, high = self.levels[depth]
            width = FANOUT ** (len(self.levels) - 1 - depth)
            there = (node < len(mask)) & ((node + 1) * width - 1 > first[q])
            q, node, sum_ = q[there], node[there], sum_[there]
            there = (low[node] <= groups[q]) & (groups[q] <= high[node])
            q, node, sum_ = q[there], node[there], sum_[there]
            if self.spans:
                least, greatest = self.spans[depth]
                there = (least[node] != self.labels[first[q]]) | (greatest[node] != self.labels[first[q]])
                q, node, sum_ = q[there], node[there], sum_[there]
            sum_ = sum_ + np.bitwise_count((codes[q] ^ pattern[node]) & mask[node])
            near = sum_ <= most
            q, node, sum_ = q[near], node[near], sum_[near]
            if depth + 1 == len(self.levels):
                yield first[q], node
                continue
            for at in range(0, len(q), FRONTIER // FANOUT):
                part = slice(at, at + FRONTIER // FANOUT)
                waiting.append((depth + 1, np.repeat(q[part], FANOUT), (node[part, None] * FANOUT + np.arange(FANOUT)).ravel(), np.repeat(sum_[part], FANOUT)))


def link_groups(codes: np.ndarray, reps: np.ndarray, groups: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Links (rep, rep) that join every two codes of a group within `most` bits: a forest, not all pairs."""
    index = GrayIndex(codes, groups)
    forest = LocalForest(len(codes))
    for at in range(0, len(codes), WALK):
        for a, b in index.walk(np.arange(at, min(at + WALK, len(codes))), most):
            forest.add(a, b)
    member, root = forest.links()
    return reps[index.order[member]], reps[index.order[root]]


def _divided(rows: DataFrame, used: int, most: int) -> DataFrame:
    """rows (rep, code, key) of groups that share the low `used` bits of code, one row for each of most + 1 blocks of the other bits: of two codes
    within `most` bits one block is equal. It is turned down next to the used bits, and goes into the key."""
    rest, blocks = 64 - used, most + 1
    edges = [rest * i // blocks for i in range(blocks + 1)]
    low = F.col("code").bitwiseAND(F.lit((1 << used) - 1)) if used else F.lit(0).cast("long")
    high = F.shiftrightunsigned("code", used) if used else F.col("code")
    mask = F.lit((1 << rest) - 1 if used else -1)
    each = []
    for i in range(blocks):
        turned = F.shiftrightunsigned(high, edges[i]).bitwiseOR(F.shiftleft(high, rest - edges[i])).bitwiseAND(mask) if edges[i] else high
        value = turned.bitwiseAND(F.lit((1 << (edges[i + 1] - edges[i])) - 1))
        each.append(F.struct((F.shiftleft(turned, used).bitwiseOR(low) if used else turned).alias("code"), F.xxhash64("key", F.lit(i), value).alias("key")))
    return rows.select("rep", F.explode(F.array(*each)).alias("_s")).select("rep", "_s.code", "_s.key")


def fingerprint_links(classes: DataFrame, most: int = MAX_BITS) -> DataFrame:
    """(fp, rep) of distinct fingerprints -> links (a, b) between reps, whose components are those of all pairs within `most` bits.

    Two such fingerprints are equal in one of most + 1 blocks, so each goes to one group for each of its blocks. A group of
    over HOT_BLOCK is divided by the blocks of its other bits, of which any pair within it also shares one, and so on; groups that share all
    but LEAST_BITS bits can't be larger than 2^LEAST_BITS. So no task sorts a group whose size grows with the data. A task links
    the groups of its partition; it sends a forest, never all pairs."""
    n, used, blocks = classes.count(), 0, most + 1
    rows, done = classes.select("rep", F.col("fp").alias("code"), F.lit(0).cast("long").alias("key")), []
    while True:
        rows, step = _divided(rows, used, most), (64 - used) // blocks
        used += step
        hot = None
        if 64 - used > max(LEAST_BITS, blocks):
            hot = materialize(rows.groupBy("key").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > HOT_BLOCK).select("key"), "hot_blocks")
        if hot is None or hot.isEmpty():
            done.append(rows)
            break
        done.append(rows.join(hot, "key", "left_anti").select("rep", "code", "key"))
        rows = rows.join(hot, "key", "left_semi").select("rep", "code", "key")
    rows = done[0]
    for more in done[1:]:
        rows = rows.union(more)

    def link(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = list(batches)
        if held:
            frame = pd.concat(held)
            a, b = link_groups(frame.code.to_numpy().view(np.uint64), frame.rep.to_numpy(), frame.key.to_numpy(), most)
            yield pd.DataFrame({"a": a, "b": b})

    parts = max(int(classes.sparkSession.conf.get("spark.sql.shuffle.partitions")), n * blocks // 500_000)
    return rows.repartition(parts, "key").mapInPandas(link, "a long, b long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", shingle: int = SHINGLE, most: int = MAX_BITS) -> DataFrame:
    """docs (id_col long, text) -> id_col, fp long, component_id: the smallest id reachable by links between fingerprints that differ in
    at most `most` bits, itself included.

    Equal fingerprints are one class under its smallest id. Null text has no words; its fingerprint is 0 and links like any
    other. A row whose id is null gets the component of its fingerprint and takes part in no smallest id; a fingerprint of
    such rows alone has component null. Repeated rows each get a row. Empty in, empty out."""
    prints = materialize(docs.select(F.col(id_col), fingerprint_column(F.col("text"), shingle).alias("fp")), "fingerprints")
    classes = materialize(prints.where(F.col(id_col).isNotNull()).groupBy("fp").agg(F.min(id_col).cast("long").alias("rep")), "classes")
    found = connected_components(fingerprint_links(classes, most), "simhash")
    labels = classes.join(found.select(F.col("node").alias("rep"), "component"), "rep", "left").select(F.col("fp").alias("_fp"), F.coalesce("component", "rep").alias("component_id"))
    return prints.join(labels, prints.fp == labels._fp, "left").select(id_col, "fp", "component_id")


def keep_one(docs: DataFrame, find=near_duplicates, code=fingerprint_column, **how) -> DataFrame:
    """One row of docs for each component, that of the smallest doc_id, all columns. Of rows of one id one stays; rows of null id go if
    their fingerprint has a row with an id, and else one of each fingerprint stays. The ids that go are written first, so that
    Spark broadcasts them below its own size limit and shuffles beyond."""
    found = find(docs, **how)
    per_id = found.where("doc_id is not null").groupBy("doc_id").agg(F.max(F.col("doc_id") == F.col("component_id")).alias("stays"), F.count(F.lit(1)).alias("n"))
    odd = materialize(per_id.where("not stays or n > 1").select(F.col("doc_id").alias("__odd"), "stays"), "odd_ids")
    single = docs.where("doc_id is not null").join(odd, docs.doc_id == odd["__odd"], "left_anti")
    repeated = docs.join(odd.where("stays"), docs.doc_id == odd["__odd"], "left_semi").dropDuplicates(["doc_id"])
    nameless = plus(docs.where("doc_id is null"), __fp=code(F.col("text"), *[how[k] for k in ("shingle",) if k in how]))
    alone = found.where("doc_id is null and component_id is null").select(F.col("fp").alias("__alone")).distinct()
    nameless = nameless.join(alone, nameless["__fp"] == alone["__alone"], "left_semi").dropDuplicates(["__fp"]).drop("__fp")
    return single.union(repeated).union(nameless)


def op8_simhash_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    out = near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
