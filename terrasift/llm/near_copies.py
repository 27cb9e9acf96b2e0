"""Near copies by Jaccard similarity of word shingles, for the pipeline's near-dedup stage: SimHash fingerprints, searched by Gray-order hierarchical
indexes, and every link verified by whole sets."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .buckets import PAIRS_AT_ONCE, edges, joined, verified
from .common import TEXTS_AT_ONCE, Scratch, bucketed, small_batches
from .components import connected_components
from .simhash import HASH_SEED, GrayIndex, shingle_hashes

SHINGLE = 5
#: Least similarity, as a fraction of whole numbers: shared shingles over all.
SHARED, OF = 4, 5
#: SimHashes of a set, of so many bits each, which meet if MOST bits differ at most. Of two sets of similarity 0.8 a bit differs with probability
#: acos(8/9) / pi = 0.151 at most, one SimHash meets with probability 0.27, one of all with 0.99996; of 4 and 5 shingles, where a bit differs with
#: 0.1875, with 0.993. Two lie in a word of 64 bits, one in either half of it.
TABLES, BITS, MOST = 32, 24, 2
WORDS = TABLES // 2
#: Of two that meet, no more than so many of the bits of the SimHash's word and the next may differ; sets of similarity 0.8 do so with 0.0002.
WORD_FAR = 34
#: SimHashes that are indexed in one job, so that not all rows are on disk at once, and by which sets next to each other are held together first.
TABLES_AT_ONCE, FIRST_TABLES = 8, 4
#: Bands and rows of sketch().
BANDS, ROWS = 24, 5
#: Texts whose results are held at once, and fingerprints that set out on a walk through an index at once.
PART, BLOCK = 500, 2_048
#: Bits of a sketch, each of the smallest hash in a bin of an order: those of two sets of similarity s differ with probability (1 - s) / 2 each. Of
#: two sets of similarity 0.8 more than FAR differ with probability 0.00001, of two of similarity 0.6 FAR or fewer with some 0.0001: it tells
#: whether a pair is worth its whole sets. Of sets of fewer hashes than SURE many bins hold the same one, so these are not told by it.
SKETCH, FAR, SURE = 1024, 146, 64
#: Orders, and bins of each order, whose smallest hashes make up a sketch.
ORDERS, BINS = 16, 64
_MULTIPLIERS = np.random.default_rng(42).integers(0, 1 << 63, ORDERS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_MIX = np.uint64(0x9E3779B97F4A7C15)
_FIRST = np.arange(ORDERS * BINS, dtype=np.uint64) << np.uint64(54)
_NONE = np.uint64((1 << 64) - 1)
#: The bins that an empty bin looks into, one after another.
_PROBES = np.stack([np.random.default_rng(i).permutation(BINS) for i in range(BINS)])
#: Hashes that are put in order at once.
_AT_ONCE = 1 << 14
#: What turns a shingle's hash into one for each word of SimHashes.
_TURNS = np.random.default_rng(7).integers(0, 1 << 63, WORDS, dtype=np.uint64)


def shingle_set(text: str | None) -> np.ndarray:
    """The distinct hashes of the text's shingles, sorted."""
    return np.unique(shingle_hashes(text, SHINGLE))


def set_code_column(text: Column) -> Column:
    """One signed long for the set of a text's shingles; 0 for no words."""

    @F.pandas_udf("long")
    def codes(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series(np.array([_code(shingle_set(t)) for t in batch], np.int64))

    return codes(text)


def _code(hashes: np.ndarray) -> int:
    import xxhash

    return int(np.uint64(xxhash.xxh64_intdigest(hashes.tobytes(), HASH_SEED)).view(np.int64)) if len(hashes) else 0


def minima(hashes: np.ndarray) -> np.ndarray:
    """The smallest hash in each of BINS bins of each of ORDERS orders, an order being that of the hashes times an odd number: by its first bits a hash
    falls into one bin of an order, so a set is put in order once an order and not once a minimum. An empty bin takes what the first of
    the bins that it looks into holds, so that any two sets agree in a bin with the probability of their similarity. At least one hash."""
    least = np.full(ORDERS * BINS, _NONE)
    row = (np.arange(ORDERS, dtype=np.uint64) << np.uint64(60))[:, None]
    for at in range(0, len(hashes), _AT_ONCE):
        placed = np.sort(((hashes[at : at + _AT_ONCE] * _MULTIPLIERS[:, None]) >> np.uint64(4) | row).ravel())
        first = placed[np.minimum(np.searchsorted(placed, _FIRST), len(placed) - 1)]
        least = np.minimum(least, np.where(first >> np.uint64(54) == _FIRST >> np.uint64(54), first, _NONE))
    least = least.reshape(ORDERS, BINS)
    order, bin_ = np.nonzero(least == _NONE)
    full, step = least != _NONE, 0
    while len(order):
        source = _PROBES[bin_, step]
        found = full[order, source]
        least[order[found], bin_[found]] = least[order[found], source[found]]
        order, bin_, step = order[~found], bin_[~found], step + 1
    return least & np.uint64((1 << 54) - 1)


def sketch(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(one key for each band, SKETCH bits as longs), from minima(), which are taken from the orders in turn: a band's key is of ROWS of them, a bit
    of one."""
    least = minima(hashes).T.ravel()
    keys = np.arange(BANDS, dtype=np.uint64) * _MIX
    for row in least[: BANDS * ROWS].reshape(ROWS, BANDS):
        keys = (keys ^ row) * _MIX
        keys ^= keys >> np.uint64(29)
    keys = keys & np.uint64(~31 & (1 << 64) - 1) | np.arange(BANDS, dtype=np.uint64)  # the low bits say which band
    mixed = (least ^ np.arange(SKETCH, dtype=np.uint64) * _MULTIPLIERS[0]) * _MIX
    bits = np.packbits(((mixed ^ mixed >> np.uint64(32)) * _MIX >> np.uint64(63)).astype(np.uint8), bitorder="little").view("<i8")
    return keys.view(np.int64), bits


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[Iterator[tuple]]:
    """(first column, second column, text) of the rows, a few hundred together; no more than one text at a time is turned into a Python object."""
    for batch in batches:
        for at in range(0, batch.num_rows, PART):
            part = batch.slice(at, PART)
            yield zip(part[0].to_pylist(), part[1].to_pylist(), (t.as_py() for t in part[2]), strict=True)


def simhash_words(hashes: np.ndarray) -> np.ndarray:
    """WORDS words of SimHash bits of a set, each bit set if it is set in over half the shingles' hashes."""
    count = np.zeros(WORDS * 64, np.int64)
    for at in range(0, len(hashes), 255):  # so many fit a byte
        turned = (hashes[at : at + 255, None] ^ _TURNS) * _MIX
        turned = (turned ^ turned >> np.uint64(32)) * _MULTIPLIERS[:WORDS]
        bits = np.unpackbits((turned ^ turned >> np.uint64(29)).view(np.uint8), axis=1, bitorder="little")
        count += np.add.reduce(bits, axis=0, dtype=np.uint8)
    return np.packbits(2 * count > len(hashes), bitorder="little").view("<i8")


def _prints(docs: DataFrame, id_col: str) -> DataFrame:
    """id_col, code and size of the set of the text's shingles, and its words of SimHash bits."""
    kind = docs.schema[id_col].dataType.simpleString()

    def prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _texts(batches):
            rows = []
            for key, _, text in part:
                own = shingle_set(text)
                rows.append((key, _code(own), len(own), simhash_words(own)))
            ids, codes, sizes, words = zip(*rows, strict=True)
            columns = [pa.array(ids, id_type), pa.array(codes, pa.int64()), pa.array(sizes, pa.int32()), pa.array(list(words), pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, [id_col, "code", "n", "words"])

    id_type = to_arrow_type(docs.schema[id_col].dataType)
    return docs.select(id_col, F.lit(0).alias("_"), "text").mapInArrow(prints, f"{id_col} {kind}, code long, n int, words array<long>")


def _whole(wanted: DataFrame) -> DataFrame:
    """(node, _code, text) -> node, hashes, sketch: all hashes of the text's shingles where these are the ones that the code names."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _texts(batches):
            found = [(node, h.view(np.int64)) for node, code, text in part if _code(h := shingle_set(text)) == code]
            longs = pa.list_(pa.int64())
            columns = [pa.array([n for n, _ in found], pa.int64()), pa.array([h for _, h in found], longs), pa.array([sketch(h.view(np.uint64))[1] for _, h in found], longs)]
            yield pa.RecordBatch.from_arrays(columns, ["node", "hashes", "sketch"])

    return wanted.mapInArrow(sets, "node long, hashes array<long>, sketch array<long>")


def _table_rows(sets: DataFrame, tables: range, blocks: int) -> DataFrame:
    """(node, len, words, c) -> key, node, len, c, word, next, off: a row for each table and each of its first `blocks` blocks, off being where the SimHash
    begins in its word. Two SimHashes within MOST bits are equal in one of MOST + 1 blocks, so sets meet under the same key."""
    wide, each = BITS // (MOST + 1), []
    for t in tables:
        word, off = F.get("words", F.lit(t // 2)), t % 2 * 32
        for b in range(blocks):
            value = F.shiftrightunsigned(word, off + b * wide).bitwiseAND(F.lit((1 << wide) - 1))
            key = (value + F.lit((t * (MOST + 1) + b) << wide)).cast("int")
            each.append(F.struct(key.alias("key"), word.alias("word"), F.get("words", F.lit((t // 2 + 1) % WORDS)).alias("next"), F.lit(off).cast("int").alias("off")))
    return sets.select("node", "len", "c", F.explode(F.array(*each)).alias("_t")).select("_t.key", "node", "len", "c", "_t.word", "_t.next", "_t.off")


def _fitting(i: np.ndarray, j: np.ndarray, c: np.ndarray, size: np.ndarray, word: np.ndarray, more: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The places (i, j) of different groups that may be similar by their sizes and words."""
    ok = (c[i] != c[j]) & (np.minimum(size[i], size[j]) * OF >= np.maximum(size[i], size[j]) * SHARED)
    i, j = i[ok], j[ok]
    ok = np.bitwise_count(word[i] ^ word[j]) + np.bitwise_count(more[i] ^ more[j]) <= WORD_FAR
    return i[ok], j[ok]


def _met(rows: DataFrame, n: int, every: bool) -> DataFrame:
    """_table_rows() -> a, b, ca, cb, shared: pairs of different groups c that may be similar, and how often they meet in a task. every: all pairs within MOST bits,
    by the Gray index; else what stands next to each other, or next but one, in Gray order.

    A task indexes the keys of its partition. A key's rows are some 2^-8 of all sets, and partitions grow in number with them."""

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = list(batches)
        if not held:
            return
        key, node, size, c, word, more, off = (x.to_numpy() for x in pa.Table.from_batches(held).columns)
        word, more, size = word.view(np.uint64), more.view(np.uint64), size.astype(np.int64)
        index = GrayIndex(word >> off.astype(np.uint64) & np.uint64((1 << BITS) - 1), key, c if every else None)
        node, size, c, word, more, key = (x[index.order] for x in (node, size, c, word, more, key))
        found = []
        if every:
            for at in range(0, len(node), BLOCK):
                for i, j in index.walk(np.arange(at, min(at + BLOCK, len(node))), MOST):
                    found.append(_fitting(i, j, c, size, word, more))
        else:
            for step in (1, 2):
                i = np.flatnonzero(key[step:] == key[:-step])
                found.append(_fitting(i, i + step, c, size, word, more))
        i, j = (np.concatenate(x) for x in zip(*found, strict=True))
        i, j = np.where(node[i] > node[j], j, i), np.where(node[i] > node[j], i, j)
        order = np.lexsort((node[j], node[i]))
        i, j = i[order], j[order]
        starts = np.flatnonzero(np.r_[True, (node[i[1:]] != node[i[:-1]]) | (node[j[1:]] != node[j[:-1]])]) if len(i) else i
        shared = np.diff(np.r_[starts, len(i)])
        i, j = i[starts], j[starts]
        yield pa.RecordBatch.from_arrays([pa.array(x.astype(np.int64)) for x in (node[i], node[j], np.minimum(c[i], c[j]), np.maximum(c[i], c[j]), shared)], ["a", "b", "ca", "cb", "shared"])

    parts = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), n * TABLES_AT_ONCE * (MOST + 1) // 500_000)
    return rows.repartition(parts, "key").mapInArrow(pairs, "a long, b long, ca long, cb long, shared long")


def near_copies(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """docs (id_col long, text) -> id_col, fp long, component_id, as simhash.near_duplicates(): fp names the set of five-word shingles, links
    join sets of Jaccard similarity SHARED / OF and above.

    Candidates are what a Gray index finds within MOST bits of one of TABLES SimHashes of the sets; one SimHash of 64 bits would miss most pairs near 0.8,
    where some 10 bits differ. What stands next to each other in the Gray order of FIRST_TABLES of them is held together first, so
    that the walks through all of them leave out what is in one group by then: large groups of near copies cost few pairs. All candidates are verified by
    whole sets, so no link is wrong. Texts are read again for those that meet another only. Equal sets are one class under its smallest id; texts without
    words are one such class. Rows of a null id get the component of their set, null if there is no other; repeated rows each get a row."""
    with Scratch(docs.sparkSession) as scratch, small_batches(docs.sparkSession, TEXTS_AT_ONCE):
        rows = scratch.keep(_prints(docs, id_col), "prints")
        classes = rows.where(F.col(id_col).isNotNull()).groupBy("code").agg(F.min(id_col).cast("long").alias("rep"), F.first("n").alias("n"), F.first("words").alias("words"))
        classes = scratch.keep(classes, "classes")
        n = classes.count()
        at_once = max(PAIRS_AT_ONCE, 2 * n)
        some = classes.where("n > 0").select(F.col("rep").alias("node"), F.col("n").alias("len"), "words")

        def sets_of(pairs: DataFrame) -> DataFrame:
            wanted = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
            wanted = scratch.keep(wanted.join(classes.select(F.col("rep").alias("node"), F.col("code").alias("_code")), "node"), "wanted")
            found = docs.select(F.col(id_col).cast("long").alias("_id"), "text").join(wanted.hint("merge"), F.col("_id") == F.col("node")).select("node", "_code", "text")
            # a repeated id may have other texts: the set's code tells which row is meant
            return bucketed(_whole(found).groupBy("node").agg(F.first("hashes").alias("hashes"), F.first("sketch").alias("sketch"), F.size(F.first("hashes")).alias("n")), "node", scratch, "shingle_sets")

        def similar_by(sets: DataFrame):
            def similar(pairs: DataFrame) -> DataFrame:
                sketches = [sets.select(F.col("node").alias(x), F.col("sketch").alias(f"_s{x}"), F.col("n").alias(f"_n{x}")) for x in "ab"]
                whole = [sets.select(F.col("node").alias(x), F.col("hashes").alias(f"_{x}")) for x in "ab"]
                differ = F.aggregate(F.zip_with("_sa", "_sb", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)
                pairs = pairs.join(sketches[0], "a").join(sketches[1], "b").where((F.least("_na", "_nb") < SURE) | (differ <= FAR)).select("a", "b")
                # shared / (x + y - shared) >= SHARED / OF, in whole numbers
                enough = F.size(F.array_intersect("_a", "_b")) * (SHARED + OF) >= (F.size("_a") + F.size("_b")) * SHARED
                return pairs.join(whole[0], "a").join(whole[1], "b").where(_size_fits("_a", "_b")).where(enough).select("a", "b")

            return similar

        # the first SimHash of a word each, for SimHashes of one word share what tells whether they fit
        next_to = _met(_table_rows(some.withColumn("c", F.col("node")), range(0, 2 * FIRST_TABLES, 2), 1), n, False)
        next_to = scratch.keep(next_to.select("a", "b").distinct(), "next_to")
        links = verified(next_to, similar_by(sets_of(next_to)), scratch, at_once)
        groups = scratch.keep(connected_components(links, "groups"), "groups")
        labelled = some.join(groups.select(F.col("node").alias("_node"), "component"), F.col("node") == F.col("_node"), "left")
        labelled = scratch.keep(labelled.select("node", "len", "words", F.coalesce("component", "node").alias("c")), "labelled")
        met = [_met(_table_rows(labelled, range(t, t + TABLES_AT_ONCE), MOST + 1), n, True) for t in range(0, TABLES, TABLES_AT_ONCE)]
        met = scratch.keep(met[0], "met", *met[1:])
        scratch.drop(labelled)
        rest = scratch.keep(met.groupBy("a", "b", "ca", "cb").agg(F.sum("shared").alias("shared")), "rest")
        scratch.drop(met)
        groups = joined(groups, rest, similar_by(sets_of(rest)), scratch, at_once)
        labels = classes.join(groups.select(F.col("node").alias("rep"), "component"), "rep", "left").select(F.col("code").alias("_fp"), F.coalesce("component", "rep").alias("component_id"))
        rows = rows.select(id_col, F.col("code").alias("fp"))
        return scratch.result(rows.join(labels, F.col("fp") == F.col("_fp"), "left").select(id_col, "fp", "component_id"), "copies")


def _size_fits(a: str, b: str) -> Column:
    return F.least(F.size(a), F.size(b)) * OF >= F.greatest(F.size(a), F.size(b)) * SHARED
