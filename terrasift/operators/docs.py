"""Documents: equipment, limits, near-duplicate evidence and current inventory."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import evidence_tokens, jaccard
from .graph import cut
from .survive import first_wins

#: Rows of a block of sets, pairs that are looked at at once, longs of the longest signature.
BLOCK, PAIRS, MOST_WORDS = 1 << 15, 1 << 20, 64
# What is plausible.
BOUNDS = {"quantity": (1, 200), "kw": (100, 10_000), "hp": (100, 20_000)}


def plausible(quantity: Column, kw: Column, hp: Column) -> Column:
    ok = lambda c, name: c.isNull() | c.between(*BOUNDS[name])
    return ok(quantity, "quantity") & ok(kw, "kw") & ok(hp, "hp")


def suppress_implicit(rows: DataFrame, doc: str) -> DataFrame:
    """Drop single units whose number isn't stated and that a group on the same page with the same rating explains (its horsepower may be unknown), and
    horsepower-only rows that any rated row of the page with the same number and horsepower explains. rows: doc, page, quantity, kw, hp, stated."""
    others = rows.select(F.col(doc).alias("d"), F.col("page").alias("p"), F.col("quantity").alias("q"), F.col("kw").alias("k"), F.col("hp").alias("h")).distinct()
    page = (F.col(doc) == F.col("d")) & (F.col("page") == F.col("p"))
    single = page & ~F.col("stated") & (F.col("quantity") == 1) & F.col("kw").eqNullSafe(F.col("k")) & (F.col("hp").isNull() | F.col("hp").eqNullSafe(F.col("h")))
    left = rows.join(others.where("q > 1"), single, "left_anti")
    rated = page & F.col("kw").isNull() & (F.col("quantity") == F.col("q")) & F.col("hp").eqNullSafe(F.col("h"))
    return left.join(others.where("k is not null"), rated, "left_anti")


def line_windows(docs: DataFrame, key: str, text: str, before: int = 2, after: int = 3) -> DataFrame:
    """Each line with its number from 1, the offset at which it starts and the lines around it joined by spaces."""
    lines = docs.select(key, F.posexplode(F.split(text, "\n")).alias("i", "line"))
    order = Window.partitionBy(key).orderBy("i")
    offset = F.coalesce(F.sum(F.length("line") + 1).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    around = F.array_join(F.collect_list("line").over(order.rowsBetween(-before, after)), " ")
    return lines.select(key, (F.col("i") + 1).alias("line_no"), "line", offset.cast("long").alias("line_offset"), around.alias("window"))


def _band(n: int | np.ndarray, least: float):
    """The geometric band of a set's size: sets of the similarity lie in the same or the next."""
    return np.floor(np.log(n) / -np.log(least) + 1e-9).astype(int)


def _words(band: int, least: float) -> int:
    """Longs of a signature of sets of the band: twice as many bits as such a set has tokens, MOST_WORDS at most."""
    return int(min(MOST_WORDS, 2 ** max(0, np.ceil(np.log2(2 * least ** -(band + 1) / 64)))))


def _folded(signs: np.ndarray, words: int) -> np.ndarray:
    while signs.shape[1] > words:
        signs = signs[:, : signs.shape[1] // 2] ^ signs[:, signs.shape[1] // 2 :]
    return signs


def _signatures(sets: DataFrame, least: float) -> DataFrame:
    """(_id, _g, n, _hashes) -> (_id, _g, n, band, sign): bits that say of each remainder of the hashes whether an odd number of tokens has it. Two
    signatures differ in as many bits at most as there are tokens in one set alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 1_000):
                batch = whole.slice(at, 1_000)
                n = batch["n"].to_numpy()
                bit = (batch["_hashes"].flatten().to_numpy().view(np.uint64) % np.uint64(64 * MOST_WORDS)).astype(np.int64)
                odd = np.bincount(np.repeat(np.arange(len(n)), n) * (64 * MOST_WORDS) + bit, minlength=len(n) * 64 * MOST_WORDS).astype(np.uint8) & 1
                signs = np.packbits(odd.reshape(len(n), -1), axis=1, bitorder="little").view(np.int64)
                bands = _band(n, least)
                own = np.empty(len(n), object)
                for band in np.unique(bands):
                    rows = np.flatnonzero(bands == band)
                    for row, sign in zip(rows, _folded(signs[rows], _words(band + 1, least)), strict=True):
                        own[row] = sign
                yield pa.RecordBatch.from_arrays([batch["_id"], batch["_g"], batch["n"], pa.array(bands, pa.int32()), pa.array(list(own), pa.list_(pa.int64()))], ["_id", "_g", "n", "band", "sign"])

    return sets.mapInArrow(run, "_id long, _g long, n int, band int, sign array<long>")


def _alike(x: tuple, y: tuple, share: float, later: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Ids of the pairs of rows (ids, sizes, signatures) of x and y, with `later` of each row and those behind it, whose sizes and signatures allow the similarity."""
    words = x[2].shape[1]
    few = max(1, words // 2)
    xs, ys = _folded(x[2], few), [np.ascontiguousarray(c) for c in _folded(y[2], few).T]
    step = max(1, PAIRS // max(1, len(y[0])))
    for at in range(0, len(x[0]), step):
        first = at + 1 if later else 0
        most = (x[1][at : at + step, None] + y[1][None, first:]) * share + 1e-9
        differ = np.zeros(most.shape, np.uint16)
        for w in range(few):
            differ += np.bitwise_count(xs[at : at + step, w, None] ^ ys[w][None, first:])
        i, j = np.nonzero(differ <= most)
        i, j = i + at, j + first
        for part in range(0, len(i), PAIRS // words):
            k, m = i[part : part + PAIRS // words], j[part : part + PAIRS // words]
            ok = np.bitwise_count(x[2][k] ^ y[2][m]).sum(1, dtype=np.int64) <= (x[1][k] + y[1][m]) * share + 1e-9
            ok &= (np.abs(x[1][k] - y[1][m]) <= (x[1][k] + y[1][m]) * share + 1e-9) & ((m > k) | (not later))
            yield x[0][k[ok]], y[0][m[ok]]


def _meet(rows: pa.Table, share: float, least: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Candidates of one pair of blocks of a bucket: at least one of two is of the bucket's band, the other may be of the one below."""
    low, high, own, ids, n, band, bucket = (rows[c].to_numpy() for c in ("low", "high", "own", "_id", "n", "band", "bucket"))
    words = _words(int(bucket[0]), least)

    def side(which: np.ndarray) -> tuple:
        at = np.flatnonzero(which)
        signs = rows["sign"].combine_chunks().take(pa.array(at))
        signs = signs.flatten().to_numpy(zero_copy_only=False).view(np.uint64).reshape(len(at), -1) if len(at) else np.zeros((0, words), np.uint64)
        return ids[at], n[at].astype(np.int64), _folded(signs, words)

    top = band == bucket
    if low[0] == high[0]:
        x, y = side(top), side(~top)
        yield from _alike(x, x, share, True)
        yield from _alike(x, y, share, False)
    else:
        a = own == low
        x, y = side(a & top), side(~a & top)
        yield from _alike(x, y, share, False)
        yield from _alike(x, side(~a & ~top), share, False)
        yield from _alike(y, side(a & ~top), share, False)


def near_duplicate_evidence(rows: DataFrame, group: str, key: str, text: str, least: float = 0.72) -> DataFrame:
    """Pairs of a group whose token sets have a Jaccard of at least `least`.

    Every two sets of like sizes meet, by signatures of some bits a token that can't rule out a similar pair; what passes is held against the whole sets. A group
    is dealt out by bands of size and then in blocks of BLOCK rows, each two of which meet in one place, so a task holds two blocks whatever the group."""
    named = rows.where(F.col(group).isNotNull() & F.col(key).isNotNull())
    sets = named.select(group, key, evidence_tokens(F.col(text)).alias("tokens")).where(F.size("tokens") > 0)
    sets = cut(sets.withColumn("_id", F.monotonically_increasing_id()))
    signs = cut(_signatures(sets.select("_id", F.xxhash64(group).alias("_g"), F.size("tokens").alias("n"), F.transform("tokens", lambda t: F.xxhash64(t)).alias("_hashes")), least))
    bucketed = signs.withColumn("bucket", F.explode(F.array(F.col("band"), F.col("band") + 1)))
    large = bucketed.groupBy(F.col("_g").alias("_lg"), F.col("bucket").alias("_lb")).agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("_n")).where("_n > 1")
    dealt = bucketed.join(large, (F.col("_g") == F.col("_lg")) & (F.col("bucket") == F.col("_lb")), "left").withColumn("_n", F.coalesce("_n", F.lit(1)))
    dealt = dealt.withColumn("own", F.pmod(F.xxhash64("_id"), "_n").cast("int")).withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)))
    dealt = dealt.select("_g", "bucket", F.least("own", "_other").alias("low"), F.greatest("own", "_other").alias("high"), "own", "_id", "n", "band", "sign")
    share = (1 - least) / (1 + least)

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            held = pa.concat_tables([held, pa.Table.from_batches([batch])]) if held is not None else pa.Table.from_batches([batch])
            yield from whole(held, edges := ends(held))
            held = held.slice(int(edges[-1])) if len(edges) else held
        if held is not None and held.num_rows:
            yield from whole(held, np.array([held.num_rows]))

    def ends(table: pa.Table) -> np.ndarray:
        of = [table[c].to_numpy() for c in ("_g", "bucket", "low", "high")]
        return np.flatnonzero(np.any([c[1:] != c[:-1] for c in of], 0)) + 1

    def whole(table: pa.Table, edges: np.ndarray) -> Iterator[pa.RecordBatch]:
        at = 0
        for end in edges:
            if end - at > 1:
                for a, b in _meet(table.slice(at, int(end) - at), share, least):
                    if len(a):
                        yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["x", "y"])
            at = int(end)

    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    found = dealt.repartition(parts, "_g", "bucket", "low", "high").sortWithinPartitions("_g", "bucket", "low", "high").mapInArrow(pairs, "x long, y long")
    found = cut(found)
    wanted = found.select(F.explode(F.array("x", "y")).alias("_w")).distinct()
    needed = cut(sets.join(wanted, F.col("_id") == F.col("_w"), "left_semi"))
    x, y = (needed.select(F.col("_id").alias(n), F.col(group).alias(f"_g{n}"), F.col(key).alias(f"_k{n}"), F.col("tokens").alias(f"_t{n}")) for n in "xy")
    both = found.join(x, "x").join(y, "y").where("_gx = _gy and _kx <> _ky")
    swap = F.col("_kx") > F.col("_ky")
    both = both.select(F.col("_gx").alias(group), F.least("_kx", "_ky").alias("a"), F.greatest("_kx", "_ky").alias("b"), F.when(swap, F.col("_ty")).otherwise(F.col("_tx")).alias("_a"), F.when(swap, F.col("_tx")).otherwise(F.col("_ty")).alias("_b"))
    return both.withColumn("jaccard", jaccard(F.col("_a"), F.col("_b"))).where(F.col("jaccard") >= least).select(group, "a", "b", "jaccard")


def latest_operating(permits: DataFrame, agency: str, doc: str) -> DataFrame:
    """The newest eligible operating permit of each agency; the first of equals. permits: agency, doc, kind, status, day."""
    eligible = permits.where((F.col("status") != "Confirmed mismatch") & F.lower("kind").contains("operating") & F.col("day").isNotNull())
    return first_wins(eligible, [agency], [F.col("day").desc(), F.col(doc)]).select(F.col(agency).alias("_a"), F.col(doc).alias("latest_doc"), F.col("day").alias("baseline_day"))


def evidence_roles(permits: DataFrame, agency: str, doc: str) -> DataFrame:
    """permits with the role of each document against its agency's latest operating permit."""
    joined = permits.join(latest_operating(permits, agency, doc), F.col(agency) == F.col("_a"), "left").drop("_a")
    construction = F.lower("kind").contains("construction")
    role = (
        F.when(F.col(doc) == F.col("latest_doc"), "latest_operating_permit")
        .when(construction & (F.col("day") > F.col("baseline_day")), "post_baseline_construction")
        .when(construction, "construction")
        .when(F.lower("kind").contains("operating"), "historical_operating")
        .otherwise("other")
    )
    return joined.withColumn("role", role)


def select_current(roles: DataFrame, agency: str, doc: str) -> DataFrame:
    """roles (with has_rows, misfiled) plus selected: the latest permit and what was built after it if it has rows, else all documents
    of the agency's newest day that have some; misfiled ones never."""
    whole = Window.partitionBy(agency)
    latest_has = F.coalesce(F.bool_or((F.col("role") == "latest_operating_permit") & F.col("has_rows")).over(whole), F.lit(False))
    newest = F.max(F.when(F.col("has_rows"), F.col("day"))).over(whole)
    chosen = F.when(latest_has, F.col("role").isin("latest_operating_permit", "post_baseline_construction")).otherwise(F.col("has_rows") & F.coalesce(F.col("day") == newest, F.lit(False)))
    return roles.withColumn("selected", chosen & ~F.col("misfiled"))
