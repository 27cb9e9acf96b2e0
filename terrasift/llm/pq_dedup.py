"""Operator 2: near-duplicate vectors by product quantisation over coarse inverted lists, with an exact cosine rerank."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, table
from .components import LocalForest, connected_components

COSINE = 0.9
#: Coarse lists: one for so many vectors, MAX_LISTS at most. Up to REFINED lists their centres are means, beyond that sampled vectors.
VECTORS_PER_LIST = 64
MAX_LISTS = 65_536
REFINED = 4_096
#: Nearest lists that every vector looks through where there are PROBES_AT lists, besides all tight lists that its bound reaches; the more lists the more.
PROBES, PROBES_AT = 8, 256
SUBSPACES = 8
CODEWORDS = 256
#: The quantisers are fitted on so many vectors at most (and so many numbers), or one for each list where there are more; all vectors are indexed.
SAMPLE, MAX_SAMPLE = 20_000, 65_536
MAX_SAMPLE_NUMBERS = 4_200_000
ROUNDS = 8
#: A list block holds about so many vectors; larger lists are looked through in blocks.
BLOCK = 4_096
#: A block is looked through by so many vectors at once, in a task of their own.
ASKING = 8_192
PAIRS = 2_000_000
EPS = 1e-6


def _nearest(x: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of and squared distance to the nearest centre."""
    near, far = np.empty(len(x), np.int64), np.empty(len(x))
    norm = (centres**2).sum(1)
    for at in range(0, len(x), 4096):
        part = x[at : at + 4096]
        d = norm - 2 * part @ centres.T
        near[at : at + 4096] = i = d.argmin(1)
        far[at : at + 4096] = d[np.arange(len(part)), i] + (part**2).sum(1)
    return near, far


def k_means(x: np.ndarray, k: int, seed: int = 42, rounds: int = ROUNDS) -> np.ndarray:
    """Lloyd's rounds from k rows drawn with a fixed seed; an empty cluster keeps its centre."""
    centres = x[np.random.default_rng(seed).permutation(len(x))[:k]].copy()
    for _ in range(rounds):
        near, _ = _nearest(x, centres)
        count = np.bincount(near, minlength=len(centres))
        sums = np.zeros_like(centres)
        np.add.at(sums, near, x)
        centres = np.where(count[:, None] > 0, sums / np.maximum(count, 1)[:, None], centres)
    return centres


class Quantiser:
    """Coarse centres and, for their residuals, codewords of each subspace."""

    def __init__(self, sample: np.ndarray, lists: int, least: float):
        self.radius = math.sqrt(2 - 2 * least)
        centres = k_means(sample, min(lists, len(sample)), rounds=ROUNDS if lists <= REFINED else 0)
        self.centres = centres[:0]
        for at in range(0, len(centres), 1024):  # centres of one tight group become one
            part = centres[at : at + 1024]
            if len(self.centres):
                part = part[_nearest(part, self.centres)[1] > (self.radius / 2) ** 2]
            apart: list[np.ndarray] = []
            for c in part:
                if not apart or ((np.array(apart) - c) ** 2).sum(1).min() > (self.radius / 2) ** 2:
                    apart.append(c)
            self.centres = np.concatenate([self.centres, np.array(apart).reshape(-1, sample.shape[1])])
        self.probes = min(len(self.centres), max(PROBES, round(PROBES * (len(self.centres) / PROBES_AT) ** 0.25)))
        sample = sample[:SAMPLE]
        near, _ = _nearest(sample, self.centres)
        residual = sample - self.centres[near]
        self.cuts = np.linspace(0, sample.shape[1], min(SUBSPACES, sample.shape[1]) + 1).astype(int)
        self.words = [k_means(residual[:, a:b], min(CODEWORDS, len(sample))) for a, b in zip(self.cuts, self.cuts[1:], strict=False)]

    def encode(self, unit: np.ndarray, cell: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codes of the residuals, and each one's distance from what its code stands for."""
        residual = unit - self.centres[cell]
        codes, error = [], np.zeros(len(unit))
        for (a, b), words in zip(zip(self.cuts, self.cuts[1:], strict=False), self.words, strict=True):
            i, far = _nearest(residual[:, a:b], words)
            codes.append(i.astype(np.uint8))
            error += np.maximum(far, 0)
        return np.stack(codes, 1), np.sqrt(error)

    def asymmetric(self, unit: np.ndarray, cell: int, codes: np.ndarray) -> np.ndarray:
        """Distances (query, vector) from queries to what the codes of a list stand for, by table lookup."""
        residual = unit - self.centres[cell]
        out = np.zeros((len(unit), len(codes)), np.float32)
        for k, ((a, b), words) in enumerate(zip(zip(self.cuts, self.cuts[1:], strict=False), self.words, strict=True)):
            part = residual[:, a:b]
            lookup = ((part**2).sum(1)[:, None] + (words**2).sum(1) - 2 * part @ words.T).astype(np.float32)
            out += lookup[:, codes[:, k]]
        return np.sqrt(np.maximum(out, 0))


def _units(vectors: pd.Series) -> np.ndarray:
    x = np.stack(vectors.to_numpy()).astype(np.float64)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def vector_classes(vectors: DataFrame, key: str, column: str) -> tuple[DataFrame, DataFrame]:
    """Rows with the hashes of their vector, and one row per distinct usable vector: its smallest key and number of copies."""
    v = F.col(column)
    finite = ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    if vectors.schema[column].dataType.simpleString() != "array<float>":  # floats become doubles exactly, but later
        v = v.cast("array<double>")
    usable = F.coalesce(v.isNotNull() & finite & F.exists(v, lambda x: x != 0), F.lit(False))
    rows = vectors.select(F.col(key).alias("vec_id"), F.when(usable, v).alias("v"))
    rows = rows.withColumns({"k1": F.when(F.col("v").isNotNull(), F.xxhash64("v")), "k2": F.when(F.col("v").isNotNull(), F.xxhash64(F.lit(7), "v"))})
    # the vector is found again by its first holder: an aggregate of hashes and counts stays small
    classes = rows.where("v is not null").groupBy("k1", "k2").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("copies"), F.first("v").alias("v"))
    return rows.drop("v"), classes


def near_duplicate_vectors(vectors: DataFrame, key: str = "vec_id", column: str = "embedding", least: float = COSINE) -> DataFrame:
    """(key long, column array of numbers) -> vec_id, n_links, component_id, kept.

    Two vectors link if their cosine in double precision is at least `least` (above 0.5). Vectors that are null, empty, zero or
    hold a null or a number that is not finite link with nothing, nor do vectors of different length. Equal vectors are one class that
    counts for all its copies, so copies are never paired. Each class is in one inverted list; it looks through the lists
    nearest to it, which finds nearly all pairs (the tests measure recall), and what is found is checked exactly.

    Members nearer to their list's centre than half the link radius are its core: by the triangle inequality they all link with each
    other, so a dense group costs no pairs. Others are compared by table lookup with the error of each code allowed for, so the
    lookup loses no pair. Long lists are looked through in blocks. A task returns counts and a forest of links.
    Rows of a null key get a row; a class of null keys alone has component null. Empty in, empty out."""
    spark = vectors.sparkSession
    rows, classes = vector_classes(vectors, key, column)
    rows, classes = materialize(rows, "vectors"), materialize(classes.where("rep is not null"), "vector_classes")
    counts, links = [], []
    for (dim, n) in sorted(classes.groupBy(F.size("v")).count().collect()):
        found, linked = _compare(spark, classes.where(F.size("v") == dim), dim, n, least)
        counts.append(found)
        links.append(linked)
    per_class = classes.select("k1", "k2", "rep", "copies")
    if counts:
        total, links_ = counts[0], links[0]
        for c, li in zip(counts[1:], links[1:], strict=True):
            total, links_ = total.union(c), links_.union(li)
        total = total.groupBy("rep").agg(F.sum("n").alias("found"))
        parts = connected_components(links_, "vector_links")
        per_class = per_class.join(total, "rep", "left").join(parts.select(F.col("node").alias("rep"), "component"), "rep", "left")
    else:
        per_class = per_class.withColumns({"found": F.lit(0), "component": F.lit(None).cast("long")})
    per_class = per_class.select(F.col("k1").alias("_k1"), F.col("k2").alias("_k2"), (F.col("copies") - 1 + F.coalesce("found", F.lit(0))).alias("n"), F.coalesce("component", "rep").alias("c"))
    out = rows.join(per_class, (F.col("k1") == F.col("_k1")) & (F.col("k2") == F.col("_k2")), "left")
    component = F.coalesce("c", "vec_id").cast("long")
    return out.select("vec_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))


def _compare(spark: SparkSession, classes: DataFrame, dim: int, n: int, least: float) -> tuple[DataFrame, DataFrame]:
    """(rep, n) of links found and (a, b) links, among distinct vectors of one length."""
    lists = max(1, min(MAX_LISTS, n // VECTORS_PER_LIST))
    most = max(1, min(max(SAMPLE, lists), MAX_SAMPLE, MAX_SAMPLE_NUMBERS // dim))
    sampled = classes if n <= most else classes.where(F.pmod(F.xxhash64("rep"), F.lit(2**30)) < int(most / n * 2**30))
    sample = _units(sampled.select("v", "rep").orderBy("rep").limit(most).toPandas().v)
    quantiser = Quantiser(sample, lists, least)
    shared = spark.sparkContext.broadcast(quantiser)
    radius, core_radius = quantiser.radius, quantiser.radius / 2 - EPS

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = shared.value
        for batch in batches:
            if len(batch) == 0:
                continue
            unit = _units(batch.v)
            cell, far = _nearest(unit, own.centres)
            codes, error = own.encode(unit, cell)
            core = np.sqrt(np.maximum(far, 0)) <= core_radius
            norms, lists = (own.centres**2).sum(1), []
            step = max(1, PAIRS // len(norms))
            for at in range(0, len(batch), step):
                part = unit[at : at + step]
                near = np.sqrt(np.maximum((part**2).sum(1)[:, None] + norms - 2 * part @ own.centres.T, 0))
                nearest = np.argpartition(near, own.probes - 1, axis=1)[:, : own.probes]
                for i in range(len(part)):
                    # the others of each near list, and each core that can reach; the own core links as a whole
                    reach = np.flatnonzero(near[i] <= radius + core_radius + 2 * EPS)
                    own_core = 2 * cell[at + i] + 1 if core[at + i] else -1
                    lists.append([int(x) for x in np.union1d(2 * nearest[i], 2 * reach + 1) if x != own_core])
            yield pd.DataFrame({"rep": batch.rep, "copies": batch.copies, "v": batch.v, "list": 2 * cell + core, "code": [c.tobytes() for c in codes], "error": error, "probes": lists})

    placed = materialize(classes.select("rep", "copies", "v").mapInPandas(place, f"rep long, copies long, v {classes.schema['v'].dataType.simpleString()}, list int, code binary, error double, probes array<int>"), "placed")
    sizes = materialize(placed.groupBy("list").agg(F.count(F.lit(1)).alias("n"), F.sum("copies").alias("copies"), F.min("rep").alias("first")), "lists")  # 2 rows a list at most
    asked = placed.select(F.explode("probes").alias("list")).groupBy("list").agg(F.count(F.lit(1)).alias("asked"))
    blocks = sizes.join(asked, "list").select(F.col("list").alias("_l"), F.ceil(F.col("n") / BLOCK).cast("int").alias("_b"), F.ceil(F.col("asked") / ASKING).cast("int").alias("_a"))
    blocks = F.broadcast(materialize(blocks, "blocks"))
    slot = lambda of: F.pmod(F.xxhash64("rep"), F.col(of)).cast("int")
    every = lambda of: F.explode(F.sequence(F.lit(0), F.col(of) - 1))
    # each block of a list meets each block of those that ask it in a group of its own: of a popular list neither side is one task's
    members = placed.join(blocks, F.col("list") == F.col("_l")).select(F.lit(0).alias("asks"), "list", slot("_b").alias("block"), every("_a").alias("part"), "rep", "copies", "v", "code", "error", "probes", F.col("list").alias("home"))
    asking = placed.select("rep", "copies", "v", F.col("list").alias("home"), F.explode("probes").alias("list")).join(blocks, F.col("list") == F.col("_l"))
    asking = asking.select(F.lit(1).alias("asks"), "list", every("_b").alias("block"), slot("_a").alias("part"), "rep", "copies", "v", F.lit(None).cast("binary").alias("code"), F.lit(None).cast("double").alias("error"), F.lit(None).cast("array<int>").alias("probes"), "home")

    def compare(group: pd.DataFrame) -> pd.DataFrame:
        there, ask = group[group.asks == 0], group[group.asks == 1]
        if not len(there) or not len(ask):
            return pd.DataFrame({"rep": [], "n": [], "other": []}).astype({"rep": "int64", "n": "int64", "other": "Int64"})
        return pd.concat(_look_up(shared.value, int(group["list"].iloc[0]) // 2, there, ask, least))

    result = materialize(members.union(asking).groupBy("list", "block", "part").applyInPandas(compare, "rep long, n long, other long"), "compared")
    core = placed.where("list % 2 = 1").select("rep", "copies", "list").join(F.broadcast(sizes.select(F.col("list").alias("_l"), F.col("copies").alias("_all"), "first")), F.col("list") == F.col("_l"))
    counts = result.where("n > 0").select("rep", "n").union(core.select("rep", F.col("_all") - F.col("copies")))
    return counts, result.where("other is not null").select(F.col("rep").alias("a"), F.col("other").alias("b")).union(core.select("rep", "first"))


def _look_up(own: Quantiser, cell: int, there: pd.DataFrame, ask: pd.DataFrame, least: float) -> Iterator[pd.DataFrame]:
    """Counts (rep, n, null) and links (rep, 0, other) of the queries `ask` against the list block `there`."""
    vectors, asked = (np.stack(x.v.to_numpy()).astype(np.float64) for x in (there, ask))
    unit = asked / np.sqrt((asked**2).sum(1, keepdims=True))
    norm, asked_norm = np.sqrt((vectors**2).sum(1)), np.sqrt((asked**2).sum(1))
    codes = np.frombuffer(b"".join(there.code), np.uint8).reshape(len(there), -1)
    limit = (own.radius + there.error.to_numpy() + 1e-3).astype(np.float32)
    reps, copies = there.rep.to_numpy(), there.copies.to_numpy()
    ask_reps, ask_copies, home = ask.rep.to_numpy(), ask.copies.to_numpy(), ask.home.to_numpy()
    # (member, list it looks through) as one number
    lists = 2 * len(own.centres)
    looked = np.sort(np.repeat(np.arange(len(there)), [len(p) for p in there.probes]) * lists + np.concatenate(there.probes.to_list())) if len(there) else np.empty(0, np.int64)
    count, back = np.zeros(len(ask), np.int64), np.zeros(len(there), np.int64)
    everyone, at_of = np.unique(np.r_[reps, ask_reps], return_inverse=True)
    forest = LocalForest(len(everyone))
    step = max(1, PAIRS // len(there))
    for at in range(0, len(ask), step):
        q, y = np.nonzero(own.asymmetric(unit[at : at + step], cell, codes) <= limit)
        q += at
        for k in range(0, len(q), PAIRS // 10):
            i, j = q[k : k + PAIRS // 10], y[k : k + PAIRS // 10]
            cosine = np.einsum("ij,ij->i", asked[i], vectors[j]) / (asked_norm[i] * norm[j])
            keep = (cosine >= least) & (ask_reps[i] != reps[j])
            i, j = i[keep], j[keep]
            np.add.at(count, i, copies[j])
            forest.add(at_of[len(reps) + i], at_of[j])
            one_way = ~np.isin(j * lists + home[i], looked)  # j does not look where i is: it counts i here
            np.add.at(back, j[one_way], ask_copies[i[one_way]])
    member, root = forest.links()
    yield pd.DataFrame({"rep": np.r_[ask_reps[count > 0], reps[back > 0]], "n": np.r_[count[count > 0], back[back > 0]]}).assign(other=pd.array([None] * int((count > 0).sum() + (back > 0).sum()), "Int64"))
    yield pd.DataFrame({"rep": everyone[member], "n": 0, "other": everyone[root]})


def op2_embedding_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and components of all embeddings."""
    return near_duplicate_vectors(table(spark, sf_dir, "embeddings"))
