"""Retrieval over embedding vectors."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .graph import cut
from .order import global_rank, running_total
from .spatial import distance_join


#: Rows of a side that meet in one task, and of those queries, rows of the pool and near ties at once.
BLOCK_ROWS, PART_QUERIES, PART_ROWS, PART_TIES = 1 << 16, 8_192, 512, 1 << 16
#: Cosines that differ by no more are worked out one by one.
ROUNDING = 1e-9


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / (norm(a) * norm(b))


def prototype(df: DataFrame, group: list[str], vector: str) -> DataFrame:
    """Mean vector of each group."""
    flat = df.select(*group, F.posexplode(vector).alias("i", "x"))
    mean = flat.groupBy(*group, "i").agg(F.avg(F.col("x").cast("double")).alias("x"))
    return mean.groupBy(*group).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("prototype"))


def covariance(df: DataFrame, vector: str) -> tuple[np.ndarray, np.ndarray, int]:
    """Mean, covariance and count from one partial sum a task; the driver gets dim x dim numbers of each."""

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n, total, outer = 0, 0.0, 0.0
        for batch in batches:
            if len(batch):
                x = np.stack(batch[vector].to_numpy()).astype(np.float64)
                n, total, outer = n + len(x), total + x.sum(0), outer + x.T @ x
        if n:
            yield pd.DataFrame({"n": [n], "total": [total.tolist()], "outer": [outer.ravel().tolist()]})

    rows = df.where(F.col(vector).isNotNull()).select(vector).mapInPandas(sums, "n long, total array<double>, outer array<double>")
    merged = rows.select(F.col("n"), F.posexplode(F.concat("total", "outer")).alias("i", "x")).groupBy("i").agg(F.sum("x").alias("x"), F.sum("n").alias("n")).orderBy("i").toPandas()
    if merged.empty:
        raise ValueError("no vectors")
    n, both = int(merged.n[0]), merged.x.to_numpy()
    dim = int((np.sqrt(1 + 4 * len(both)) - 1) / 2)
    mean = both[:dim] / n
    return mean, both[dim:].reshape(dim, dim) / n - np.outer(mean, mean), n


def whiten(df: DataFrame, vector: str, out: str, drop_top: int = 0, floor: float = 1e-6, unit: bool = True) -> DataFrame:
    """ZCA: decorrelated, unit variance, then, with `unit`, unit length; optionally without the strongest components."""
    mean, cov, _ = covariance(df, vector)
    values, basis = np.linalg.eigh(cov)
    scale = 1 / np.sqrt(np.maximum(values, floor))
    if drop_top:
        scale[-drop_top:] = 0
    shared = df.sparkSession.sparkContext.broadcast((mean, (basis * scale) @ basis.T))

    @F.pandas_udf("array<double>")
    def run(s: pd.Series) -> pd.Series:
        centre, matrix = shared.value
        x = (np.stack(s.to_numpy()).astype(np.float64) - centre) @ matrix
        return pd.Series(list(x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12) if unit else x))

    return df.where(F.col(vector).isNotNull()).withColumn(out, run(vector))


def ranked(scores: DataFrame, query: str, key: str, score: str) -> DataFrame:
    """Rank of each key for its query; ties by key."""
    return scores.withColumn("rank", F.row_number().over(Window.partitionBy(query).orderBy(F.col(score).desc(), F.col(key))))


def mid_ranks(counts: DataFrame, group: list[str], value: str, n: str) -> DataFrame:
    """counts (group, value, n), a row for each different value, with `rank`: the mean of the places from 1 that its n equals take in their group. Places
    come from ranges of values and their totals, so a group of any size is put in order by many tasks."""
    before = running_total(counts, "_before", n, *group, value)
    first = before.groupBy(*[F.col(g).alias(f"_{g}") for g in group]).agg(F.min("_before").alias("_first"))
    on = F.lit(True)
    for g in group:
        on = on & F.col(g).eqNullSafe(F.col(f"_{g}"))
    placed = before.join(first, on).withColumn("rank", F.col("_before") - F.col("_first") + (F.col(n) + 1) / 2)
    return placed.drop("_before", "_first", *[f"_{g}" for g in group])


def spearman(pairs: DataFrame, group: list[str], x: str, y: str) -> DataFrame:
    """(group, n, rho): the correlation of the ranks of x and y, ties at their mean rank. Rows with a null on either side are left out; a side
    without two different values gives null.

    Equal pairs are counted first, so ties of any number are one row where ranks meet them; ranks are taken from the middle, which keeps sums small."""
    cells = cut(pairs.where(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(*group, x, y).agg(F.count(F.lit(1)).alias("n")))
    ranked = cells
    for c, name in ((x, "_rx"), (y, "_ry")):
        ranks = mid_ranks(cells.groupBy(*group, c).agg(F.sum("n").alias("m")), group, c, "m").select(*[F.col(g).alias(f"_{g}") for g in group], F.col(c).alias("_v"), F.col("rank").alias(name))
        on = F.col(c) == F.col("_v")
        for g in group:
            on = on & F.col(g).eqNullSafe(F.col(f"_{g}"))
        ranked = ranked.join(ranks, on).drop("_v", *[f"_{g}" for g in group])
    size = cells.groupBy(*[F.col(g).alias(f"_{g}") for g in group]).agg(F.sum("n").alias("all"))
    on = F.lit(True)
    for g in group:
        on = on & F.col(g).eqNullSafe(F.col(f"_{g}"))
    a, b = (F.col(c) - (F.col("all") + 1) / 2 for c in ("_rx", "_ry"))
    sums = ranked.join(size, on).groupBy(*group).agg(F.sum("n").alias("n"), F.sum(F.col("n") * a * b).alias("_ab"), F.sum(F.col("n") * a * a).alias("_aa"), F.sum(F.col("n") * b * b).alias("_bb"))
    return sums.select(*group, "n", (F.col("_ab") / F.nullif(F.sqrt(F.col("_aa")) * F.sqrt(F.col("_bb")), F.lit(0.0))).alias("rho"))


def search(pool: DataFrame, queries: DataFrame, query: str, key: str, vector: str, score: Column, k: int, *carry: str) -> DataFrame:
    """The k best of the pool for each query (ties by key) with `s` and `rank`, and the columns `carry` of pool and queries. score: of a row of both.
    A task sends k rows a query at most."""
    scored = against(pool, queries, query).select(query, key, *carry, score.alias("s"))
    order = Window.partitionBy(query).orderBy(F.col("s").desc(), F.col(key))
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def feedback_search(pool: DataFrame, seeds: DataFrame, label: str, key: str, vector: str, k: int) -> tuple[DataFrame, DataFrame]:
    """Two rounds of (query, key, label, s, rank). First the pool against each label's mean seed; then the first k hits that are of another label are
    taken as hard negatives, and the pool is searched again by twice the cosine to the mean seed less that to their mean. A label
    without such hits keeps its first score."""
    positive = prototype(seeds, [label], vector).withColumnRenamed(label, "_query")
    first = cut(search(pool, positive, "_query", key, vector, cosine(F.col(vector), F.col("prototype")), k, label, vector))
    wrong = prototype(first.where(F.col(label) != F.col("_query")), ["_query"], vector).select(F.col("_query").alias("_of"), F.col("prototype").alias("_wrong"))
    both = cut(positive.join(wrong, F.col("_query") == F.col("_of"), "left").drop("_of"))
    score = cosine(F.col(vector), F.col("prototype"))
    fed = F.when(F.col("_wrong").isNull(), score).otherwise(score * 2 - cosine(F.col(vector), F.col("_wrong")))
    second = search(pool, both, "_query", key, vector, fed, k, label)
    names = [F.col("_query").alias("query"), key, label, "s", "rank"]
    return first.select(*names), second.select(*names)


def fused_search(pool: DataFrame, prompts: DataFrame, query: str, prompt: str, key: str, vector: str, k: int, *carry: str) -> DataFrame:
    """An ensemble of prompts (query, prompt, prototype): the k best of the pool for each query by the best rank that any of its prompts gives, ties by key.
    Only the first k of a prompt can be among the first k of its query."""
    asked = prompts.withColumn("_asked", F.struct(query, prompt))
    ranked_ = search(pool, asked, "_asked", key, vector, cosine(F.col(vector), F.col("prototype")), k, *carry)
    best = ranked_.groupBy(F.col(f"_asked.{query}").alias(query), key, *carry).agg(F.min("rank").alias("best"))
    order = Window.partitionBy(query).orderBy("best", key)
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def recall_in(found: DataFrame, query: str, label: str, pool: DataFrame) -> DataFrame:
    """(query, hits, recall): how many of the found are of the query's label, of all of that label in the pool."""
    there = pool.groupBy(F.col(label).alias("_label")).agg(F.count(F.lit(1)).alias("_all"))
    hits = found.groupBy(query).agg(F.count_if(F.col(label) == F.col(query)).alias("hits"))
    return hits.join(there, F.col(query) == F.col("_label")).select(query, "hits", (F.col("hits") / F.col("_all")).alias("recall"))


def covariance_cells(df: DataFrame, vector: str) -> DataFrame:
    """(i, j, value): the covariance of the vectors' components, from partial sums of each task."""
    mean, cov, _ = covariance(df, vector)
    cells = [(i, j, float(cov[i, j])) for i in range(len(mean)) for j in range(len(mean))]  # dim x dim numbers, whatever the table
    return df.sparkSession.createDataFrame(cells, "i int, j int, value double")


def without_components(df: DataFrame, vector: str, out: str, drop: int) -> DataFrame:
    """df with the centred vector less its parts along the `drop` strongest components."""
    mean, cov, _ = covariance(df, vector)
    basis = np.linalg.eigh(cov)[1][:, len(mean) - drop :]
    shared = df.sparkSession.sparkContext.broadcast((mean, basis))  # dim and dim x drop numbers

    @F.pandas_udf("array<double>")
    def run(s: pd.Series) -> pd.Series:
        centre, top = shared.value
        x = np.stack(s.to_numpy()).astype(np.float64) - centre
        return pd.Series(list(x - (x @ top) @ top.T))

    return df.where(F.col(vector).isNotNull()).withColumn(out, run(vector))


def held_out_places(tiles: DataFrame, places: DataFrame, label: str, key: str, place: str, vector: str, radius: float) -> DataFrame:
    """Leave-one-place-out: (place, removed, first_hit). Each place (label, place, other_point) is searched for by the mean of its label's tiles (label, key,
    point, vector), but for those within the radius of it; they are what it should find, and first_hit is the rank of the first among all tiles. Places
    without a tile near, or whose label has no other tile, are left out.

    What is near is taken off the label's sums, so a fold costs its own tiles and not the training set."""
    near = cut(distance_join(tiles.select(label, key, "point", vector), places.select(F.col(label).alias("_label"), place, "other_point"), radius, how=F.col(label) == F.col("_label")).select(label, place, key, vector))
    sums = lambda df, *by: df.select(*by, F.posexplode(vector).alias("i", "x")).groupBy(*by, "i").agg(F.sum(F.col("x").cast("double")).alias("s"), F.count(F.lit(1)).alias("n"))
    whole = sums(tiles, label).select(F.col(label).alias("_l"), F.col("i").alias("_i"), F.col("s").alias("ws"), F.col("n").alias("wn"))
    rest = sums(near, label, place).join(whole, (F.col(label) == F.col("_l")) & (F.col("i") == F.col("_i"))).where("wn > n")
    queries = rest.groupBy(place).agg(F.max("n").alias("removed"), F.array_sort(F.collect_list(F.struct("i", ((F.col("ws") - F.col("s")) / (F.col("wn") - F.col("n"))).alias("x")))).alias("_q"))
    queries = cut(queries.select(place, "removed", F.transform("_q", lambda e: e["x"]).alias("_q")))
    best = near.join(queries, place).select(place, cosine(F.col(vector), F.col("_q")).alias("s"), key)
    best = best.groupBy(place).agg(F.max(F.struct("s", (-F.col(key)).alias("k"))).alias("_best"))
    asked = cut(queries.join(best, place))
    better = better_counts(tiles, asked, place, key, vector)
    return asked.select(place, "removed").join(better.withColumnRenamed(place, "_place"), F.col(place) == F.col("_place"), "left").select(place, "removed", (F.coalesce("better", F.lit(0)) + 1).cast("long").alias("first_hit"))


def _cosines(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """cosine() of the rows of x and y, added up in the same order, so that equal scores are equal."""
    xy, xx, yy = (np.zeros(len(x)) for _ in range(3))
    for i in range(x.shape[1]):
        xy, xx, yy = xy + x[:, i] * y[:, i], xx + x[:, i] * x[:, i], yy + y[:, i] * y[:, i]
    with np.errstate(divide="ignore", invalid="ignore"):
        return xy / (np.sqrt(xx) * np.sqrt(yy))


def better_counts(pool: DataFrame, asked: DataFrame, query: str, key: str, vector: str) -> DataFrame:
    """asked (query, _q, _best struct(s, k = -key)) -> (query, better): how many rows of the pool have a larger cosine to _q than _best.s, or the same and a
    smaller key.

    Every row meets every query, in blocks: a task multiplies BLOCK_ROWS of the pool with BLOCK_ROWS of the queries at most, a part at a time, and sends
    a count a query. What is closer to the best score than rounding is worked out again as cosine() does. Vectors of other lengths, with nulls, or zero, have no cosine."""
    spark = pool.sparkSession
    queries, rows = asked.count(), pool.count()
    q_blocks = max(1, -(-queries // BLOCK_ROWS))
    p_blocks = max(1, -(-rows // BLOCK_ROWS), min(-(-rows // 1_000), -(-2 * spark.sparkContext.defaultParallelism // q_blocks)))
    own = lambda name, n, *by: F.pmod(F.xxhash64(*by), F.lit(n)).cast("int").alias(name)
    every = lambda name, n: F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias(name)
    left = asked.select(own("_qb", q_blocks, query), every("_pb", p_blocks), F.col(query).alias("_query"), "_q", F.col("_best.s").alias("_s"), (-F.col("_best.k")).alias("_k"))
    right = pool.where(F.col(vector).isNotNull()).select(own("_pb", p_blocks, key, vector), every("_qb", q_blocks), F.col(key).alias("_key"), F.col(vector).alias("_v"))

    def matrix(column: pa.ChunkedArray, dim: int) -> tuple[np.ndarray, np.ndarray]:
        """(rows that have dim numbers, these as rows of doubles)."""
        whole = column.combine_chunks()
        whole = whole.chunk(0) if isinstance(whole, pa.ChunkedArray) else whole
        fits = np.flatnonzero(np.asarray(pc.equal(pc.list_value_length(whole), dim).fill_null(False).to_numpy(zero_copy_only=False), bool))
        x = whole.take(pa.array(fits)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(fits), dim)
        return fits, x

    def count(mine: pa.Table, theirs: pa.Table) -> pa.Table:
        dim = len(mine["_q"][0]) if mine.num_rows else 0
        of, q = matrix(mine["_q"], dim)
        at, v = matrix(theirs["_v"], dim) if theirs.num_rows else (np.zeros(0, int), np.zeros((0, dim)))
        least, best = (mine[c].to_numpy()[of] for c in ("_s", "_k"))
        keys = theirs["_key"].to_numpy()[at] if len(at) else np.zeros(0, np.int64)
        with np.errstate(divide="ignore", invalid="ignore"):
            uq, uv = (x / np.sqrt((x * x).sum(1, keepdims=True)) for x in (q, v))
        better = np.zeros(len(q), np.int64)
        for i in range(0, len(q), PART_QUERIES):
            mine_ = slice(i, i + PART_QUERIES)
            for j in range(0, len(v), PART_ROWS):
                s = uv[j : j + PART_ROWS] @ uq[mine_].T
                s -= least[mine_]
                better[mine_] += (s > ROUNDING).sum(0)
                r, c = np.nonzero(np.abs(s) <= ROUNDING)
                for n in range(0, len(r), PART_TIES):
                    row, col = r[n : n + PART_TIES] + j, c[n : n + PART_TIES] + i
                    exact = _cosines(v[row], q[col])
                    ahead = (exact > least[col]) | ((exact == least[col]) & (keys[row] < best[col]))
                    better += np.bincount(col[ahead], minlength=len(q))
        return pa.table({"_query": mine["_query"].take(pa.array(of)), "better": pa.array(better)})

    found = left.groupBy("_qb", "_pb").cogroup(right.groupBy("_qb", "_pb")).applyInArrow(count, f"_query {asked.schema[query].dataType.simpleString()}, better long")
    return found.groupBy(F.col("_query").alias(query)).agg(F.sum("better").alias("better"))


def recall_at(hits: DataFrame, rank: str, ks: tuple[int, ...]) -> DataFrame:
    """Share of queries whose first hit ranks in the first k, and the median rank."""
    return hits.agg(*[F.avg((F.col(rank) <= k).cast("double")).alias(f"recall_at_{k}") for k in ks], F.percentile(rank, F.lit(0.5)).alias("median_rank"))


def greedy_spread(points: DataFrame, unit: str, radius: float) -> DataFrame:
    """Of each unit's points (x, y, rank), those kept when taken by rank and each bars others within the radius. A unit is one
    task's; for a ranked review list it is the list."""

    def keep(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("rank")
        cells: dict[tuple[int, int], list[tuple[float, float]]] = {}
        kept = []
        for x, y in zip(frame.x, frame.y, strict=True):
            cx, cy = int(x // radius), int(y // radius)
            near = (p for dx in (-1, 0, 1) for dy in (-1, 0, 1) for p in cells.get((cx + dx, cy + dy), ()))
            free = all((x - a) ** 2 + (y - b) ** 2 > radius * radius for a, b in near)
            kept.append(free)
            if free:
                cells.setdefault((cx, cy), []).append((x, y))
        return frame[kept]

    return points.groupBy(unit).applyInPandas(keep, points.schema)


def interleaved(*lists: DataFrame) -> DataFrame:
    """Ranked lists (key, rank) dealt one by one: each key once, at its best place; the earlier list first."""
    out = None
    for i, df in enumerate(lists):
        one = df.select("key", (F.col("rank") * len(lists) + i).alias("place"), F.lit(i).alias("list"))
        out = one if out is None else out.union(one)
    best = out.groupBy("key").agg(F.min("place").alias("place"), F.min_by("list", "place").alias("list"))
    return global_rank(best, "rank", "place")


#: Queries that are broadcast at once.
QUERY_BLOCK = 1_000


def against(pool: DataFrame, queries: DataFrame, *keys: str) -> DataFrame:
    """Every row of pool with every query: a stated set of queries, broadcast in blocks of a bounded number, a pass over the pool for each."""
    blocks = max(1, -(-queries.count() // QUERY_BLOCK))
    if blocks == 1:
        return pool.join(F.broadcast(queries))
    dealt = queries.withColumn("_block", F.pmod(F.xxhash64(*keys), F.lit(2 * blocks)))  # twice as many, so that none is much larger than a block
    out = None
    for i in range(2 * blocks):
        part = pool.join(F.broadcast(dealt.where(F.col("_block") == i).drop("_block")))
        out = part if out is None else out.union(part)
    return out


def held_out_scores(tiles: DataFrame, label: str, site: str, vector: str) -> DataFrame:
    """Leave-one-site-out: for each (label, site) the mean of the label's vectors in other sites is held against all tiles but those. tiles with
    _label, _site and s, the cosine; a label of one site asks nothing."""
    flat = tiles.select(label, site, F.posexplode(vector).alias("i", "x"))
    own = flat.groupBy(label, site, "i").agg(F.sum(F.col("x").cast("double")).alias("s"), F.count(F.lit(1)).alias("n"))
    whole = own.groupBy(F.col(label).alias("_l"), F.col("i").alias("_i")).agg(F.sum("s").alias("ws"), F.sum("n").alias("wn"))
    rest = own.join(whole, (F.col(label) == F.col("_l")) & (F.col("i") == F.col("_i"))).where("wn > n")
    queries = rest.groupBy(F.col(label).alias("_label"), F.col(site).alias("_site")).agg(F.array_sort(F.collect_list(F.struct("i", ((F.col("ws") - F.col("s")) / (F.col("wn") - F.col("n"))).alias("x")))).alias("_q"))
    queries = queries.withColumn("_q", F.transform("_q", lambda e: e["x"]))
    pool = against(tiles, queries, "_label", "_site").where((F.col(label) != F.col("_label")) | (F.col(site) == F.col("_site")))
    return pool.withColumn("s", cosine(F.col(vector), F.col("_q"))).drop("_q", vector)


def first_hits(scores: DataFrame, query: list[str], key: str, score: str, hit: str) -> DataFrame:
    """Rank of the first hit of each query, ties by key: how many are better is counted, so that no task sorts a pool."""
    best = scores.where(hit).groupBy(*[F.col(q).alias(f"_{q}") for q in query]).agg(F.max(F.struct(F.col(score).alias("s"), (-F.col(key)).alias("k"))).alias("_best"))
    same = [F.col(q) == F.col(f"_{q}") for q in query]
    better = (F.col(score) > F.col("_best.s")) | ((F.col(score) == F.col("_best.s")) & (-F.col(key) > F.col("_best.k")))
    on = same[0]
    for c in same[1:]:
        on = on & c
    return scores.join(best, on).groupBy(*query).agg((F.count_if(better) + 1).alias("first_hit"))


def bootstrap_recall(hits: DataFrame, order: list[str], rank: str, k: int, draws: int) -> DataFrame:
    """One row low_k, high_k: the 95 percent interval of recall at k over resamples of the queries, drawn by md5 so that reruns agree. One row a query."""
    listed = hits.withColumn("_k", F.row_number().over(Window.orderBy(*order)) - 1)
    n = listed.agg(F.count(F.lit(1)).alias("n"))
    draw = listed.select("_k").crossJoin(n).withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))))
    pick = F.conv(F.substring(F.md5(F.concat(F.lit("boot|"), F.col("draw"), F.lit("|"), F.col("_k"))), 1, 8), 16, 10).cast("long") % F.col("n")
    drawn = draw.select("draw", pick.alias("_pick")).join(listed.select(F.col("_k").alias("_pick"), rank), "_pick")
    recalls = drawn.groupBy("draw").agg(F.avg((F.col(rank) <= k).cast("double")).alias("recall"))
    return recalls.agg(F.percentile("recall", F.lit(0.025)).alias(f"low_{k}"), F.percentile("recall", F.lit(0.975)).alias(f"high_{k}"))


def binned_auc(scores: DataFrame, query: list[str], score: str, hit: str, bins: int) -> DataFrame:
    """Area under the curve of each query: the share of (hit, other) pairs in the right order, of pairs in one bin half. Scores are counted in 1 / bins
    steps first, so a task orders 2 * bins counts and no pool."""
    counts = scores.groupBy(*query, F.floor(F.col(score) * bins).alias("bin")).agg(F.count_if(F.col(hit)).alias("pos"), F.count_if(~F.col(hit)).alias("neg"))
    below = F.coalesce(F.sum("neg").over(Window.partitionBy(*query).orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    summed = counts.withColumn("below", below).groupBy(*query).agg(F.sum(F.col("pos") * (F.col("below") + F.col("neg") / 2.0)).alias("won"), F.sum("pos").alias("p"), F.sum("neg").alias("n"))
    return summed.where("p * n > 0").select(*query, (F.col("won") / (F.col("p") * F.col("n")).cast("double")).alias("auc"))
