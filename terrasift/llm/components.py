"""Connected components of a link table, for the near-duplicate operators."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize

MAX_ROUNDS = 60


def connected_components(links: DataFrame, name: str = "links") -> DataFrame:
    """(a long, b long) -> (node, component): of every node that has a link to another, the smallest node that it reaches.

    Alternates two star steps until the links stay the same: each node hands its larger neighbours to its smallest one, then
    each hands all its smaller neighbours to the smallest of them. That takes about log(longest path) rounds. Minima are
    pre-aggregated, the joins are plain shuffle joins that adaptive execution splits where a node has very many links, and
    each round is written to the shared folder, so lost executors cost one round at most. Nulls link with nothing."""
    smaller, larger = F.least("a", "b"), F.greatest("a", "b")
    links = links.where("a is not null and b is not null and a <> b").select(larger.alias("u"), smaller.alias("v")).distinct()
    links = materialize(links, name)
    state = _fingerprint(links)
    for _ in range(MAX_ROUNDS):
        if state[0] == 0:
            break
        both = links.union(links.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("x"), F.least("u", "m").alias("m"))
        stars = both.join(least, both.u == least.x).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = stars.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("x"), "m")
        moved = stars.join(least, stars.u == least.x).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        links = materialize(moved.union(least.select(F.col("x").alias("u"), F.col("m").alias("v"))).distinct(), name)
        was, state = state, _fingerprint(links)
        if was == state:
            break
    else:
        raise RuntimeError(f"links did not settle in {MAX_ROUNDS} rounds")
    roots = links.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return links.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)


def _fingerprint(links: DataFrame) -> tuple:
    row = links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
    return row[0], row[1]


class LocalForest:
    """Union-find over 0..n-1 whose labels are always roots; takes links in numpy batches."""

    def __init__(self, n: int):
        self.root = np.arange(n)

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        while True:
            x, y = self.root[a], self.root[b]
            low, high = np.minimum(x, y), np.maximum(x, y)
            open_ = low < high
            if not open_.any():
                return
            a, b, low, high = a[open_], b[open_], low[open_], high[open_]
            np.minimum.at(self.root, high, low)
            while True:
                up = self.root[self.root]
                if (up == self.root).all():
                    break
                self.root = up

    def links(self) -> tuple[np.ndarray, np.ndarray]:
        """Every member that is not its own root, with its root."""
        own = np.arange(len(self.root))
        member = own[self.root != own]
        return member, self.root[member]
