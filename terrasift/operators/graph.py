"""Groups of records that matches join."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

MAX_ROUNDS = 60
#: Links that one task joins by itself; more are joined in rounds.
ONE_TASK = 1 << 21


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, spark.checkpoint.dir. A session without one may use a temporary folder if it runs in this process
    alone; elsewhere executors would write to disks of their own, so that is refused."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.conf.get("spark.master", "")
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="terrasift-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base


def cut(df: DataFrame) -> DataFrame:
    """Written and read again in the shared checkpoint folder, so that plans don't grow with the rounds."""
    path = f"{shared_dir(df.sparkSession)}/graph-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, rows: int = 20_000) -> DataFrame:
    """df dealt out to all cores, `rows` a task at most, for work of much time a row: a small file is one task however long its rows take. What stands
    before is computed once, and not again in each expression that uses it."""
    spark = df.sparkSession
    return df.repartition(max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")), -(-df.count() // rows)))


class Forest:
    """Groups of 0..n-1 within a task: label(i) is the smallest that links join with i."""

    def __init__(self, n: int):
        self.root = np.arange(n)

    def labels(self, at: np.ndarray) -> np.ndarray:
        return self.root[at]

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        """Links a[k] with b[k]."""
        while len(a):
            x, y = self.root[a], self.root[b]
            low, high = np.minimum(x, y), np.maximum(x, y)
            open_ = low < high
            a, b, low, high = a[open_], b[open_], low[open_], high[open_]
            np.minimum.at(self.root, high, low)
            while len(a) and not ((up := self.root[self.root]) == self.root).all():
                self.root = up

    def links(self) -> tuple[np.ndarray, np.ndarray]:
        """Every member that is not its own label, with its label."""
        member = np.flatnonzero(self.root != np.arange(len(self.root)))
        return member, self.root[member]


def _kept(links: DataFrame) -> tuple[DataFrame, tuple]:
    """The links written, and what their number and the sum of their hashes were on the way, so that no job counts them."""
    seen = Observation()
    marked = links.observe(seen, F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")).alias("h"))
    kept = cut(marked)
    return kept, (seen.get["n"], seen.get["h"])


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links (u, v) of a task -> every node but the smallest of its group with that one."""
    if batches := list(batches):
        links = pa.Table.from_batches(batches)
        every = pc.unique(pa.chunked_array([*links.column("u").chunks, *links.column("v").chunks]))
        every = every.take(pc.array_sort_indices(every))
        forest = Forest(len(every))
        forest.add(*(pc.index_in(links.column(c), every).to_numpy() for c in "uv"))
        member, of = forest.links()
        yield from pa.table({"u": every.take(pa.array(member)), "v": every.take(pa.array(of))}).to_batches(65_536)


def components(nodes: DataFrame, edges: DataFrame, node: str = "node", a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): the smallest node that each reaches, itself if it has no edge. Any orderable node type.

    Links point from the larger to the smaller node. In a round each node hands its larger neighbours on to the smallest node that it is linked with, and
    then its other smaller neighbours to the smallest of these; about log of the longest path of rounds leave one link a node. Only linked
    nodes take part, and links that come to the same are one, so rounds get smaller; minima are pre-aggregated. A round reads what the one
    before wrote. Once they are ONE_TASK links at most, of texts or whole numbers, one task does the rest."""
    u, v = F.col(a), F.col(b)
    links, state = _kept(edges.where(u != v).select(F.greatest(u, v).alias("u"), F.least(u, v).alias("v")).distinct())
    for _ in range(MAX_ROUNDS):
        if not state[0]:
            break
        if state[0] <= ONE_TASK and isinstance(links.schema["u"].dataType, (T.StringType, T.LongType, T.IntegerType)):
            links = cut(links.coalesce(1).mapInArrow(_joined, links.schema))
            break
        both = links.union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy(F.col("u").alias("_u")).agg(F.min("v").alias("_m")).select("_u", F.least("_u", "_m").alias("_m"))
        handed = both.join(least, F.col("u") == F.col("_u")).where("v > u").select(F.col("v").alias("u"), F.col("_m").alias("v")).distinct()
        least = handed.groupBy(F.col("u").alias("_u")).agg(F.min("v").alias("_m"))
        beside = handed.join(least, F.col("u") == F.col("_u")).where("v <> _m").select(F.col("v").alias("u"), F.col("_m").alias("v"))
        was = state
        links, state = _kept(beside.union(least.select("_u", "_m")).distinct())
        if was == state:
            break
    else:
        raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")
    every = nodes.select(F.col(node).alias("node")).distinct()
    return cut(every.join(links, F.col("node") == F.col("u"), "left").select("node", F.coalesce("v", "node").alias("component")))


def widened(nodes: DataFrame, left: DataFrame, right: DataFrame, left_node: str, right_node: str, radii: list[float], links: Callable[[DataFrame, DataFrame, float, Column | None], DataFrame]) -> DataFrame:
    """components() of the links between left and right up to the last of the growing radii, where all links are too many to be kept.

    links(left, right, radius, how) gives the links (a, b) of pairs within the radius for which `how` holds. Those of the first radius join most of what is
    dense; from then on only pairs of different groups are looked at, and links are between groups, so one link stays of all that join the same two."""
    labels, how = None, None
    for radius in radii:
        if labels is None:
            labels = components(nodes, links(left, right, radius, how))
            continue
        of = lambda df, node, name: df.join(labels.select(F.col("node").alias("_n"), F.col("component").alias(name)), F.col(node) == F.col("_n")).drop("_n")  # noqa: B023, E731
        found = links(of(left, left_node, "_lg"), of(right, right_node, "_rg"), radius, F.col("_lg") != F.col("_rg"))
        a, b = (labels.select(F.col("node").alias(f"_{x}"), F.col("component").alias(f"_g{x}")) for x in "ab")
        between = found.join(a, F.col("a") == F.col("_a")).join(b, F.col("b") == F.col("_b")).select(F.col("_ga").alias("a"), F.col("_gb").alias("b")).distinct()
        groups = components(labels.select(F.col("component").alias("node")), between).select(F.col("node").alias("_g"), F.col("component").alias("_c"))
        labels = cut(labels.join(groups, F.col("component") == F.col("_g")).select("node", F.col("_c").alias("component")))
    return labels


def numbered(labels: DataFrame, prefix: str, width: int, order: list | None = None) -> DataFrame:
    """labels with group_id: prefix and the rank of the component, in the given order (one aggregate each) or its own."""
    from .order import global_rank

    roots = labels.groupBy("component").agg(*(order or [F.min("component").alias("_o")]))
    keys = [c for c in roots.columns if c != "component"]
    ranked = global_rank(roots, "_rank", *keys, "component")
    return labels.join(ranked.select("component", F.concat(F.lit(prefix), F.lpad(F.col("_rank").cast("string"), width, "0")).alias("group_id")), "component")
