"""Helpers shared by the training-data operators."""

from __future__ import annotations

import contextlib
import os
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Rows that a worker is handed at once where rows hold whole texts.
TEXTS_AT_ONCE = 1_000
#: ASCII white space, as the contracts count words.
WORD = "[^\\x20\\x09-\\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, spark.checkpoint.dir. A session without one may use a temporary folder if it
    runs in this process alone; elsewhere executors would write to disks of their own, so that is refused."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.conf.get("spark.master", "").startswith("local") or spark.conf.get("spark.master").startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="terrasift-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base


def materialize(df: DataFrame, name: str = "t") -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: cuts lineage, survives lost executors, and
    gives later joins the true size."""
    path = os.path.join(shared_dir(df.sparkSession), f"terrasift-{uuid.uuid4().hex}", name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession, path: str) -> None:
    """Delete what was written below a folder of the shared one."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


@contextlib.contextmanager
def setting(spark: SparkSession, name: str, value: str) -> Iterator[None]:
    """A setting of the session that holds for what runs within."""
    before = spark.conf.get(name, None)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


class Scratch:
    """Tables of one call in a folder of their own below the shared one, deleted when the call ends or before by drop(); what result() writes stays.
    Each job's shuffle files go as the job ends: what a call needs of disk is its tables and its largest job, not all of its jobs."""

    def __init__(self, spark: SparkSession):
        self.spark, self.base, self.tables = spark, os.path.join(shared_dir(spark), f"terrasift-{uuid.uuid4().hex}"), []
        self.paths, self.held = {}, contextlib.ExitStack()

    def __enter__(self) -> Scratch:
        self.held.enter_context(setting(self.spark, "spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true"))
        return self

    def path(self, name: str) -> str:
        return os.path.join(self.base, f"{name}-{uuid.uuid4().hex[:8]}")

    def keep(self, df: DataFrame, name: str, *more: DataFrame) -> DataFrame:
        """df, and below it what else there is, each written by a job of its own."""
        path = self.path(name)
        for part in (df, *more):
            part.write.mode("append").parquet(path)
        kept = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(kept)] = (path, kept)
        return kept

    def drop(self, *kept: DataFrame) -> None:
        """Delete tables of keep() that nothing will read any more."""
        for df in kept:
            if id(df) in self.paths:
                discard(self.spark, self.paths.pop(id(df))[0])

    def result(self, df: DataFrame, name: str) -> DataFrame:
        return materialize(df, name)

    def __exit__(self, *_) -> None:
        self.held.close()
        for name in self.tables:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        discard(self.spark, self.base)


@contextlib.contextmanager
def small_batches(spark: SparkSession, rows: int) -> Iterator[None]:
    """Python workers are handed so many rows at a time at most, in what runs within: for rows that may be long texts."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = int(spark.conf.get(name))
    with setting(spark, name, str(min(rows, before) if before > 0 else rows)):
        yield


def bucketed(df: DataFrame, key: str, scratch: Scratch, name: str) -> DataFrame:
    """df, grouped by `key`, as a table in the scratch folder that is bucketed by it, so that joins on it move the other side only.
    It has as many buckets as shuffles have partitions, and so one file each."""
    spark = df.sparkSession
    table_name = f"{name}_{uuid.uuid4().hex}"
    scratch.tables.append(table_name)
    buckets = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    df.write.bucketBy(buckets, key).sortBy(key).option("path", scratch.path(name)).option("compression", "zstd").saveAsTable(table_name)
    return spark.table(table_name)


def numbered(df: DataFrame, scratch: Scratch, name: str, *order: Column | str) -> DataFrame:
    """df with each row's number from 1 in the given order. Rows are dealt out by ranges of the order and numbered within each; what comes before a
    range is a sum over one count per range, so no task holds them all. Rows that are equal in the order are in one range: end it with what tells
    rows apart."""
    columns = [F.col(o) if isinstance(o, str) else o for o in order]
    ranged = scratch.keep(df.repartitionByRange(*columns).withColumn("__part", F.spark_partition_id()), "ranged")
    before = F.coalesce(F.sum("__n").over(Window.orderBy("__of").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = ranged.groupBy(F.col("__part").alias("__of")).agg(F.count(F.lit(1)).alias("__n")).select("__of", before.alias("__before"))
    within = F.row_number().over(Window.partitionBy("__part").orderBy(*columns))
    joined = ranged.join(F.broadcast(offsets), F.col("__part") == F.col("__of"))  # a row for each partition of the shuffle
    return joined.withColumn(name, (F.col("__before") + within).cast("long")).drop("__part", "__of", "__before")


def plus(df: DataFrame, **new: Column) -> DataFrame:
    """df with new columns at the end; an input column of such a name gives way."""
    kept = [df[c] for c in df.columns if c not in new]
    return df.select(*kept, *[column.alias(name) for name, column in new.items()])


def hash32(*parts: Column | str) -> Column:
    """First 32 bits of an md5 of the parts as text: the same in every SQL engine. Null counts as a mark of its own."""
    text = F.concat_ws("|", *[F.coalesce((F.col(p) if isinstance(p, str) else p).cast("string"), F.lit("\u0000")) for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long")


def words_count(text: Column) -> Column:
    """Number of maximal runs of characters other than ASCII white space; null: 0."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")
