"""Numbering of all rows in one order, without one task that holds them all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .graph import cut


def global_rank(df: DataFrame, name: str, *order: Column | str) -> DataFrame:
    """df with the row's number from 1 in the given order, which should be total. Rows are dealt out by ranges of the order and numbered within each;
    what comes before a range is a sum over one count per range."""
    columns = [F.col(o) if isinstance(o, str) else o for o in order]
    ranged = cut(df.repartitionByRange(*columns).withColumn("__part", F.spark_partition_id()))
    counts = ranged.groupBy(F.col("__part").alias("__of")).agg(F.count(F.lit(1)).alias("__n"))
    before = F.coalesce(F.sum("__n").over(Window.orderBy("__of").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = F.broadcast(counts.select("__of", before.alias("__before")))  # a row a partition of the shuffle
    within = F.row_number().over(Window.partitionBy("__part").orderBy(*columns))
    return ranged.join(offsets, F.col("__part") == F.col("__of")).withColumn(name, (F.col("__before") + within).cast("long")).drop("__part", "__of", "__before")


def running_total(df: DataFrame, name: str, amount: str, *order: Column | str) -> DataFrame:
    """df with the sum of `amount` over all rows before, in the given order, which should be total: ranges of the order are summed by themselves, and
    what comes before a range is a sum over one total per range."""
    columns = [F.col(o) if isinstance(o, str) else o for o in order]
    ranged = cut(df.repartitionByRange(*columns).withColumn("__part", F.spark_partition_id()))
    totals = ranged.groupBy(F.col("__part").alias("__of")).agg(F.sum(amount).alias("__sum"))
    offsets = F.broadcast(totals.select("__of", F.coalesce(F.sum("__sum").over(Window.orderBy("__of").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before")))
    within = F.coalesce(F.sum(amount).over(Window.partitionBy("__part").orderBy(*columns).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return ranged.join(offsets, F.col("__part") == F.col("__of")).withColumn(name, F.col("__before") + within).drop("__part", "__of", "__before")
