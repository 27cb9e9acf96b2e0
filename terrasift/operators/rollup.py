"""Counts, completed series, top lists and checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def value_counts(df: DataFrame, value: str, order: str) -> DataFrame:
    """Values by falling count, equals by first appearance."""
    return df.groupBy(value).agg(F.count(F.lit(1)).alias("n"), F.min(order).alias("first_seen"))


def complete_keys(keys: DataFrame, facts: DataFrame, on: list[str], fill: dict[str, object]) -> DataFrame:
    """Every key with its facts, or with the given values if it has none."""
    return keys.join(facts, on, "left").na.fill(fill)


def gap_filled(counts: DataFrame, at: str, n: str) -> DataFrame:
    """Integer series from its first to its last value, 0 where nothing is."""
    ends = counts.agg(F.min(at).alias("low"), F.max(at).alias("high")).where("low is not null")
    every = ends.select(F.explode(F.sequence("low", "high")).alias(at))
    return every.join(counts, at, "left").na.fill({n: 0})


def list_members(df: DataFrame, column: str, sep: str = ";") -> DataFrame:
    """One row for each trimmed, non-empty member of a delimited list, as `member`."""
    return df.withColumn("member", F.explode(F.split(column, sep))).withColumn("member", F.trim("member")).where("member <> ''")


def top(df: DataFrame, n: int, *order: Column) -> DataFrame:
    """First n rows of an order with their rank; sorted per task before they meet."""
    return df.orderBy(*order).limit(n).withColumn("rank", F.row_number().over(Window.orderBy(*order)))


def missing(expected: DataFrame, actual: DataFrame, on: list[str]) -> DataFrame:
    return expected.join(actual, on, "left_anti")


def require_none(df: DataFrame, message: str) -> None:
    """Raise if the table has a row."""
    if (row := df.first()) is not None:
        raise AssertionError(f"{message}: {row.asDict()}")


def checks(*named: tuple[str, DataFrame]) -> DataFrame:
    """(check, passed) of one-row, one-column tables of booleans."""
    out = None
    for name, df in named:
        one = df.select(F.lit(name).alias("check_name"), F.col(df.columns[0]).alias("passed"))
        out = one if out is None else out.union(one)
    return out
