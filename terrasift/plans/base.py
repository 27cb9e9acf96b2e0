"""Registration of queries, and what several of them share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geo as G

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


class Tables:
    """The Parquet tables of a folder by name."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")


def query(name: str, sql: str | None = None):
    def add(f: Callable[[Tables], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if sql:
            ORACLES[name] = sql
        return f

    return add


def lon(key: Column, shift: float = 0.0) -> Column:
    return F.lit(-88.30) + F.pmod(key * 37, F.lit(1000)) * F.lit(0.00025) + F.lit(shift)


def lat(key: Column, shift: float = 0.0) -> Column:
    return F.lit(41.70) + F.pmod(key * 91, F.lit(997)) * F.lit(0.0002) + F.lit(shift)


def lon_sql(key: str, shift: float = 0.0) -> str:
    return f"(-88.30::DOUBLE + ({key} * 37 % 1000) * 0.00025::DOUBLE + {shift}::DOUBLE)"


def lat_sql(key: str, shift: float = 0.0) -> str:
    return f"(41.70::DOUBLE + ({key} * 91 % 997) * 0.0002::DOUBLE + {shift}::DOUBLE)"


def albers_sql(lon_: str, lat_: str) -> tuple[str, str]:
    d = lambda x: f"{x!r}::DOUBLE"
    s = f"sin(radians({lat_}))"
    q = f"({s} / (1 - {s} * {s} * {d(G.ECCENTRICITY2)}) - ln((1 - {s} * {d(G.ECCENTRICITY)}) / (1 + {s} * {d(G.ECCENTRICITY)})) / {d(2 * G.ECCENTRICITY)}) * {d(1 - G.ECCENTRICITY2)}"
    rho = f"(sqrt({d(G.ALBERS_C)} - {q} * {d(G.ALBERS_N)}) * {d(G.SEMI_MAJOR / G.ALBERS_N)})"
    theta = f"(radians({lon_} - {d(G.ORIGIN[1])}) * {d(G.ALBERS_N)})"
    return f"({rho} * sin({theta}))", f"({d(G.ALBERS_RHO0)} - {rho} * cos({theta}))"


def points(df: DataFrame, key: str, name: str = "point", dlon: float = 0.0, dlat: float = 0.0) -> DataFrame:
    """df with a projected point derived from its key."""
    return df.withColumn(name, G.albers(lon(F.col(key), dlon), lat(F.col(key), dlat)))


def points_sql(table: str, key: str, extra: str = "", dlon: float = 0.0, dlat: float = 0.0) -> str:
    x, y = albers_sql(lon_sql(key, dlon), lat_sql(key, dlat))
    return f"SELECT {key}{extra}, {x} AS x, {y} AS y FROM {table}"


def r_sql(x: str, digits: int = 4) -> str:
    s = f"{10**digits}::DOUBLE"
    return f"(floor(({x})::DOUBLE * {s} + 0.5::DOUBLE) / {s})"
