"""Annual land-cover screening."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Classes by code, and what counts as development and vegetation.
CLASSES = ("water", "trees", "grass", "flooded_vegetation", "crops", "shrub_and_scrub", "built", "bare", "snow_and_ice")
DEVELOPMENT = ("built", "bare")
VEGETATED = ("crops", "trees", "grass", "shrub_and_scrub")
# Code ranges of two land-cover products, inclusive.
NLCD_GROUPS = {
    "developed": [(21, 24)], "agriculture": [(81, 82)], "forest": [(41, 43)], "grass_shrub": [(51, 52), (71, 74)],
    "wetland": [(90, 90), (95, 95)], "barren": [(31, 31)], "water": [(11, 11)],
}
CDL_GROUPS = {
    "crops": [(1, 60), (66, 80), (204, 254)], "pasture_hay": [(61, 61), (176, 176)], "developed": [(121, 124)], "forest": [(63, 63), (141, 143)],
    "grass_shrub": [(64, 64), (152, 152)], "wetland": [(190, 190), (195, 195)], "barren": [(65, 65), (131, 131)], "water": [(83, 83), (87, 87), (111, 111)],
}


def class_shares(areas: DataFrame, unit: list[str], klass: str, area: str) -> DataFrame:
    """(unit, class, area) summed -> area and share in percent of the unit's total; null if that is 0."""
    summed = areas.groupBy(*unit, klass).agg(F.sum(area).alias("area"))
    return summed.withColumn("share", F.lit(100.0) * F.col("area") / F.nullif(F.sum("area").over(Window.partitionBy(*unit)), F.lit(0.0)))


def pivot_classes(shares: DataFrame, unit: list[str], klass: str, value: str, classes: list[str]) -> DataFrame:
    """One row a unit with a column for each class; first value of each, null if there is none."""
    return shares.groupBy(*unit).pivot(klass, classes).agg(F.first(value))


def breakpoints(signals: DataFrame, unit: str, year: str, signal: str) -> DataFrame:
    """Per unit: years, first signal, greatest yearly rise and its year, and the screening result.

    A rise is over the row before, also if years are missing. The first greatest rise counts; a NaN signal is null."""
    clean = F.when(~F.isnan(signal), F.col(signal))
    by_year = Window.partitionBy(unit).orderBy(year)
    rises = signals.select(unit, year, clean.alias("s")).withColumn("rise", F.col("s") - F.lag("s").over(by_year))
    out = rises.groupBy(unit).agg(
        F.count(F.lit(1)).alias("n_years"),
        F.min_by("s", year).alias("first_signal"),
        F.max("rise").alias("max_rise"),
        F.min_by(year, F.struct(-F.coalesce("rise", F.lit(-999.0)), F.col(year))).alias("max_year"),
    )
    return out.withColumn("result", breakpoint_class(F.col("first_signal"), F.col("max_rise")))


def breakpoint_class(first: Column, rise: Column, mature: float = 40.0, clear: float = 15.0) -> Column:
    return F.when((first >= mature) & (rise < clear), "mature_before_archive").when(rise >= clear, "candidate_breakpoint").otherwise("no_clear_breakpoint")


def review_priority(*rules: tuple[Column, str], default: str = "standard") -> Column:
    """Labels written one after the other: the last rule that holds wins."""
    out = F.lit(default)
    for holds, label in rules:
        out = F.when(holds, label).otherwise(out)
    return out


def code_group(code: Column, groups: dict[str, list[tuple[int, int]]]) -> Column:
    out = F.lit(None).cast("string")
    for name, ranges in groups.items():
        held = F.lit(False)
        for low, high in ranges:
            held = held | code.between(low, high)
        out = F.when(held, name).otherwise(out)
    return out
