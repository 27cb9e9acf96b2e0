"""Exact quantiles of groups of any size."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .graph import cut

#: A group of so many values at most is put in order as it is.
SMALL = 100_000
BINS = 1_024


def _same(keys: list[str], prefix: str):
    on = F.lit(True)
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"{prefix}{k}"))
    return on


def _place(v: str):
    """Where a value stands by its sign and logarithm: never less for a greater value."""
    return F.when(F.col(v) == 0, 0.0).otherwise(F.signum(v) * (F.ln(F.abs(v)) + 746))


def exact_quantiles(df: DataFrame, keys: list[str], value: str, probabilities: list[float], small: int = SMALL, bins: int = BINS) -> DataFrame:
    """(keys, q): for each group the quantiles as an array, interpolated between the two values around; nulls and NaN are left out, a group without others
    has null.

    Groups of up to `small` values are put in order at once. For a larger one the values at the places sought are closed in: values between the
    bounds are counted in `bins` steps with each step's least and greatest value, and the step that a place falls into gives the next
    bounds, until both are one value. Steps are even in the logarithm where bounds are factors apart, so ten passes do for any values. Tasks send steps and never values, and nothing holds a group."""
    if not keys:  # one row, whatever the table
        found = exact_quantiles(df.select(F.lit(0).alias("_all"), value), ["_all"], value, probabilities, small, bins)
        return df.sparkSession.range(1).join(found, F.col("id") == F.col("_all"), "left").select("q")
    plain = df.select(*keys, F.col(value).cast("double").alias("_v"))
    sizes = cut(plain.groupBy(*keys).agg(F.count_if(F.col("_v").isNotNull() & ~F.isnan("_v")).alias("_n"), F.min(F.when(~F.isnan("_v"), F.col("_v"))).alias("_lo"), F.max(F.when(~F.isnan("_v"), F.col("_v"))).alias("_hi")))
    named = sizes.select(*[F.col(k).alias(f"_k_{k}") for k in keys], "_n", "_lo", "_hi")
    held = plain.where(F.col("_v").isNotNull() & ~F.isnan("_v"))
    few = named.where((F.col("_n") > 0) & (F.col("_n") <= small)).select(*[f"_k_{k}" for k in keys], F.lit(True).alias("_few"))
    out = held.join(few, _same(keys, "_k_")).groupBy(*keys).agg(F.percentile("_v", F.array(*[F.lit(float(p)) for p in probabilities])).alias("q"))
    none = sizes.where("_n = 0").select(*keys, F.lit(None).cast("array<double>").alias("q"))
    large = named.where(F.col("_n") > small)
    if large.isEmpty():
        return out.union(none)
    at = F.array(*[F.lit(float(p)) for p in probabilities])
    place = F.explode(F.array_distinct(F.flatten(F.transform(at, lambda p: F.array(F.floor(p * (F.col("_n") - 1)), F.ceil(p * (F.col("_n") - 1)))))))
    open_ = cut(large.select("*", place.alias("_at"), F.lit(0).cast("long").alias("_below")))
    found = None
    while True:
        done = open_.where("_lo = _hi").select(*[f"_k_{k}" for k in keys], "_at", F.col("_lo").alias("_found"))
        found = done if found is None else found.union(done)
        open_ = open_.where("_lo < _hi")
        if open_.isEmpty():
            break
        inside = held.join(open_, _same(keys, "_k_") & F.col("_v").between(F.col("_lo"), F.col("_hi")))
        step = F.floor((_place("_v") - _place("_lo")) / (_place("_hi") - _place("_lo")) * bins)
        near = F.floor((F.col("_v") - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) * bins)
        step = F.when(_place("_hi") - _place("_lo") > 1, step).otherwise(near)
        step = F.when(F.col("_v") == F.col("_hi"), bins).otherwise(F.least(step, F.lit(bins - 1))).cast("int")
        own = [f"_k_{k}" for k in keys]
        counts = inside.groupBy(*own, "_n", "_at", "_below", step.alias("_step")).agg(F.count(F.lit(1)).alias("_c"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
        before = F.col("_below") + F.coalesce(F.sum("_c").over(Window.partitionBy(*own, "_at").orderBy("_step").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        placed = counts.withColumn("_b", before).where((F.col("_b") <= F.col("_at")) & (F.col("_at") < F.col("_b") + F.col("_c")))
        open_ = cut(placed.select(*own, "_n", "_lo", "_hi", "_at", F.col("_b").alias("_below")))
    values = F.map_from_entries(F.collect_list(F.struct("_at", "_found")))
    sought = found.join(large.select(*[F.col(f"_k_{k}").alias(f"_g_{k}") for k in keys], F.col("_n").alias("_of")), _join_on(keys)).groupBy(*[f"_k_{k}" for k in keys], "_of").agg(values.alias("_values"))
    spot = lambda p: p * (F.col("_of") - 1)
    value_at = lambda place: F.element_at("_values", place.cast("long"))
    between = lambda p: F.when(value_at(F.floor(spot(p))) == value_at(F.ceil(spot(p))), value_at(F.floor(spot(p)))).otherwise((F.ceil(spot(p)) - spot(p)) * value_at(F.floor(spot(p))) + (spot(p) - F.floor(spot(p))) * value_at(F.ceil(spot(p))))
    many = sought.select(*[F.col(f"_k_{k}").alias(k) for k in keys], F.array(*[between(F.lit(float(p))) for p in probabilities]).alias("q"))
    return out.union(many).union(none)


def _join_on(keys: list[str]):
    on = F.lit(True)
    for k in keys:
        on = on & F.col(f"_k_{k}").eqNullSafe(F.col(f"_g_{k}"))
    return on
