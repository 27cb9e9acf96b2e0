"""Which record of a group stands for it, and what the group says."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Order in which source layers are trusted.
PRIORITY = {"campus": 0, "building": 1, "point": 2, "curated": 3, "registry": 4}


def first_wins(df: DataFrame, keys: list, order: list) -> DataFrame:
    """The first row of each key in a total order."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")


def first_of(df: DataFrame, keys: list[str], columns: list[str], order: list[Column]) -> DataFrame:
    """The columns of each key's first row in a total order, of the first ones of each task, so that no task sorts a large group."""
    return df.groupBy(*keys).agg(F.min_by(F.struct(*columns), F.struct(*order)).alias("_first")).select(*keys, "_first.*")


def priority(layer: Column) -> Column:
    ranks = F.create_map(*[F.lit(x) for pair in PRIORITY.items() for x in pair])
    return F.coalesce(F.element_at(ranks, layer), F.lit(9))


def joined(values: Column, sep: str = "|") -> Column:
    """Distinct non-empty values of a group, sorted."""
    return F.array_join(F.array_sort(F.collect_set(F.nullif(values, F.lit("")))), sep)


def first_nonempty(value: Column, order: Column) -> Column:
    """First value of a group, in an order, that is neither null nor empty."""
    return F.min_by(value, F.when(value.isNotNull() & (value != ""), order))


def confidence(sources: Column, primary_layer: Column) -> Column:
    """How sure the place of a group is."""
    return F.when(F.size(sources) > 1, "multi_source").when(primary_layer == "curated", "curated_location").otherwise("single_source_geometry")


def summarize(records: DataFrame) -> DataFrame:
    """records (group_id, record_id, layer, source, name, operator, status, ord) -> one row a group."""
    order = F.struct(priority(F.col("layer")).alias("p"), F.when(F.col("name") != "", 0).otherwise(1).alias("n"), F.col("ord"))
    grouped = records.groupBy("group_id").agg(
        F.count(F.lit(1)).alias("members"),
        F.min_by("record_id", order).alias("primary_id"),
        F.min_by("layer", order).alias("primary_layer"),
        F.coalesce(first_nonempty(F.col("name"), order), F.lit("")).alias("name"),
        F.coalesce(first_nonempty(F.col("operator"), order), F.lit("")).alias("operator"),
        joined(F.col("name")).alias("names"),
        joined(F.col("source")).alias("sources"),
        joined(F.when(F.col("layer") == "curated", F.col("status"))).alias("statuses"),
        F.bool_or((F.col("layer") != "curated") | (F.lower(F.trim("status")) == "operating")).alias("is_built"),
        F.bool_or((F.col("layer") == "curated") & (F.lower(F.trim("status")) != "operating")).alias("is_pipeline"),
    )
    return grouped.withColumn("confidence", confidence(F.split("sources", "[|]"), F.col("primary_layer"))).withColumn("status_summary", F.when(F.col("statuses") == "", "Operating/inferred").otherwise(F.col("statuses")))
