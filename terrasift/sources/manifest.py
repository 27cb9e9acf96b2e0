"""Which items of a listing are still to be fetched, and which held ones nobody lists."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def todo(desired: DataFrame, held: DataFrame, key: str, version: str) -> DataFrame:
    """Desired items that are not held (`new`) or held in another version (`changed`)."""
    have = held.select(F.col(key).alias("_k"), F.col(version).alias("_v"))
    joined = desired.join(have, F.col(key) == F.col("_k"), "left")
    stale = joined.where(~F.col(version).eqNullSafe(F.col("_v")))
    return stale.withColumn("reason", F.when(F.col("_k").isNull(), "new").otherwise("changed")).drop("_k", "_v")


def orphans(desired: DataFrame, held: DataFrame, key: str) -> DataFrame:
    """Held items that are no longer desired."""
    return held.join(desired.select(key), key, "left_anti")


def verified(contents: DataFrame, manifest: DataFrame, key: str) -> DataFrame:
    """manifest with whether each item's content (key, content) has the size and SHA-256 that it states."""
    facts = contents.select(F.col(key).alias("_k"), F.length("content").alias("_size"), F.sha2("content", 256).alias("_sha"))
    good = (F.col("_size") == F.col("size")) & (F.col("_sha") == F.col("sha256"))
    return manifest.join(facts, F.col(key) == F.col("_k"), "left").withColumn("verified", F.coalesce(good, F.lit(False))).drop("_k", "_size", "_sha")


def documents_of(manifests: DataFrame) -> DataFrame:
    """One row per document of manifests read as JSON (agency_id, documents)."""
    return manifests.select("agency_id", F.posexplode("documents").alias("document_no", "d")).select("agency_id", (F.col("document_no") + 1).alias("document_no"), "d.*")
