"""The corpus pipeline: language ID, near-dedup, decontamination, mixing and sharding of the documents table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from terrasift.llm.common import materialize, table
from terrasift.llm.decontam import decontaminate
from terrasift.llm.langid import accepted
from terrasift.llm.mixing import mixed_rows
from terrasift.llm.near_copies import near_copies, set_code_column
from terrasift.llm.sharding import SHARDS, shard_documents
from terrasift.llm.simhash import keep_one


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is determined."""
    return accepted(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that links of Jaccard similarity 0.8 over five-word shingles join."""
    return keep_one(docs, near_copies, set_code_column)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    return mixed_rows(docs)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Shard and slot of every row; copies of a document share its shard."""
    return shard_documents(docs, [1.0] * SHARDS)


STAGES = [("language_id", identify_language), ("near_dedup", drop_near_duplicates), ("decontamination", drop_contaminated), ("mixing", mix_sources), ("sharding", shard)]

#: Hashing by XXH64, a trained model and banded alignment cannot be said in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order, each over what the one before kept, written as Parquet between them."""
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialize(docs, name)
    return docs
