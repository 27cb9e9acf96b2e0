"""Incremental ingestion: each content is kept once, restarts go on where the checkpoint says."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


#: Folders of the sink by a hash of key and content: a batch reads those that it touches.
BUCKETS = 256


def run_available(spark: SparkSession, source: str, schema: StructType, sink: str, checkpoint: str, key: str, content: str) -> None:
    """Take in all Parquet files at source not yet seen and append the items whose (key, SHA-256) the sink does not hold.

    A batch that is run again after a failure appends nothing twice, for it is held against the sink first: against the columns key and hash
    of the folders that its own items go to."""

    def append(batch: DataFrame, _: int) -> None:
        fresh = batch.withColumn("sha256", F.sha2(F.col(content).cast("binary"), 256)).dropDuplicates([key, "sha256"])
        fresh = fresh.withColumn("bucket", F.pmod(F.xxhash64(key, "sha256"), F.lit(BUCKETS)).cast("int"))
        touched = [r.bucket for r in fresh.select("bucket").distinct().collect()]  # BUCKETS numbers at most
        path = spark._jvm.org.apache.hadoop.fs.Path(sink)
        if path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):  # the first batch finds no sink
            held = spark.read.parquet(sink).where(F.col("bucket").isin(touched)).select("bucket", key, "sha256")
            fresh = fresh.join(held, ["bucket", key, "sha256"], "left_anti")
        fresh.repartition("bucket").write.mode("append").partitionBy("bucket").parquet(sink)

    stream = spark.readStream.schema(schema).parquet(source)
    stream.writeStream.foreachBatch(append).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def windowed_counts(events: DataFrame, at: str, kind: str, width: str, late: str = "1 hour") -> DataFrame:
    """Counts by window and kind, of a stream (rows later than the watermark don't count) or a table."""
    marked = events.withWatermark(at, late) if events.isStreaming else events
    return marked.groupBy(F.window(at, width).alias("w"), kind).agg(F.count(F.lit(1)).alias("n")).select("w.start", "w.end", kind, "n")
