"""Operator 6: sharding by weighted rendezvous hashing of stable record keys."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import hash32, materialize, table

#: Rows that one numbering task orders, at most about.
SLOT_ROWS = 200_000
MIN_CELLS = 64
#: Bounds the broadcast count table: at most so many rows a shard.
MAX_CELLS = 8192
#: Hex digits of an md5 that a draw between 0 and 1 is made of: a double holds so many exactly.
DIGITS = 13


def rendezvous(key: Column, weights: list[float]) -> Column:
    """Shard with the highest score -weight / ln(u), u drawn from (key, shard). A shard's scores do not depend on the others,
    so one more shard only takes keys into itself. Shards of weight 0 take none. A null key is a key of its own."""
    if not weights or any(w < 0 or not math.isfinite(w) for w in weights) or not any(weights):
        raise ValueError("weights: finite, not negative, at least one above 0")
    text = F.coalesce(key.cast("string"), F.lit("\u0000null"))
    scored = []
    for shard, weight in enumerate(weights):
        if weight > 0:
            digits = F.substring(F.md5(F.concat(F.lit(f"shard|{shard}|"), text)), 1, DIGITS)
            u = (F.conv(digits, 16, 10).cast("double") + 0.5) / F.lit(float(16**DIGITS))
            scored.append(F.struct((F.lit(-float(weight)) / F.ln(u)).alias("score"), F.lit(-shard).alias("shard")))
    best = F.greatest(*scored) if len(scored) > 1 else scored[0]
    return (-best["shard"]).cast("int")


def gapless_slots(df: DataFrame, shard: str, order: list[str], out: str = "slot") -> DataFrame:
    """Number the rows of each shard from 0 without gaps, in cells of a bounded number of rows.

    Each shard is cut into hash cells of the order columns; cells are counted (with partial sums), their offsets summed
    over the few rows of the count table, and rows numbered within a cell only. Rows equal in all order columns are told
    apart by nothing, so which of them gets which number is open. Empty input gives an empty result."""
    cells = min(MAX_CELLS, max(MIN_CELLS, math.ceil(df.count() / SLOT_ROWS)))
    df = df.withColumn("_cell", (hash32(F.lit("cell"), *order) % cells).cast("int"))
    before = Window.partitionBy(shard).orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    offsets = df.groupBy(shard, "_cell").agg(F.count(F.lit(1)).alias("_n")).select(shard, "_cell", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    within = F.row_number().over(Window.partitionBy(shard, "_cell").orderBy(*order))
    return df.withColumn("_rank", within).join(F.broadcast(offsets), [shard, "_cell"]).withColumn(out, (F.col("_before") + F.col("_rank") - 1).cast("long")).drop("_cell", "_rank", "_before")


def shard_documents(docs: DataFrame, weights: list[float], key: str = "doc_id", grown: list[float] | None = None) -> DataFrame:
    """docs (with key and text) -> key, size, text_crc32, shard, slot, and grown_shard if the weights of a larger set are given.

    size: UTF-8 bytes of the text (null: none) plus 1; text_crc32 of null is that of the empty text. Rows of one key go to
    one shard, repeated rows included; a null key is a key too. Only slim columns leave the scan."""
    slim = docs.select(
        F.col(key).alias("doc_id"),
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.encode(F.coalesce(F.col("text"), F.lit("")), "UTF-8")).alias("text_crc32"),
    )
    out = slim.withColumn("shard", rendezvous(F.col("doc_id"), weights))
    out = out.withColumn("grown_shard", rendezvous(F.col("doc_id"), grown) if grown else F.lit(None).cast("int"))
    return gapless_slots(materialize(out, "sharded"), "shard", ["doc_id", "text_crc32", "size"])


SHARDS = 8


def op6_rendezvous_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents over 8 shards of equal weight under the law `key`."""
    return _digest(table(spark, sf_dir, "documents"))


def _digest(docs: DataFrame) -> DataFrame:
    out = shard_documents(docs, [1.0] * SHARDS, grown=[1.0] * (SHARDS + 1))
    return out.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


#: The same in SQL; the checksum goes byte by byte through a table made by its rule.
OP6_SQL = f"""
WITH crc_table AS (SELECT list(list_reduce(range(8), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END, i) ORDER BY i) AS t FROM (SELECT unnest(range(256))::BIGINT AS i)),
bytes AS (SELECT doc_id, coalesce(text, '') AS text, hex(encode(coalesce(text, ''))) AS h FROM documents),
sized AS (
  SELECT doc_id, CAST(length(h) // 2 + 1 AS BIGINT) AS size,
    xor(4294967295, list_reduce(list_transform(range(length(h) // 2), lambda i: CAST('0x' || substr(h, CAST(2 * i + 1 AS BIGINT), 2) AS BIGINT)), lambda c, b: xor(c >> 8, t[CAST(xor(c, b) & 255 AS BIGINT) + 1]), 4294967295::BIGINT)) AS text_crc32
  FROM bytes, crc_table
),
scored AS (
  SELECT doc_id, s AS shard, -1 / ln((CAST(CAST('0x' || substr(md5('shard|' || s || '|' || coalesce(CAST(doc_id AS VARCHAR), chr(0) || 'null')), 1, {DIGITS}) AS BIGINT) AS DOUBLE) + 0.5) / {16**DIGITS}::DOUBLE) AS score
  FROM (SELECT DISTINCT doc_id FROM documents), range({SHARDS + 1}) r(s)
),
drawn AS (SELECT doc_id, arg_max(shard, score) FILTER (WHERE shard < {SHARDS}) AS shard, arg_max(shard, score) AS grown_shard FROM scored GROUP BY doc_id),
celled AS (
  SELECT z.*, d.shard, d.grown_shard,
    CAST('0x' || substr(md5('cell|' || coalesce(CAST(z.doc_id AS VARCHAR), chr(0)) || '|' || text_crc32 || '|' || size), 1, 8) AS BIGINT) % least({MAX_CELLS}, greatest({MIN_CELLS}, CAST(ceil((SELECT count(*) FROM documents) / {SLOT_ROWS}.0) AS BIGINT))) AS cell
  FROM sized z JOIN drawn d ON z.doc_id IS NOT DISTINCT FROM d.doc_id
)
SELECT doc_id, size, text_crc32, 'key' AS law, CAST(shard AS INT) AS shard,
  row_number() OVER (PARTITION BY shard ORDER BY cell, doc_id NULLS FIRST, text_crc32, size) - 1 AS slot, CAST(grown_shard AS INT) AS grown_shard
FROM celled
"""
