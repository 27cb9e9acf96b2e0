"""Operator 1: mixing sources to target weights by systematic sampling, in DataFrame operations only."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import hash32, materialize, table, words_count

WEIGHTS = (5.0, 2.0, 1.0)
SHARE = 1.5
MAX_REPEAT = 2.0
SEED = 42
#: A cell of the ordering holds at most about rows / MIN_CELLS or CELL_ROWS rows, whichever is less.
MIN_CELLS = 256
CELL_ROWS = 1_000_000


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, max_repeat: float = MAX_REPEAT) -> DataFrame:
    """(source, size) -> source, source_size, target.

    Sources by code point, null last, take the weights in turn. Targets are min(max_repeat * size, level * weight), with the
    one level at which they sum to share of everything: what resharing the excess by weight ends in. With the first k sources
    by size / weight at their limit, some level gives the right sum; no such k asks for more than the true one, so the level is
    the greatest of these. The windows run over one row per source."""
    totals = sizes.groupBy("source").agg(F.sum("size").cast("long").alias("source_size"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    turn = F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights)))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (turn + 1).cast("int"))
    totals = totals.withColumn("weight", weight).withColumn("_limit", F.lit(float(max_repeat)) * F.col("source_size"))
    totals = totals.withColumn("_full_at", F.col("_limit") / F.col("weight"))
    order = Window.orderBy("_full_at", F.col("source").asc_nulls_last())
    full_before = F.coalesce(F.sum("_limit").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    weight_left = F.sum("weight").over(order.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    everything = Window.partitionBy()
    totals = totals.withColumn("_level", (F.lit(float(share)) * F.sum("source_size").over(everything) - full_before) / weight_left)
    level = F.max("_level").over(everything)
    return totals.withColumn("target", F.least(F.col("_limit"), F.coalesce(level, F.lit(float("inf"))) * F.col("weight"))).select("source", "source_size", "target")


def _size_bin(size: Column) -> Column:
    """Four bins an octave, from integer steps only."""
    bits = F.length(F.bin(size))
    return F.when(size < 8, size).otherwise(bits * 8 + F.expr("shiftright(size, cast(length(bin(size)) - 3 as int))")).cast("int")


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, max_repeat: float = MAX_REPEAT, seed: int = SEED, id_col: str = "doc_id", whole: bool = False) -> DataFrame:
    """docs (id_col, source, text) -> id_col, source, size, source_size, target, copies: how often each row is taken. With `whole` the row itself
    goes along as struct `row`.

    Systematic sampling. Rows of a source stand in an order by size (bins, then hash cells where a bin is large, then size
    and hash); each expects target / source_size copies; the running sum plus one random offset per source crosses as many
    integers as the row has copies. Neighbours in the order are of like size, so the words taken come near the target, and no
    row is taken more than ceil(max_repeat) times. The offset and the order come from md5, so reruns agree.

    No task holds a source: rows are ranked in cells of (source, bin, salt), of which a large bin gets as many as its count
    asks for; the cells' counts are summed per source, a few hundred rows each. The table of large bins is broadcast: it has
    fewer rows than there are cells. Null source is a source of its own; null or empty text has size 0 and costs nothing;
    repeated rows are rows; an empty table gives an empty result."""
    sized = materialize(docs.select(F.col(id_col), F.col("source"), words_count(F.col("text")).alias("size")), "sized")
    n = sized.count()
    cells = max(MIN_CELLS, math.ceil(n / CELL_ROWS))
    most = max(1, n // cells)
    sized = sized.withColumn("_bin", _size_bin(F.col("size"))).withColumn("_h", hash32(F.lit(f"order:{seed}"), F.col(id_col)))
    large = sized.groupBy(F.col("source").alias("_ls"), F.col("_bin").alias("_lb")).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > most)
    large = large.select("_ls", "_lb", F.ceil(F.col("_n") / F.lit(most)).cast("long").alias("_salts"))
    sized = sized.join(F.broadcast(large), F.col("source").eqNullSafe(F.col("_ls")) & (F.col("_bin") == F.col("_lb")), "left")
    sized = sized.withColumn("_salt", F.pmod("_h", F.coalesce("_salts", F.lit(1)))).drop("_ls", "_lb", "_salts")
    before = Window.partitionBy("_cs").orderBy("_cb", "_ct").rowsBetween(Window.unboundedPreceding, -1)
    counts = sized.groupBy(F.col("source").alias("_cs"), F.col("_bin").alias("_cb"), F.col("_salt").alias("_ct")).agg(F.count(F.lit(1)).alias("_n"))
    counts = counts.select("_cs", "_cb", "_ct", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    slim = sized
    if whole:  # bins and salts are the slim table's; ties among rows of one id are broken by what they say
        sized = docs.select(F.col(id_col), F.col("source"), words_count(F.col("text")).alias("size"), F.struct(*docs.columns).alias("row"))
        sized = sized.withColumn("_bin", _size_bin(F.col("size"))).withColumn("_h", hash32(F.lit(f"order:{seed}"), F.col(id_col)))
        sized = sized.join(F.broadcast(large), F.col("source").eqNullSafe(F.col("_ls")) & (F.col("_bin") == F.col("_lb")), "left")
        sized = sized.withColumn("_salt", F.pmod("_h", F.coalesce("_salts", F.lit(1)))).drop("_ls", "_lb", "_salts")
    targets = source_targets(slim.select("source", "size"), weights, share, max_repeat).withColumnRenamed("source", "_ts")
    cell_facts = counts.join(targets, F.col("_cs").eqNullSafe(F.col("_ts"))).drop("_ts")
    if whole:  # written, so that its true size says how it is joined with the rows
        cell_facts = materialize(cell_facts, "cells")
    in_cell = Window.partitionBy("source", "_bin", "_salt").orderBy("size", "_h", id_col, *([F.xxhash64("row.text")] if whole else []))
    ranked = sized.withColumn("_rank", F.row_number().over(in_cell))
    out = ranked.join(cell_facts, F.col("source").eqNullSafe(F.col("_cs")) & (F.col("_bin") == F.col("_cb")) & (F.col("_salt") == F.col("_ct")))
    expected = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    offset = hash32(F.lit(f"offset:{seed}"), F.col("source")) / F.lit(float(2**32))
    upto = F.floor(offset + expected * (F.col("_before") + F.col("_rank")))
    prior = F.floor(offset + expected * (F.col("_before") + F.col("_rank") - 1))
    copies = F.least(upto - prior, F.lit(math.ceil(max_repeat)))  # a running sum of doubles may be off by one where it is huge
    return out.select(id_col, "source", "size", "source_size", "target", copies.cast("long").alias("copies"), *(["row"] if whole else []))


def mixed_rows(docs: DataFrame, id_col: str = "doc_id", **how) -> DataFrame:
    """The mix itself: every row of docs as often as it is taken, all columns kept. Each row carries its own number of copies, so repeated and
    null ids change nothing."""
    taken = mix(docs, id_col=id_col, whole=True, **how).where("copies > 0")
    return taken.select("row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).select("row.*")


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents: size, the size and target of their source, and the words that the mix takes of them."""
    out = mix(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


OP1_SQL = """
WITH sized AS (
  SELECT doc_id, source, CAST(CASE WHEN text IS NULL THEN 0 ELSE len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')) END AS BIGINT) AS size FROM documents
), binned AS (
  SELECT *, CAST(CASE WHEN size < 8 THEN size ELSE length(bin(size)) * 8 + (size >> (length(bin(size)) - 3)) END AS INT) AS bin,
    CAST('0x' || substr(md5('order:42' || '|' || coalesce(CAST(doc_id AS VARCHAR), chr(0))), 1, 8) AS BIGINT) AS h,
    greatest(1, (SELECT count(*) FROM sized) // greatest(256, CAST(ceil((SELECT count(*) FROM sized) / 1000000.0) AS BIGINT))) AS most
  FROM sized
), salted AS (
  SELECT *, h % CASE WHEN count(*) OVER (PARTITION BY source, bin) > most THEN CAST(ceil(count(*) OVER (PARTITION BY source, bin) / CAST(most AS DOUBLE)) AS BIGINT) ELSE 1 END AS salt FROM binned
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY bin, salt, size, h, doc_id NULLS FIRST) AS pos,
    CAST('0x' || substr(md5('offset:42' || '|' || coalesce(source, chr(0))), 1, 8) AS BIGINT) / CAST(4294967296 AS DOUBLE) AS off
  FROM salted
), totals AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
weighted AS (
  SELECT *, CASE (row_number() OVER (ORDER BY source COLLATE "C" NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight,
    2.0::DOUBLE * source_size AS lim FROM totals
), levels AS (
  SELECT *, lim / weight AS full_at,
    (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(lim) OVER (ORDER BY lim / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0::DOUBLE))
      / sum(weight) OVER (ORDER BY lim / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lvl
  FROM weighted
), targets AS (
  SELECT source, source_size, least(lim, (SELECT max(lvl) FROM levels) * weight) AS target FROM levels
)
SELECT doc_id, size, source_size, target,
  CAST(size * least(2, floor(off + rate * pos) - floor(off + rate * (pos - 1))) AS BIGINT) AS taken
FROM (SELECT r.doc_id, r.size, t.source_size, t.target, r.off, r.pos, CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0 END AS rate
      FROM ranked r JOIN targets t ON r.source IS NOT DISTINCT FROM t.source)
"""
