"""Operator 13: importance resampling towards a target distribution, by hashed n-gram buckets that DuckDB counts in each partition."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, numbered, plus, table

MAX_N = 1
BUCKETS = 10_000
SEED = "2024"
LEAST_WORDS = 20
PERCENT = 10
#: Characters that one DuckDB query reads at most, but for a longer word; a longer text is read in pieces.
CHUNK = 4_000_000
MEMORY = "600MB"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Words, once A-Z are lower-cased.
FEATURE_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: The same in a text whose A-Z are not lower-cased yet, and what stands between them.
CASED_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_WORD = re.compile(CASED_WORD)
_GAP = re.compile(r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]")


def pieces(text: str, max_n: int, chunk: int) -> Iterator[tuple[str, int]]:
    """(piece, extra): the text cut between words into pieces of about `chunk` characters; each but the last goes on for the max_n - 1 words that
    runs beginning in it may reach into, and `extra` says how many words that are."""
    at = 0
    while at < len(text):
        gap = _GAP.search(text, at + chunk)
        end = gap.start() if gap else len(text)
        extra, stop = 0, end
        for word in _WORD.finditer(text, end):
            if extra == max_n - 1:
                break
            extra, stop = extra + 1, word.end()
        yield text[at:stop], extra
        at = end


def bucket_sql(max_n: int, buckets: int) -> str:
    """(r, bucket, n) of the table `chunk` (r, piece, extra, text): how often features of row r fall into each bucket; bucket -1 counts words."""
    runs = ["w"] + [" || ' ' || ".join(["w"] + [f"lead(w, {i}) OVER doc" for i in range(1, n)]) for n in range(2, max_n + 1)]
    grams = "\nUNION ALL ".join(f"SELECT r, pos <= own AS starts, {run} AS g FROM words" + " WINDOW doc AS (PARTITION BY r, piece ORDER BY pos)" * (i > 0) for i, run in enumerate(runs))
    return f"""
WITH split AS (SELECT r, piece, extra, regexp_extract_all(text, '{CASED_WORD}') AS ws FROM chunk),
words AS (SELECT r, piece, len(ws) - extra AS own, unnest(ws) AS w, generate_subscripts(ws, 1) AS pos FROM split),
grams AS ({grams}),
features AS (SELECT r, g, count(*) AS n FROM grams WHERE starts AND g IS NOT NULL GROUP BY r, g),
hashed AS (SELECT g, feature_crc(g) % {buckets} AS bucket FROM (SELECT DISTINCT g FROM features))
SELECT r, CAST(bucket AS BIGINT) AS bucket, CAST(sum(n) AS BIGINT) AS n FROM features JOIN hashed USING (g) GROUP BY ALL
UNION ALL SELECT r, -1, CAST(sum(len(ws) - extra) AS BIGINT) FROM split GROUP BY r"""


def _crc(words: pa.ChunkedArray) -> pa.Array:
    """CRC-32 of each feature with A-Z, and nothing else, lower-cased."""
    return pa.array((zlib.crc32(w.lower()) for w in words.cast(pa.binary()).to_pylist()), pa.int64())


def bucket_counts(docs: DataFrame, max_n: int = MAX_N, buckets: int = BUCKETS, key: str = "doc_id", chunk: int = CHUNK) -> DataFrame:
    """docs (key, text) -> key, n_words, n_features, buckets array<int>, counts array<long>, one row a document.

    Each task hands its texts to a DuckDB of its own in parts of a bounded size: unnested words, windows over them for runs of more than one, a
    registered function for zlib's CRC-32 of each different feature, and counts by bucket. Null text is empty."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import duckdb

        con = duckdb.connect(config={"threads": 1, "memory_limit": MEMORY})
        con.create_function("feature_crc", _crc, ["VARCHAR"], "BIGINT", type="arrow")
        sql = bucket_sql(max_n, buckets)

        def counted(rows: list[tuple]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            r, piece, extra, text = zip(*rows, strict=True)
            con.register("chunk", pa.table({"r": pa.array(r, pa.int64()), "piece": pa.array(piece, pa.int64()), "extra": pa.array(extra, pa.int64()), "text": pa.array(text, pa.string())}))
            out = con.sql(sql).fetchnumpy()
            con.unregister("chunk")
            return out["r"], out["bucket"], out["n"]

        for batch in batches:
            found, open_, size = [], [], 0
            for r, text in enumerate(batch.column(1)):
                for k, (piece, extra) in enumerate(pieces(text.as_py() or "", max_n, chunk)):
                    open_.append((r, k, extra, piece))
                    size += len(piece)
                    if size >= chunk:
                        found.append(counted(open_))
                        open_, size = [], 0
            if open_:
                found.append(counted(open_))
            cell = np.concatenate([f[0] * (buckets + 1) + f[1] + 1 for f in found] or [np.empty(0, np.int64)])
            cells, at = np.unique(cell, return_inverse=True)  # a text that queries shared is summed here
            n = np.zeros(len(cells), np.int64)
            np.add.at(n, at, np.concatenate([f[2] for f in found] or [np.empty(0, np.int64)]))
            row, bucket = cells // (buckets + 1), cells % (buckets + 1) - 1
            n_words = np.zeros(batch.num_rows, np.int64)
            n_words[row[bucket < 0]] = n[bucket < 0]
            row, bucket, n = (x[bucket >= 0] for x in (row, bucket, n))
            n_features = np.zeros(batch.num_rows, np.int64)
            np.add.at(n_features, row, n)
            ends = pa.array(np.searchsorted(row, np.arange(batch.num_rows + 1)), pa.int32())
            lists = [pa.ListArray.from_arrays(ends, pa.array(x)) for x in (bucket.astype(np.int32), n)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_words), pa.array(n_features), *lists], [key, "n_words", "n_features", "buckets", "counts"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, "text").mapInArrow(count, f"`{key}` {kind}, n_words long, n_features long, buckets array<int>, counts array<bigint>")


def bucket_totals(counted: DataFrame) -> DataFrame:
    """(bucket, n): the documents' counts merged; a task sends one row a bucket at most."""
    flat = counted.select(F.explode(F.arrays_zip("buckets", "counts")).alias("x"))
    return flat.groupBy(F.col("x.buckets").alias("bucket")).agg(F.sum("x.counts").alias("n"))


def bucket_gains(raw: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> list[int]:
    """floor(1000 ln((t+1)(S+B) / ((s+1)(T+B)))) of every bucket, from (bucket, n) of both; B numbers come to the driver."""
    own = raw.select("bucket", F.col("n").alias("s"), F.lit(0).cast("long").alias("t")).union(target.select("bucket", F.lit(0).cast("long"), "n"))
    rows = own.groupBy("bucket").agg(F.sum("s").alias("s"), F.sum("t").alias("t"))
    every = raw.sparkSession.range(buckets).join(rows, F.col("id") == F.col("bucket"), "left").select("id", *[F.coalesce(c, F.lit(0)).cast("double").alias(c) for c in "st"])
    sums = every.agg(F.sum("s").alias("all_s"), F.sum("t").alias("all_t"))
    ratio = ((F.col("t") + 1) * (F.col("all_s") + buckets)) / ((F.col("s") + 1) * (F.col("all_t") + buckets))
    gain = F.floor(F.lit(1000.0) * F.ln(ratio)).cast("long")
    return [g for _, g in sorted(every.crossJoin(sums).select("id", gain.alias("gain")).collect())]  # one row of sums


def floor_div(a: Column, b: Column) -> Column:
    """a / b rounded down, of longs with b > 0; null where b is not."""
    b = F.when(b > 0, b)
    return F.call_function("div", a - F.pmod(a, b), b)


def draw_score(key: Column, seed: str = SEED) -> Column:
    """floor(-1000 ln(-ln u)), u from sha256 of seed:key; a null key counts as an empty one."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("long")
    return F.floor(F.lit(-1000.0) * F.ln(-F.ln((h + F.lit(0.5)) / F.lit(4294967296.0)))).cast("long")


def resample(docs: DataFrame, target: DataFrame, max_n: int = MAX_N, buckets: int = BUCKETS, percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: str = SEED, key: str = "doc_id") -> DataFrame:
    """docs (key, text) -> key, n_words, n_features, weight, score, rank: each document's importance towards the texts of `target` (text), and the place
    of those drawn: the floor(percent * N / 100) highest scores of the N documents with least_words words, ties to the smaller key (null first).

    The bucket counts of each document are written as Parquet, so texts are read once; Spark merges them, and scores each document by the gains of its
    buckets. The number of documents by score (some ten thousand values, whatever the input) gives the score that still is drawn; only documents
    from there on are put in order, in ranges. Rows of one key are documents of their own; null or empty text has no features and weight 0; a target
    without features, or an empty table, gives the gains that the formula gives."""
    spark = docs.sparkSession
    with Scratch(spark) as scratch:
        counted = scratch.keep(bucket_counts(docs, max_n, buckets, key), "counts")
        wanted = scratch.keep(bucket_counts(target.select(F.lit(0).alias("item"), "text"), max_n, buckets, "item"), "target")
        gains = F.split(F.lit(",".join(map(str, bucket_gains(bucket_totals(counted), bucket_totals(wanted), buckets)))), ",").cast("array<bigint>")
        gained = F.aggregate(F.zip_with("buckets", "counts", lambda b, c: F.get(gains, b) * c), F.lit(0).cast("long"), lambda a, x: a + x)
        weight = F.coalesce(floor_div(gained, F.col("n_features")), F.lit(0)).cast("long")
        scored = counted.select(key, "n_words", "n_features", weight.alias("weight"), F.monotonically_increasing_id().alias("__at"))
        scored = scratch.keep(scored.withColumn("score", F.col("weight") + draw_score(F.col(key), seed)), "scored")
        able = F.col("n_words") >= least_words
        by_score = scored.where(able).groupBy("score").agg(F.count(F.lit(1)).alias("n")).collect()
        wanted_n = percent * sum(n for _, n in by_score) // 100
        lowest, found = None, 0
        for score, n in sorted(by_score, reverse=True):
            if found >= wanted_n:
                break
            lowest, found = score, found + n
        inside = able & (F.col("score") >= lowest) if lowest is not None else F.lit(False)
        drawn = numbered(scored.where(inside), scratch, "rank", F.col("score").desc(), F.col(key).asc_nulls_first(), "__at")
        drawn = plus(drawn, rank=F.when(F.col("rank") <= wanted_n, F.col("rank")))
        rest = plus(scored.where(~inside), rank=F.lit(None).cast("long"))
        return scratch.result(drawn.unionByName(rest).drop("__at"), "resampled")


def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents: features, weight towards the benchmark's texts, score and the rank of those drawn."""
    out = resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_features", "weight", "score", "rank")


#: The same in SQL; each different word's checksum goes byte by byte through a table made by its rule.
OP13_SQL = f"""
WITH crc_table AS (SELECT list(list_reduce(range(8), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END, i) ORDER BY i) AS t FROM (SELECT unnest(range(256))::BIGINT AS i)),
split AS (SELECT 0 AS part, row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '{FEATURE_WORD}') AS ws FROM documents
  UNION ALL SELECT 1, 0, 0, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '{FEATURE_WORD}') FROM benchmark),
words AS (SELECT part, r, w, count(*) AS n FROM (SELECT part, r, unnest(ws) AS w FROM split) GROUP BY ALL),
hex AS (SELECT w, hex(encode(w)) AS h FROM (SELECT DISTINCT w FROM words)),
buckets AS (
  SELECT w, xor(4294967295, list_reduce(list_transform(range(length(h) // 2), lambda i: CAST('0x' || substr(h, CAST(2 * i + 1 AS BIGINT), 2) AS BIGINT)), lambda c, b: xor(c >> 8, t[CAST(xor(c, b) & 255 AS BIGINT) + 1]), 4294967295::BIGINT)) % {BUCKETS} AS bucket
  FROM hex, crc_table
),
counts AS (SELECT part, r, bucket, sum(n)::BIGINT AS n FROM words JOIN buckets USING (w) GROUP BY ALL),
sums AS (SELECT bucket, coalesce(sum(n) FILTER (WHERE part = 0), 0) AS s, coalesce(sum(n) FILTER (WHERE part = 1), 0) AS t FROM counts GROUP BY bucket),
gains AS (SELECT bucket, CAST(floor(1000.0::DOUBLE * ln(((t + 1)::DOUBLE * ((SELECT sum(s) FROM sums) + {BUCKETS})::DOUBLE) / ((s + 1)::DOUBLE * ((SELECT sum(t) FROM sums) + {BUCKETS})::DOUBLE))) AS BIGINT) AS gain FROM sums),
summed AS (SELECT r, sum(n)::BIGINT AS n, sum(n * gain)::BIGINT AS g FROM counts JOIN gains USING (bucket) WHERE part = 0 GROUP BY r),
weighed AS (
  SELECT doc_id, r, coalesce(n, 0) AS n_features, coalesce((g - ((g % n) + n) % n) // n, 0) AS weight,
    CAST('0x' || substr(sha256('{SEED}:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) AS h
  FROM split LEFT JOIN summed USING (r) WHERE part = 0
),
scored AS (SELECT *, weight + CAST(floor(-1000.0::DOUBLE * ln(-ln((h + 0.5::DOUBLE) / 4294967296.0::DOUBLE))) AS BIGINT) AS score FROM weighed),
placed AS (SELECT *, row_number() OVER (PARTITION BY n_features >= {LEAST_WORDS} ORDER BY score DESC, doc_id NULLS FIRST) AS place, count(*) OVER (PARTITION BY n_features >= {LEAST_WORDS}) AS n FROM scored)
SELECT doc_id, n_features::BIGINT AS n_features, weight::BIGINT AS weight, score::BIGINT AS score, CASE WHEN n_features >= {LEAST_WORDS} AND place <= {PERCENT} * n // 100 THEN place END AS rank FROM placed
"""
