"""Readers of whole texts, observations, binaries and JSON documents, and the sinks that mirror them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """CSV with a header and a stated schema; only empty fields are null."""
    return spark.read.csv(path, header=True, schema=schema, nullValue="", emptyValue="", mode="FAILFAST")


def write_csv(df: DataFrame, path: str) -> None:
    """Flat columns only: structs and arrays are dropped."""
    flat = [f.name for f in df.schema if f.dataType.typeName() not in ("struct", "array", "map")]
    df.select(*flat).write.mode("overwrite").csv(path, header=True)


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """(path, text) of text files, each whole."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def read_observations(spark: SparkSession, path: str) -> DataFrame:
    """Recognised text lines as JSON lines."""
    return spark.read.schema("page long, text string, confidence double, x double, y double, width double, height double").json(path)


def page_text(observations: DataFrame, key: str) -> DataFrame:
    """Pages in reading order under page marks, and the mean of the pages' mean confidences, summed in millionths so that no order of rows shows."""
    order = F.array_sort(F.collect_list(F.struct((-(F.col("y") + F.col("height"))).alias("t"), "x", "text")))
    by_page = observations.groupBy(key, "page").agg(F.array_join(F.transform(order, lambda o: o["text"]), "\n").alias("body"), F.floor(F.sum(F.round(F.col("confidence") * 1e6).cast("long")).cast("double") / F.count("confidence") + 0.5).alias("c"))
    marked = F.concat(F.lit("===== PAGE "), F.col("page"), F.lit(" =====\n"), F.col("body"))
    return by_page.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page", marked.alias("m")))), lambda s: s["m"]), "\n").alias("text"), (F.sum("c").cast("double") / F.count("c") / 1e6).alias("mean_confidence"))


def read_json_documents(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Whole-file JSON objects or arrays."""
    return spark.read.schema(schema).json(path, multiLine=True)


def list_files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """Files by name pattern with size and time, contents not read."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path).select("path", "length", "modificationTime")


def pdf_pages(content):
    """Page objects in a PDF's plain part, the fallback where no text layer says it."""
    return F.size(F.regexp_extract_all(F.decode(content, "ISO-8859-1"), F.lit(r"/Type\s*/Page[^s]"), F.lit(0)))


def is_pdf(content):
    return F.substring(content, 1, 5) == F.lit(b"%PDF-")


def write_summary(df: DataFrame, path: str) -> None:
    """A one-row table as one JSON document."""
    df.select(F.to_json(F.struct(*sorted(df.columns))).alias("value")).coalesce(1).write.mode("overwrite").text(path)


def formula_errors(df: DataFrame) -> DataFrame:
    """Rows of which any text column shows a spreadsheet error."""
    pattern = "#(REF|DIV/0|VALUE|NAME|N/A)[!?]?"
    found = F.lit(False)
    for f in df.schema:
        if f.dataType.typeName() == "string":
            found = found | F.coalesce(F.col(f.name).rlike(pattern), F.lit(False))
    return df.where(found)
