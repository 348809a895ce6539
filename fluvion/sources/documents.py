"""Landed documents: one row per fetched payload, as (path, content).

Archives of small payloads are kept as tables of (path, content); raw directories are read with
``read_directory``. Every scan below takes such a DataFrame, so one job parses many files.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F


def read_directory(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """Whole files of a directory tree as text."""
    files = spark.read.text(path, wholetext=True, recursiveFileLookup=True, pathGlobFilter=glob)
    return files.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("content"))


def catalog_directory(spark: SparkSession, path: str) -> DataFrame:
    """File listing (path, modified, length) without reading content."""
    return (
        spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
        .select("path", F.col("modificationTime").alias("modified_at"), F.col("length").alias("size_bytes"))
    )


def once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Add a column that is worked out once per row, however many conditions and columns read it.

    A plain column is copied into every condition on it, so a document would be parsed anew by each check; what a
    generator gives is not.
    """
    return df.withColumn(name, F.explode(F.array(value)))


def parse_json(docs: DataFrame, schema: str) -> DataFrame:
    """Add ``doc``; a payload that is not valid JSON of this shape is refused as malformed."""
    full = f"{schema}, _bad string"
    parsed = F.from_json("content", f"struct<{full}>", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    df = once(docs, "doc", parsed)
    return df.withColumn("refusal", F.when(F.col("doc").isNull() | F.col("doc._bad").isNotNull(), F.lit("malformed")))


def refuse(df: DataFrame, condition: Column, code: str) -> DataFrame:
    """First refusal wins; later checks do not overwrite it."""
    return df.withColumn("refusal", F.coalesce("refusal", F.when(F.coalesce(condition, F.lit(False)), F.lit(code))))


def accepted(df: DataFrame) -> DataFrame:
    return df.filter(F.col("refusal").isNull())


def refusals(df: DataFrame) -> DataFrame:
    return df.filter(F.col("refusal").isNotNull()).select("path", "refusal")
