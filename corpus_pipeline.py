"""A corpus pipeline of five stages over the documents table; each stage is written and read again.

The stages take (spark, docs, sf_dir). All but the last return the columns of documents; ``n_chars`` follows the
text where a stage changes it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from fluvion.llm import language, lines, nearcopies, packing, pii
from fluvion.llm.common import staged
from fluvion.llm.queries import held_out, tokenizer

FEW_LETTERS = 40
COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _documents(docs: DataFrame) -> list[Column]:
    """The columns of documents, the length brought up to date; a null text stays null and keeps its given length."""
    length = F.coalesce(F.length("text").cast("long"), F.col("n_chars").cast("long"))
    return [length.alias(c) if c == "n_chars" else F.col(c) for c in COLUMNS]


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of a known language stay: a text that is null or has no letter, or that is nothing like any prototype, goes."""
    model = language.prototypes(docs.where(~F.coalesce(held_out(), F.lit(False))))
    told = language.predict(docs, model, [f"`{c}`" for c in COLUMNS])
    # a few letters hold too few n-grams for a high cosine: they stay on any likeness
    few = F.length(F.regexp_replace("text", r"\P{L}", "")) < FEW_LETTERS
    known = (F.col("lang_pred") != "und") & (F.col("score") > 0) & ((F.col("score") >= language.NOISE) | few)
    return told.where(known).select(*COLUMNS)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each line on many sites one occurrence stays; documents keep their other lines."""
    return lines.deduplicated(docs.select(*COLUMNS)).select(*_documents(docs))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each near-duplicate group stays, the one with the smallest doc_id; rows without one come last.

    Near means a Jaccard similarity of five-word shingles of 0.8 or more, checked exactly. SimHash fingerprints over these shingles
    propose what they link, min-hash bands the rest; op3's four words bind op3 alone.
    """
    found = nearcopies.near_copies(docs)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row"))
    keep = found.groupBy("root").agg(first.alias("first")).select("first.row")
    kept = docs.select(*COLUMNS, nearcopies.row_key().alias("row")).join(keep, "row", "left_semi")
    # repeated rows are copies of the row that stays
    return kept.dropDuplicates(["row"]).select(*COLUMNS)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by its kind in brackets."""
    return pii.masked(docs.select(*COLUMNS), pii.fit(docs)).select(*_documents(docs))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents as pieces of token sequences."""
    return packing.packed(docs, tokenizer("word_bpe_49k.json"))


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("simhash_near_dedup", near_dedup),
    ("personal_data", personal_data),
    ("packing", pack),
]

#: Tokenizing, sketches and trained models have no SQL form; the tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
