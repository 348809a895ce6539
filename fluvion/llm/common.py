"""Helpers that several of these operators share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from fluvion.session import staged

__all__ = ["before", "chunks", "cut", "let", "read", "staged", "text_or_empty"]

#: code points of a chunk
CHUNK = 1024


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def text_or_empty(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` with ``value`` bound to a name, so that it is computed once per row however often it is used."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def before(values: Column, combine: Callable[[Column, Column], Column] = lambda a, b: a + b) -> Column:
    """For each of an array of whole numbers, what those before it combine to (sums unless told otherwise), from 0.

    Appending to an array copies it, so the numbers are folded in blocks of about the square root of their count, and
    then the blocks.
    """
    none = F.array().cast("array<int>")

    def fold(x: Column) -> Column:
        zero = F.struct(F.lit(0).alias("at"), none.alias("out"))
        return F.aggregate(x, zero, lambda acc, v: F.struct(combine(acc["at"], v.cast("int")).alias("at"), F.array_append(acc["out"], acc["at"]).alias("out")))

    def blocks(x: Column, width: Column) -> Column:
        last = F.ceil(F.size(x) / width).cast("int") - 1
        return F.transform(F.sequence(F.lit(0), last), lambda k: fold(F.slice(x, k * width + 1, width)))

    def joined(parts: Column) -> Column:
        ahead = fold(F.transform(parts, lambda b: b["at"]))["out"]
        return F.flatten(F.zip_with(parts, ahead, lambda b, o: F.transform(b["out"], lambda v: combine(v, o))))

    width = lambda x: F.ceil(F.sqrt(F.size(x))).cast("int")
    return let(values, lambda x: F.when(F.size(x) > 0, let(width(x), lambda w: let(blocks(x, w), joined))).otherwise(none))


def chunks(text: Column) -> Column:
    """The text in pieces of CHUNK code points, so that a place in a long text is found without counting from its begin."""
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{CHUNK}}}"), F.lit(0))


def cut(parts: Column, start: Column, stop: Column) -> Column:
    """Code points ``start`` to ``stop`` (exclusive) of a text in `chunks`; what lies beyond it is left out."""
    first, last = F.floor(start / CHUNK).cast("int"), F.floor(stop / CHUNK).cast("int")
    piece = lambda k: F.coalesce(F.get(parts, k), F.lit(""))
    inside = F.substring(piece(first), start - first * CHUNK + 1, stop - start)
    over = F.concat(F.substring(piece(first), start - first * CHUNK + 1, F.lit(CHUNK)), F.array_join(F.slice(parts, first + 2, F.greatest(last - first - 1, F.lit(0))), ""), F.substring(piece(last), F.lit(1), stop - last * CHUNK))
    return F.when(first == last, inside).otherwise(over)
