"""Row selection: newest per key, official products, searches, site checks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F


def newest(df: DataFrame, keys: Sequence[str], order: Sequence[Column], keep: int = 1) -> DataFrame:
    """First ``keep`` rows per key under a total order.

    The filter on row_number lets Spark cut each group map-side before the shuffle, so a key that
    holds a third of all rows sends at most ``keep`` rows per input task.
    """
    w = W.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= keep).drop("_rn")


def as_known_at(df: DataFrame, at: str | Column) -> DataFrame:
    """Rows knowable at ``at``; a plain comparison, so it reaches the scan of a stored table."""
    t = F.lit(at).cast("timestamp") if isinstance(at, str) else at
    return df.filter(F.col("available_at") <= t)


def site_check(df: DataFrame, file_key: str, expected: str, actual: str) -> DataFrame:
    """One row per file: a file naming another site is refused whole."""
    return (
        df.groupBy(file_key)
        .agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(~F.col(actual).eqNullSafe(F.col(expected))).alias("n_foreign"))
        .withColumn("verdict", F.when(F.col("n_foreign") > 0, F.lit("refused")).otherwise(F.lit("accepted")))
    )


def with_source_kind(df: DataFrame, products: DataFrame, sources: DataFrame) -> DataFrame:
    """Resolve product → source → kind; a product or source that is not registered is UNKNOWN.

    Both registries are small; Spark broadcasts them when their size allows and joins otherwise.
    """
    kinds = products.join(sources, "source", "left").select("product", F.coalesce("kind", F.lit("UNKNOWN")).alias("kind"))
    return df.join(kinds, "product", "left").withColumn("kind", F.coalesce("kind", F.lit("UNKNOWN")))


def search(entities: Sequence[tuple[str, DataFrame]], needle: str, limit: int = 50) -> DataFrame:
    """Case-insensitive containment in name or id over several kinds; the first ``limit`` hits."""
    q = needle.strip().lower()
    union: DataFrame | None = None
    for rank, (kind, df) in enumerate(entities):
        part = df.select(F.lit(rank).alias("kind_rank"), F.lit(kind).alias("kind"), "id", "name")
        part = part.filter(F.contains(F.lower("name"), F.lit(q)) | F.contains(F.lower("id"), F.lit(q)))
        union = part if union is None else union.unionByName(part)
    return union.orderBy("kind_rank", "id").limit(limit)


def shared_value(df: DataFrame, keys: Sequence[str], col: str, alias: str) -> DataFrame:
    """The one value all rows of a group share (an absent value counts as a value), else null."""
    missing = F.coalesce(F.col(col), F.lit("∅"))
    return df.groupBy(*keys).agg(
        F.when(F.min(missing) == F.max(missing), F.nullif(F.min(missing), F.lit("∅"))).alias(alias),
        F.count(F.lit(1)).alias("n"),
    )
