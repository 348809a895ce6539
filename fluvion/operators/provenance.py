"""Provenance of a value: product, source, kind, artifact, freshness, in one struct."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from fluvion.functions.values import age_seconds, freshness


def attach(
    df: DataFrame, products: DataFrame, sources: DataFrame, now: Column, valid: str, retrieved: str, artifact: Column
) -> DataFrame:
    """``products``: product_id, product, source, cadence_s, grace_s. ``sources``: source, kind."""
    joined = df.join(products, "product_id", "left").join(sources, "source", "left")
    args = (now, F.col(valid), F.col(retrieved))
    ref = F.struct(
        "product",
        F.coalesce("kind", F.lit("UNKNOWN")).alias("kind"),
        artifact.alias("artifact"),
        freshness(*args, F.col("cadence_s"), F.col("grace_s")).alias("freshness"),
        age_seconds(*args).alias("age_s"),
    )
    return joined.withColumn("provenance", ref).drop("product", "source", "kind", "cadence_s", "grace_s")
