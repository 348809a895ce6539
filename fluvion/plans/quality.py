"""Data-quality checks that must come back empty, and reasons that must not be missing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def dangling(child: DataFrame, parent: DataFrame, key: str, child_defect: str, parent_defect: str) -> DataFrame:
    """Rows of each side without a partner, counted per defect."""
    def count(df: DataFrame, name: str) -> DataFrame:
        return df.agg(F.count(F.lit(1)).alias("n"), F.min(key).alias("first_key")).select(F.lit(name).alias("defect"), "n", "first_key")

    return count(child.join(parent, key, "left_anti"), child_defect).unionByName(count(parent.join(child, key, "left_anti"), parent_defect))


def explained(state: Column, reason: Column, surface: str) -> Column:
    """The reason of an unknown state; a missing one is itself named as a defect."""
    return F.when(state != "unknown", F.lit("not_needed")).otherwise(F.coalesce(reason, F.lit(f"defect:unexplained:{surface}")))
