"""Reservoir readings: several source codes per instant, one preferred."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

# Fixed values.
SOURCE_PREFERENCE = ("RZ", "RG", "RR")
DISAGREEMENT = 0.01


def preferred_source(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Best code per instant (then alphabetical), and whether another source disagrees."""
    rank = F.coalesce(*[F.when(F.col("code") == c, F.lit(i)) for i, c in enumerate(SOURCE_PREFERENCE)], F.lit(len(SOURCE_PREFERENCE)))
    g = rows.groupBy(*keys).agg(
        F.min(F.struct(rank.alias("rank"), "code", "value")).alias("b"), F.min("value").alias("lo"), F.max("value").alias("hi")
    )
    off = F.greatest(F.col("hi") - F.col("b.value"), F.col("b.value") - F.col("lo"))
    return g.select(*keys, "b.code", "b.value", (off > DISAGREEMENT).alias("disagrees"))


def latest_state(observations: DataFrame, at, names: dict[str, str], lookback_h: int = 72) -> DataFrame:
    """Newest reading per (dam, variable) known at ``at``, one column per variable.

    ``observations`` must already be one product: another product's newer row may not shadow it.
    """
    from fluvion.functions.clocks import plus_hours

    known = observations.filter((F.col("available_at") <= at) & F.col("valid_time").between(plus_hours(at, -lookback_h), at) & F.col("variable").isin(*names))
    best = known.groupBy("station", "variable").agg(F.max(F.struct("valid_time", "id", "value")).alias("b"))
    pick = [F.max(F.when(F.col("variable") == k, F.col("b.value"))).alias(v) for k, v in names.items()]
    return best.groupBy("station").agg(*pick, F.max("b.valid_time").alias("newest"))
