"""Official thresholds: newest row per category, one comparable set per point."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from fluvion.functions.flood import CATEGORIES
from fluvion.functions.values import convert


def threshold_set(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Four category columns per point, usable only when all rows share basis, unit and datum."""
    identity = F.struct("basis", "unit", "datum")
    usable = F.min(identity).eqNullSafe(F.max(identity))
    newest = lambda c: F.max_by(F.when(F.col("category") == c, F.col("value")), F.when(F.col("category") == c, F.struct("effective_from", "id")))
    return rows.groupBy(*keys).agg(
        usable.alias("usable"),
        F.when(usable, F.min("basis")).alias("basis"), F.when(usable, F.min("unit")).alias("unit"), F.when(usable, F.min("datum")).alias("datum"),
        *[F.when(usable, newest(c)).alias(c) for c in CATEGORIES],
    )


def from_gauge(categories: DataFrame) -> DataFrame:
    """Storable thresholds of each gauge: stage when any stage exists, else flow in cfs.

    ``categories``: lid, datum, category, stage, flow, flow_unit. Stage without a datum refuses.
    """
    has = categories.groupBy("lid").agg(F.count("stage").alias("n_stage"), F.count("flow").alias("n_flow"))
    j = categories.join(has, "lid")
    by_stage = F.col("n_stage") > 0
    refused = by_stage & F.col("datum").isNull()
    return j.select(
        "lid", "category", F.when(by_stage, "stage").when(F.col("n_flow") > 0, "flow").alias("basis"),
        F.when(refused, F.lit(None).cast("double")).when(by_stage, F.col("stage")).otherwise(convert(F.col("flow"), F.col("flow_unit"), F.lit("cfs"))).alias("value"),
        F.when(refused, "stage_without_datum").when((F.col("n_stage") == 0) & (F.col("n_flow") == 0), "no_thresholds").otherwise("ok").alias("reason"),
    ).filter((F.col("reason") != "ok") | F.col("value").isNotNull())
