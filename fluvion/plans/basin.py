"""Basin state: the surfaces side by side, never combined into one number."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from fluvion.operators import running


def basin_state(
    basins: DataFrame, susceptibility: DataFrame, forcing: DataFrame, points: DataFrame, agreement: DataFrame, rain: DataFrame, alerts: DataFrame
) -> DataFrame:
    """One row per basin; each surface that cannot be stated carries the input it lacks.

    Every input is already one row per scope, so these are joins of small per-basin results.
    """
    s = susceptibility.select(F.col("site").alias("basin"), F.col("band").alias("susceptibility"), F.col("reason").alias("s_reason"))
    f = forcing.select("basin", F.col("level").alias("forcing"), F.col("reason").alias("f_reason"))
    p = points.select(F.col("point").alias("basin"), "hazard", F.col("hazard_reason").alias("h_reason"))
    a = agreement.select(F.col("point").alias("basin"), F.col("state").alias("agreement"), F.col("reason").alias("a_reason"))
    r = rain.select(F.col("basin").alias("rain_basin"), F.col("total").alias("rain_72h"), "hours_present")
    n = alerts.groupBy("basin").agg(F.count(F.lit(1)).alias("n_alerts"))
    j = basins
    for part in (s, f, p, a, n):
        j = j.join(part, "basin", "left")
    j = j.join(r, "rain_basin", "left")
    known = lambda c, d: F.coalesce(F.col(c), F.lit(d)).alias(c)
    return j.select(
        "basin", "basin_name", known("susceptibility", "unknown"), F.coalesce("s_reason", F.lit("no_gauge")).alias("susceptibility_reason"),
        known("forcing", "unknown"), F.coalesce("f_reason", F.lit("no_basin_rows")).alias("forcing_reason"),
        known("hazard", "unknown"), F.coalesce("h_reason", F.lit("no_outlet_point")).alias("hazard_reason"),
        known("agreement", "unknown"), F.coalesce("a_reason", F.lit("no_outlet_point")).alias("agreement_reason"),
        "rain_72h", F.coalesce("hours_present", F.lit(0)).alias("rain_hours"), F.coalesce("n_alerts", F.lit(0)).alias("n_alerts"),
    )


def headline_drivers(surfaces: list[tuple[str, DataFrame]]) -> DataFrame:
    """(basin, rank, surface, feature, value, clock): the drivers of each basin, renumbered over its surfaces in their order.

    Each surface brings rows (basin, rank, feature, value, clock), few per basin.
    """
    rows = None
    for place, (name, df) in enumerate(surfaces):
        one = df.select("basin", F.lit(place).alias("_surface"), F.col("rank").cast("int").alias("_place"), F.lit(name).alias("surface"), "feature", F.col("value").cast("double").alias("value"), F.col("clock").cast("timestamp").alias("clock"))
        rows = one if rows is None else rows.unionByName(one)
    ranked = running.numbered(rows, ["basin"], ["_surface"], ["_place", "feature"], "rank")
    return ranked.select("basin", "rank", "surface", "feature", "value", "clock")


def scene(states: DataFrame, rivers: DataFrame) -> DataFrame:
    """All basins with the count and highest reading of their river points."""
    return states.select("basin", "basin_name", "susceptibility", "hazard").join(rivers, "basin", "left").fillna(0, ["n_points"])
