"""Forcing: the newest precipitation cycle of each basin, banded, beside the official total."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window as W, functions as F

from fluvion.functions import bands
from fluvion.functions.clocks import hours_between
from fluvion.operators import rasters

# Fixed values.
MAX_CYCLE_AGE_H = 48
OFFICIAL_WINDOWS = 3
RATIO_FLOOR_MM = 1.0


FEATURES = ("p50_72h", "p10_72h", "p90_72h", "p50_24h", "det_24h", "det_72h", "snow_p50")


def current(rows: DataFrame, basins: DataFrame) -> DataFrame:
    """Rows of cycles known and not older than two days at each basin's knowledge time."""
    return rows.join(basins.select("basin", "as_of"), "basin").filter(
        (F.col("issued_at") <= F.col("as_of")) & (hours_between(F.col("as_of"), F.col("issued_at")) <= MAX_CYCLE_AGE_H)
    )


def newest(cycles: DataFrame, name: str, columns: Sequence[str]) -> DataFrame:
    """Of one row per (basin, cycle) the newest per basin, as ``name`` and its columns: an aggregation, no join back."""
    best = F.max(F.struct("issued_at", *columns)).alias("b")
    return cycles.groupBy("basin").agg(best).select("basin", F.col("b.issued_at").alias(name), *[F.col(f"b.{c}").alias(c) for c in columns])


def newest_features(rows: DataFrame, basins: DataFrame) -> DataFrame:
    """The named features of the newest cycle side by side, by conditional aggregation."""
    pick = lambda name: F.max(F.when(F.col("feature") == name, F.col("value"))).alias(name)
    return newest(current(rows, basins).groupBy("basin", "issued_at").agg(*map(pick, FEATURES)), "cycle", FEATURES)


def official_totals(windows: DataFrame, basins: DataFrame) -> DataFrame:
    """Newest official cycle per basin; the total exists only when all three windows do."""
    per = current(windows, basins).groupBy("basin", "issued_at", "lead").agg(F.max("value").alias("value"))
    n = F.count(F.lit(1))
    cycles = per.groupBy("basin", "issued_at").agg(
        F.when(n == OFFICIAL_WINDOWS, F.sum("value")).alias("official_total"), F.when(n == OFFICIAL_WINDOWS, F.min_by("value", "lead")).alias("official_day1")
    )
    return newest(cycles, "official_cycle", ("official_total", "official_day1"))


def assess(basins: DataFrame, rows: DataFrame, official: DataFrame, hypsometry: DataFrame) -> DataFrame:
    """One row per basin: band and score of the 72 h median, spread, snow level, rain-exposed share, agreement."""
    q = basins.join(newest_features(rows, basins), "basin", "left").join(official_totals(official, basins), "basin", "left")
    q = q.join(hypsometry, "basin", "left")
    v = F.col("p50_72h")
    reason = F.when(F.col("cycle").isNull(), "no_cycle").when(v.isNull(), "no_value")
    ok = reason.isNull()
    same = ok & (F.col("cycle") == F.col("official_cycle")) & F.col("official_total").isNotNull()
    delta24, delta72 = F.col("official_day1") - F.col("p50_24h"), F.col("official_total") - v
    return q.select(
        "basin", "cycle", F.when(ok, bands.band(v, bands.RAIN_EDGES_MM)).otherwise("unknown").alias("level"), F.when(ok, bands.piecewise_score(v)).alias("score"),
        F.when(ok, v).alias("value"), F.when(ok, F.col("p10_72h")).alias("p10"), F.when(ok, F.col("p90_72h")).alias("p90"), F.when(ok, F.col("snow_p50")).alias("snow_level"),
        F.when(ok, F.round(rasters.fraction_below(F.col("snow_p50")) * 100, 1)).alias("rain_exposed_pct"),
        F.when(ok, F.col("official_total")).alias("official_total"), F.when(same, delta24).alias("delta_24h"), F.when(same, delta72).alias("delta_72h"),
        F.when(same, F.when(F.col("official_total").between(F.col("p10_72h"), F.col("p90_72h")), "inside").otherwise("outside")).alias("against_band"),
        F.when(ok & F.col("official_total").isNull(), "no_official_total").when(ok & ~same, "different_cycle").when(ok, "same_cycle").otherwise("none").alias("agreement"),
        F.coalesce(reason, F.lit("ok")).alias("reason"),
    )


def driver_rows(assessed: DataFrame) -> DataFrame:
    """The numbers of the assessment as ranked driver rows, absent ones left out."""
    cols = ["value", "p90", "p10", "snow_level", "rain_exposed_pct", "official_total"]
    long = assessed.unpivot("basin", cols, "feature", "number").filter("number IS NOT NULL")
    order = F.array_position(F.array(*[F.lit(c) for c in cols]), F.col("feature"))
    return long.withColumn("rank", F.row_number().over(W.partitionBy("basin").orderBy(order)))
