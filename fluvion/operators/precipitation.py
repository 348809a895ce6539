"""Trailing totals and forecast-cycle totals of basin precipitation."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from fluvion.functions.clocks import hours_between

# Fixed values.
TRAILING_WINDOWS_H = (6, 24, 72)


def trailing_totals(hours: DataFrame, scope: str, windows: tuple[int, ...] = TRAILING_WINDOWS_H) -> DataFrame:
    """Totals over (t - w, t] anchored at the newest known hour of each scope.

    A null hour was looked at and refused; it counts as missing, never as zero. Each row carries
    how much of the window exists and why the rest does not.
    """
    anchor = hours.groupBy(scope).agg(F.max("valid_time").alias("window_end"))
    w = F.explode(F.array(*[F.lit(x) for x in windows])).alias("window_h")
    reach = F.lit(max(windows))
    recent = hours.join(anchor, scope).filter(hours_between(F.col("window_end"), F.col("valid_time")) < reach)
    spread = recent.select(scope, "window_end", "valid_time", "value", w)
    inside = spread.filter(hours_between(F.col("window_end"), F.col("valid_time")) < F.col("window_h"))
    out = inside.groupBy(scope, "window_end", "window_h").agg(
        F.round(F.sum("value"), 3).alias("total"),
        F.count("value").cast("int").alias("hours_present"),
        F.count_if(F.col("value").isNull()).cast("int").alias("hours_refused"),
    )
    missing = F.col("window_h") - F.col("hours_present")
    reason = (
        F.when((F.col("hours_present") == 0) & (F.col("hours_refused") > 0), "all_hours_refused")
        .when((missing > 0) & (F.col("hours_refused") > 0), "hours_missing_and_refused")
        .when(missing > 0, "hours_missing")
    )
    return out.withColumn("reason", reason)


def newest_cycle_total(windows: DataFrame, scope: str, needed: int) -> DataFrame:
    """Sum over the windows of the newest cycle only; refused unless all of them exist."""
    newest = F.max("issued_at").over(W.partitionBy(scope))
    rows = windows.withColumn("cycle", newest).filter("issued_at = cycle")
    n = F.count(F.lit(1))
    return rows.groupBy(scope, "cycle").agg(
        n.alias("n_windows"),
        F.when(n == needed, F.sum("value")).alias("total"),
        F.when(n == needed, "ok").otherwise("incomplete_cycle").alias("reason"),
    )
