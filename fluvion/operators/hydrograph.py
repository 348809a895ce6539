"""Crests, segments and encodings of hydrographs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from fluvion.functions.clocks import hours_between, plus_hours
from fluvion.operators import running

# Fixed values.
LOOKBACK_H, HORIZON_H = 6, 72
HORIZON_LEADS_H = (6, 12, 24, 48, 72)
HORIZON_TOLERANCE_H = 3.0

BLOCK_DAYS = 16


def crests(values: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Highest value in (as_of - 6 h, as_of + 72 h], earliest on ties."""
    inside = (F.col("valid_time") > plus_hours(F.col("as_of"), -LOOKBACK_H)) & (F.col("valid_time") <= plus_hours(F.col("as_of"), HORIZON_H))
    best = F.max(F.struct(F.col(value).alias("v"), (-F.unix_micros("valid_time")).alias("k"))).alias("b")
    g = values.filter(inside & F.col(value).isNotNull()).groupBy(*keys).agg(best)
    return g.select(*keys, F.col("b.v").alias("crest"), F.timestamp_micros(-F.col("b.k")).alias("crest_time"))


def segments(series: DataFrame, key: str) -> DataFrame:
    """Continuous stretches of a series, broken at nulls, worked out in blocks of time (`running.runs`)."""
    marked = running.runs(series, [key], running.day_block("t", BLOCK_DAYS), "t", F.col("v").isNotNull())
    g = marked.groupBy(key, "run").agg(F.count(F.lit(1)).alias("n"), F.min("t").alias("t0"), F.max("t").alias("t1"))
    placed = running.numbered(g.withColumn("_block", running.day_block("t0", BLOCK_DAYS)), [key], ["_block"], ["t0"], "segment")
    return placed.select(key, "segment", "n", "t0", "t1")


def encode(points: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(t0, step_h, values) when a series is exactly uniform, explicit points otherwise.

    A series is one member of one cycle: bounded by its horizon.
    """
    p = F.sort_array(F.collect_list(F.struct("t", "v")))
    g = points.groupBy(*keys).agg(p.alias("points"))
    steps = F.array_distinct(F.transform(F.slice("points", 2, F.greatest(F.size("points") - 1, F.lit(0))), lambda q, i: hours_between(q["t"], F.get("points", i)["t"])))
    uniform = (F.size("points") >= 2) & (F.size(steps) == 1) & (F.get(steps, 0) > 0)
    return g.select(
        *keys,
        F.when(uniform, "grid").otherwise("points").alias("encoding"),
        F.when(uniform, F.get("points", 0)["t"]).alias("t0"),
        F.when(uniform, F.get(steps, 0)).alias("step_h"),
        F.when(uniform, F.transform("points", lambda q: q["v"])).alias("flow"),
        F.when(~uniform, F.col("points")).alias("points"),
    )


def decode(encoded: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows (keys, pos, t, v) of either encoding."""
    as_points = F.transform("flow", lambda v, i: F.struct(plus_hours(F.col("t0"), F.col("step_h") * i).alias("t"), v.alias("v")))
    pts = F.when(F.col("encoding") == "grid", as_points).otherwise(F.col("points"))
    return encoded.select(*keys, F.posexplode(pts).alias("pos", "p")).select(*keys, "pos", F.col("p.t").alias("t"), F.col("p.v").alias("v"))


def lead_targets(as_of: Column) -> Column:
    """One struct (lead_h, target) per fixed lead."""
    return F.array(*[F.struct(F.lit(h).alias("lead_h"), plus_hours(as_of, h).alias("target")) for h in HORIZON_LEADS_H])


def at_leads(points: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Value nearest to each fixed lead within three hours; none gives a reason, never a number.

    ``points``: keys, as_of, t, v. Each point looks at the few leads it can serve, so nothing is
    paired beyond leads x points of one series, and partial aggregation keeps one per lead.
    """
    gap = F.abs(hours_between(F.col("t"), F.col("lead.target")))
    near = F.when((gap <= HORIZON_TOLERANCE_H) & F.col("v").isNotNull(), F.struct(gap.alias("gap"), F.col("t").alias("t"), F.col("v").alias("v")))
    rows = points.withColumn("lead", F.explode(lead_targets(F.col("as_of"))))
    g = rows.groupBy(*keys, "lead").agg(F.min(near).alias("b"), F.max(F.when(F.col("t") > F.col("as_of"), F.col("t"))).alias("last_t"))
    ends = F.col("last_t") < plus_hours(F.col("lead.target"), -HORIZON_TOLERANCE_H)
    reason = F.when(F.col("b").isNotNull(), "ok").when(F.coalesce(ends, F.lit(False)), "forecast_ends").otherwise("no_point_near")
    return g.select(*keys, F.col("lead.lead_h").alias("lead_h"), F.col("b.t").alias("at"), F.col("b.v").alias("value"), reason.alias("reason"))


def exceedance_band(rows: DataFrame, key: str, since: Column, until: Column) -> DataFrame:
    """The 5 / 50 / 95 % traces inside a window, with the rows cut away counted.

    ``rows``: key, valid_time, level, value. Levels are never interpolated.
    """
    at = lambda p: F.max(F.when(F.col("level") == p, F.col("value")))
    inside = F.col("valid_time").between(since, until)
    wide = rows.groupBy(key, "valid_time", inside.alias("inside")).agg(at(0.05).alias("hi"), at(0.5).alias("mid"), at(0.95).alias("lo"))
    drawable = F.col("inside") & F.col("hi").isNotNull() & F.col("lo").isNotNull()
    g = wide.groupBy(key).agg(
        F.count_if("inside").alias("n_inside"), F.count_if(~F.col("inside")).alias("n_clipped"), F.count_if(drawable).alias("n_drawn"),
        F.min(F.when(drawable, F.col("lo"))).alias("lowest"), F.max(F.when(drawable, F.col("hi"))).alias("highest"),
    )
    reason = F.when(F.col("n_drawn") > 0, "ok").when(F.col("n_inside") > 0, "no_values_at_levels").otherwise("every_row_outside_window")
    return g.select(key, "n_inside", "n_clipped", "lowest", "highest", reason.alias("reason"))
