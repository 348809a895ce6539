"""Official forecast against model ensemble at every point, as one plan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from fluvion.operators import agreement
from fluvion.operators.selection import newest

NUMBERS = ("o_crest", "m_crest", "timing_h")


def latest_cycles(runs: DataFrame, keys: list[str]) -> DataFrame:
    return newest(runs, keys, [F.desc("issued_at"), F.desc("run_id")])


def assess(points: DataFrame, official: DataFrame, members: DataFrame, levels: dict[str, Column] | None = None, floor: Column | None = None) -> DataFrame:
    """Agreement per point.

    ``points``: point, as_of, cycle, coverage_h. ``official``: point, t, v. ``members``: point,
    member, t, v. The shared window is fixed from the cycle before either crest is taken.
    """
    p = points.withColumn("w", agreement.comparison_window(F.col("as_of"), F.col("cycle"), F.col("coverage_h"))).select("point", "as_of", "w.*")
    inside = (F.col("t") > F.col("start")) & (F.col("t") <= F.col("end")) & F.col("v").isNotNull()
    bounds = p.select("point", "start", "end")
    o = agreement.hydrographs(official.join(bounds, "point").filter(inside), ["point"])
    shapes = agreement.hydrographs(members.join(bounds, "point").filter(inside), ["point", "member"])
    counts = agreement.member_exceedance(shapes, ["point"], levels or {}).drop("members")
    m = agreement.median_member(shapes, ["point"]).join(counts, "point")
    o_cols = o.select("point", *[F.col(c).alias(f"o_{c}") for c in ("crest", "crest_time", "shape", "step_h")])
    m_cols = m.select("point", "member", "member_count", "distinct_crests", "exceeds", "exceeding", "fraction", *[F.col(c).alias(f"m_{c}") for c in ("crest", "crest_time", "shape", "step_h")])
    j = p.join(o_cols, "point", "left").join(m_cols, "point", "left")
    return agreement.verdict(j, levels, floor)


def explanation(assessed: DataFrame) -> DataFrame:
    """Every intermediate of the verdict in one nested record per point."""
    record = F.struct(
        F.struct("shared_h", "lost_tail_h", "cycle_age_h").alias("window"),
        F.struct(F.col("o_crest").alias("crest"), F.col("o_shape").alias("shape")).alias("official"),
        F.struct(F.col("m_crest").alias("crest"), F.col("m_shape").alias("shape"), "member", "member_count", "exceeds", "exceeding", "fraction").alias("model"),
        F.struct("delta", "timing_h", "steps").alias("difference"),
    )
    return assessed.select("point", "state", "reason", "quality", record.alias("record"))


def drivers(assessed: DataFrame) -> DataFrame:
    """Three ranked driver rows per compared point, with the direction of each difference."""
    d, later = F.col("delta"), F.unix_micros("m_crest_time") - F.unix_micros("o_crest_time")
    size = F.when(d > 0, "model_exceeds_official").when(d < 0, "model_below_official").otherwise("model_matches_official")
    both = (F.col("o_shape") == "crest") & (F.col("m_shape") == "crest")
    one = (F.col("o_shape") == "crest") != (F.col("m_shape") == "crest")
    timing = (
        F.when(one, "only_one_forecast_crests_in_window").when(~both, "neither_forecast_crests_in_window")
        .when(later > 0, "model_later").when(later < 0, "model_earlier").otherwise("model_same_time")
    )
    row = lambda rank, feature, value, unit, direction: F.struct(
        F.lit(rank).alias("rank"), F.lit(feature).alias("feature"), value.cast("double").alias("value"), F.lit(unit).alias("unit"), direction.alias("direction")
    )
    rows = F.array(
        row(1, "agreement_crest_flow_official", F.round("o_crest", 1), "cfs", F.lit("reference")),
        row(2, "agreement_crest_flow_model_median", F.round("m_crest", 1), "cfs", size),
        row(3, "agreement_crest_timing_delta_h", F.round("timing_h", 2), "h", timing),
    )
    ok = assessed.filter(F.col("reason") == "ok")
    return ok.select("point", F.explode(rows).alias("d")).select("point", "d.*")
