"""Official forecast against model ensemble: shapes, windows, exceedance, verdict."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from fluvion.functions.clocks import hours_between, plus_hours
from fluvion.functions.flood import CATEGORIES, category, category_steps

# Fixed values.
LOOKBACK_H = 6
HORIZON_H = 72
HIGH_MAGNITUDE, MODERATE_MAGNITUDE = 0.25, 0.60
HIGH_TIMING_H, MODERATE_TIMING_H = 6.0, 18.0
MODERATE_STEPS = 1
PROMINENCE, FLAT = 0.05, 0.05
MIN_SHARED_H, TRUNCATION_H = 24.0, 1.0


def member_exceedance(members: DataFrame, keys: Sequence[str], levels: dict[str, float | Column]) -> DataFrame:
    """How many members reach the highest category any member reaches (the lowest when none does).

    ``members`` holds one crest per member; the categories are four conditional counts, not a join.
    Without levels nothing can be exceeded: category and counts are null.
    """
    counts = {c: F.count_if(F.col("crest") >= levels[c]) for c in CATEGORIES if c in levels}
    g = members.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("members"), F.countDistinct("crest").alias("distinct_crests"), *[c.alias(f"_n_{k}") for k, c in counts.items()]
    )
    defined = list(counts)
    if not defined:
        return g.select(*keys, "members", "distinct_crests", F.lit(None).cast("string").alias("exceeds"), F.lit(None).cast("long").alias("exceeding"), F.lit(None).cast("double").alias("fraction"))
    cat, n = F.lit(defined[0]), F.col(f"_n_{defined[0]}")
    for c in defined[1:]:
        reached = F.col(f"_n_{c}") > 0
        cat, n = F.when(reached, F.lit(c)).otherwise(cat), F.when(reached, F.col(f"_n_{c}")).otherwise(n)
    return g.select(*keys, "members", "distinct_crests", cat.alias("exceeds"), n.alias("exceeding"), (n / F.col("members")).alias("fraction"))


def comparison_window(as_of: Column, issued_at: Column, coverage_h: Column, horizon_h: int = HORIZON_H) -> Column:
    """Struct of the hazard window cut to what the model cycle covers."""
    h0, h1 = plus_hours(as_of, -LOOKBACK_H), plus_hours(as_of, horizon_h)
    start, end = F.greatest(h0, issued_at), F.least(h1, plus_hours(issued_at, coverage_h))
    return F.struct(
        start.alias("start"), end.alias("end"), F.greatest(hours_between(end, start), F.lit(0.0)).alias("shared_h"),
        F.greatest(hours_between(h1, end), F.lit(0.0)).alias("lost_tail_h"), hours_between(as_of, issued_at).alias("cycle_age_h"),
    )


def hydrographs(points: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Shape of each series: crest, first, last, amplitude, prominence, step.

    ``points``: keys, t, v (v not null, one row per instant). Partial aggregates only, so a long
    series is never gathered: first and last by time, peak by (value, earliest time), and the
    smallest step from a lag.
    """
    lag = F.lag("t").over(W.partitionBy(*keys).orderBy("t"))
    g = points.withColumn("_step", hours_between(F.col("t"), lag)).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.max(F.struct("v", (-F.unix_micros("t")).alias("k"))).alias("_peak"), F.min("v").alias("low"),
        F.min_by("v", "t").alias("first_v"), F.max_by("v", "t").alias("last_v"), F.min("t").alias("t0"), F.max("t").alias("t1"), F.min("_step").alias("step_h"),
    )
    peak, at = F.col("_peak.v"), F.timestamp_micros(-F.col("_peak.k"))
    interior = (at > F.col("t0")) & (at < F.col("t1"))
    prominence = F.when(peak > 0, (peak - F.greatest("first_v", "last_v")) / peak).otherwise(F.lit(0.0))
    amplitude = F.when(peak > 0, (peak - F.col("low")) / peak).otherwise(F.lit(0.0))
    shape = (
        F.when(amplitude < FLAT, "flat")
        .when(interior & (prominence >= PROMINENCE), "crest")
        .when(F.col("last_v") >= F.col("first_v"), "rising")
        .otherwise("receding")
    )
    return g.select(*keys, "n", peak.alias("crest"), at.alias("crest_time"), interior.alias("interior"), prominence.alias("prominence"), amplitude.alias("amplitude"), shape.alias("shape"), "step_h")


def median_member(members: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Lower-median member by (crest, crest time, name): an existing member, never an average."""
    w = W.partitionBy(*keys)
    n = F.count(F.lit(1)).over(w)
    pos = F.row_number().over(w.orderBy("crest", "crest_time", "member"))
    ranked = members.withColumn("member_count", n).withColumn("_pos", pos)
    return ranked.filter(F.col("_pos") == F.floor((F.col("member_count") - 1) / 2) + 1).drop("_pos")


def verdict(df: DataFrame, levels: dict[str, Column] | None = None, floor: Column | None = None) -> DataFrame:
    """Agreement level from columns o_* (official) and m_* (median model member) of one row per point."""
    oc, mc = F.col("o_crest"), F.col("m_crest")
    denominator = F.greatest(oc, F.coalesce(floor, F.lit(0.0))) if floor is not None else oc
    delta = F.when(denominator > 0, (mc - oc) / denominator)
    o_crests, m_crests = F.col("o_shape") == "crest", F.col("m_shape") == "crest"
    timing = F.when(o_crests & m_crests, F.abs(hours_between(F.col("m_crest_time"), F.col("o_crest_time"))))
    shapes_disagree = o_crests != m_crests
    opposed = ~o_crests & ~m_crests & (
        ((F.col("o_shape") == "rising") & (F.col("m_shape") == "receding")) | ((F.col("o_shape") == "receding") & (F.col("m_shape") == "rising"))
    )
    steps = category_steps(category(oc, levels), category(mc, levels)) if levels is not None else F.lit(None).cast("int")
    high = (
        (F.abs(delta) <= HIGH_MAGNITUDE) & F.coalesce(timing <= HIGH_TIMING_H, F.lit(True)) & F.coalesce(steps == 0, F.lit(True)) & ~shapes_disagree & ~opposed
    )
    moderate = (F.abs(delta) <= MODERATE_MAGNITUDE) & F.coalesce(timing <= MODERATE_TIMING_H, F.lit(True)) & F.coalesce(steps <= MODERATE_STEPS, F.lit(True))
    reason = (
        F.when(oc.isNull(), "no_official_crest").when(mc.isNull(), "no_members")
        .when(F.col("shared_h") < MIN_SHARED_H, "window_too_short").when(denominator <= 0, "non_positive_crest")
    )
    quality = F.array_compact(F.array(
        F.lit("no_divergence_floor") if floor is None else F.when(floor.isNull(), "no_divergence_floor"),
        F.when((F.col("distinct_crests") == 1) & (F.col("member_count") > 1), "members_identical_in_window"),
        F.when(F.col("lost_tail_h") > TRUNCATION_H, "window_truncated_by_model_coverage"),
        F.when(F.coalesce("o_step_h", F.lit(0.0)) > F.coalesce("m_step_h", F.lit(0.0)), "official_series_coarser_than_model"),
        F.when(shapes_disagree, "one_forecast_crests_the_other_does_not"),
        F.when(~o_crests & ~m_crests, "timing_not_assessable_no_crest"),
        F.when(opposed, "trends_oppose_without_a_crest"),
    ))
    state = F.when(reason.isNotNull(), "unknown").when(high, "high").when(moderate, "moderate").otherwise("low")
    return df.withColumns({
        "delta": F.when(reason.isNull(), delta), "timing_h": F.when(reason.isNull(), timing), "steps": F.when(reason.isNull(), steps),
        "state": state, "reason": F.coalesce(reason, F.lit("ok")), "quality": F.when(oc.isNotNull() & mc.isNotNull(), quality),
    })
