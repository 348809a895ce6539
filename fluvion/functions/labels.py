"""Names, labels and sentences built from facts."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from fluvion.functions.clocks import hours_between

# Fixed values.
MAX_DAILY_AGE_H = 48
MAX_CAVEATS = 2


def window_label(hours: Column) -> Column:
    return F.concat(hours.cast("string"), F.lit("h"))


def rain_feature(window_h: Column, percentile: Column) -> Column:
    """Feature name of a basin precipitation number; no percentile means the deterministic run."""
    head = F.concat(F.lit("basin_qpf_"), window_h.cast("string"))
    return F.when(percentile.isNull(), F.concat(head, F.lit("h_deterministic"))).otherwise(
        F.concat(head, F.lit("h_pointwise_p"), percentile.cast("string"))
    )


def reference_name(origin: Column, site: Column, first: Column, last: Column, prefix: str = "") -> Column:
    span = F.concat(F.lit(prefix), first.cast("string"), F.lit("-" + prefix), last.cast("string"))
    return F.concat_ws(":", origin, site.cast("string"), F.coalesce(span, F.lit("unknown")))


def visual_intensity(percentile: Column, valid_time: Column, now: Column) -> Column:
    fresh = hours_between(now, valid_time) <= MAX_DAILY_AGE_H
    return F.when(fresh, F.round(percentile, 1) / 100.0)


def magnitude_phrase(delta: Column, difference: Column, floor: Column) -> Column:
    """How far the crests are apart: per cent of the official one, or flow where a floor was the denominator."""
    pct, size = F.abs(delta) * 100, F.round(F.abs(difference)).cast("long")
    side = F.when(delta > 0, "above").otherwise("below")
    relative = F.when(pct < 1, F.lit("within 1% of")).otherwise(F.format_string("%d%% %s", F.round(pct).cast("long"), side))
    return F.when(floor.isNull(), relative).when(size == 0, F.lit("within 1 cfs of")).otherwise(F.format_string("%,d cfs %s", size, side))


def basis_phrase(delta: Column, floor: Column) -> Column:
    """Names the denominator of the percentage where it is the action flow and not the official crest."""
    pct = F.abs(delta) * 100
    shown = F.when(pct < 1, F.lit("under 1")).otherwise(F.round(pct).cast("long").cast("string"))
    return F.when(floor.isNull(), F.lit("")).otherwise(F.format_string(" (%s%% of the action flow of %,d cfs)", shown, F.round(floor).cast("long")))


def timing_phrase(timing_h: Column, later: Column, official_shape: Column, model_shape: Column) -> Column:
    one_only = (official_shape == "crest") != (model_shape == "crest")
    return (
        F.when(timing_h < 0.5, F.lit("crests at the same time"))
        .when(timing_h.isNotNull(), F.format_string("crests %d h %s", F.round(timing_h).cast("long"), F.when(later, "later").otherwise("earlier")))
        .when(one_only, F.lit("only one of the two crests inside this window"))
        .otherwise(F.format_string("neither crests inside this window (official %s, model %s)", official_shape, model_shape))
    )


def explain(subject: str, delta: Column, timing: Column, caveats: list[Column], difference: Column, floor: Column) -> Column:
    """One sentence: magnitude and what it is a share of, timing, and at most two caveats in priority order.

    ``floor`` is null where the official crest itself was the denominator of ``delta``.
    """
    kept = F.slice(F.array_compact(F.array(*caveats)), 1, MAX_CAVEATS)
    head = F.format_string(f"{subject} peaks %s the official forecast%s, and %s", magnitude_phrase(delta, difference, floor), basis_phrase(delta, floor), timing)
    return F.concat(F.concat_ws("; ", head, F.nullif(F.concat_ws(" and ", kept), F.lit(""))), F.lit("."))
