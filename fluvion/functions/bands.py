"""Percentile bands, scores, sampling error and the confidence ladder."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Fixed values.
BANDS = ("low", "moderate", "high", "very_high")
PERCENTILE_EDGES = (25.0, 75.0, 90.0)
RAIN_EDGES_MM = (25.0, 75.0, 150.0)
RAIN_SCORE_CAP_MM = 200.0
CONFIDENCE = ("unknown", "low", "moderate", "high")


def band(value: Column, edges: tuple[float, ...] = PERCENTILE_EDGES) -> Column:
    expr = F.when(value.isNull(), F.lit(None).cast("string"))
    for edge, name in zip(edges, BANDS):
        expr = expr.when(value < edge, F.lit(name))
    return expr.otherwise(F.lit(BANDS[-1]))


def band_index(name: Column) -> Column:
    return F.array_position(F.array(*[F.lit(b) for b in BANDS]), name).cast("int")


def piecewise_score(value: Column, edges: tuple[float, ...] = RAIN_EDGES_MM, cap: float = RAIN_SCORE_CAP_MM) -> Column:
    """Equal slices of [0, 1] between consecutive edges, linear inside a slice, capped."""
    knots = (0.0, *edges, cap)
    width = 1.0 / (len(knots) - 1)
    v = F.least(F.greatest(value, F.lit(0.0)), F.lit(cap))
    expr = F.when(value.isNull(), F.lit(None).cast("double"))
    for i, (lo, hi) in enumerate(zip(knots, knots[1:])):
        expr = expr.when(v <= hi, (F.lit(float(i)) + (v - lo) / F.lit(hi - lo)) * F.lit(width))
    return expr


def independent_years(sample_count: Column, window_days: int = 2) -> Column:
    return F.greatest(F.lit(1), F.floor(sample_count / (2 * window_days + 1)).cast("int"))


def rank_standard_error(percentile: Column, years: Column) -> Column:
    p = F.least(F.greatest(percentile, F.lit(0.0)), F.lit(100.0)) / 100.0
    return F.when(years >= 1, F.lit(100.0) * F.sqrt(p * (1.0 - p) / years))


def boundary(percentile: Column, se: Column) -> Column:
    """Whether the band survives one rank standard error either way."""
    lo = band(F.greatest(F.lit(0.0), percentile - se))
    hi = band(F.least(F.lit(100.0), percentile + se))
    return F.when(se.isNull(), F.lit("unquantified")).when(lo == hi, F.lit("separated")).otherwise(F.lit("near_band_edge"))


def bands_within_error(percentile: Column, se: Column) -> Column:
    lo = band_index(band(F.greatest(F.lit(0.0), percentile - se)))
    hi = band_index(band(F.least(F.lit(100.0), percentile + se)))
    names = F.array(*[F.lit(b) for b in BANDS])
    return F.when(lo < hi, F.slice(names, lo, hi - lo + 1)).otherwise(F.array().cast("array<string>"))


def seasonal_multiple(value: Column, reference: Column) -> Column:
    ok = (reference > 0) & ~F.isnan(reference) & (reference < F.lit(float("inf")))
    return F.when(ok, value / reference)


def confidence_rank(label: Column) -> Column:
    return F.coalesce(F.array_position(F.array(*[F.lit(c) for c in CONFIDENCE]), label).cast("int"), F.lit(1))


def confidence_label(rank: Column) -> Column:
    return F.element_at(F.array(*[F.lit(c) for c in CONFIDENCE]), rank)


def lowest_confidence(*labels: Column) -> Column:
    return confidence_label(F.least(*[confidence_rank(x) for x in labels]))


def one_level_down(label: Column) -> Column:
    """Never below 'low', and 'unknown' moves up to that floor."""
    return confidence_label(F.greatest(F.lit(2), confidence_rank(label) - 1))


def confidence_ceiling(raw: Column) -> Column:
    cleaned = F.lower(F.trim(F.coalesce(raw, F.lit(""))))
    return F.when(cleaned.isin(*CONFIDENCE), cleaned).otherwise(F.lit("unknown"))


def freshness_confidence(state: Column) -> Column:
    return (
        F.when(state == "current", F.lit("high"))
        .when(state.isin("stale", "degraded", "partial"), F.lit("low"))
        .otherwise(F.lit("unknown"))
    )
