"""Flood categories, headroom and comparability, as columns over the four official levels."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Fixed values.
CATEGORIES = ("action", "minor", "moderate", "major")
CATEGORY_ORDER = {"none": 0, "action": 1, "minor": 2, "moderate": 3, "major": 4}


def level_columns(prefix: str = "") -> dict[str, Column]:
    return {c: F.col(f"{prefix}{c}") for c in CATEGORIES}


def comparability(basis: Column, unit: Column, datum: Column, t_basis: Column, t_unit: Column, t_datum: Column) -> Column:
    """Code of the first rule that forbids comparing a value with a threshold, else null."""
    return (
        F.when(~basis.eqNullSafe(t_basis), F.lit("basis_mismatch"))
        .when(~unit.eqNullSafe(t_unit), F.lit("unit_mismatch"))
        .when((t_basis == "stage") & (datum.isNull() | t_datum.isNull() | (datum != t_datum)), F.lit("datum_mismatch"))
    )


def category(value: Column, levels: dict[str, Column]) -> Column:
    """Highest category reached ('at or above'); unknown without a value or without any level."""
    any_level = F.coalesce(*[levels[c] for c in CATEGORIES])
    expr = F.when(value.isNull() | any_level.isNull(), F.lit("unknown"))
    for c in reversed(CATEGORIES):
        expr = expr.when(value >= levels[c], F.lit(c))
    return expr.otherwise(F.lit("none"))


def category_reason(value: Column, levels: dict[str, Column], basis: Column, unit: Column) -> Column:
    first = F.coalesce(*[F.when(levels[c].isNotNull(), F.lit(c)) for c in CATEGORIES])
    first_level = F.coalesce(*[levels[c] for c in CATEGORIES])
    expr = (
        F.when(first_level.isNull(), F.lit("official thresholds carry no category values"))
        .when(value.isNull(), F.format_string("no %s value available to compare", basis))
    )
    for c in reversed(CATEGORIES):
        expr = expr.when(
            value >= levels[c],
            F.format_string("%.2f %s is at or above %s %s %.2f", value, unit, F.lit(c), basis, levels[c]),
        )
    return expr.otherwise(F.format_string("%.2f %s is below %s %s %.2f", value, unit, first, basis, first_level))


def next_category(value: Column, levels: dict[str, Column]) -> Column:
    expr = F.when(value.isNull(), F.lit(None).cast("string"))
    for c in CATEGORIES:
        expr = expr.when(levels[c] > value, F.lit(c))
    return expr.otherwise(F.lit("major"))


def headroom(value: Column, levels: dict[str, Column]) -> Column:
    """Distance to the next defined level above the value; null at or above the highest."""
    expr = F.when(value.isNull(), F.lit(None).cast("double"))
    for c in CATEGORIES:
        expr = expr.when(levels[c] > value, levels[c] - value)
    return expr


def hours_to_level(room: Column, rate_per_h: Column, direction: Column) -> Column:
    return F.when((direction == "rising") & (rate_per_h > 0), room / rate_per_h)


def headroom_reason(value: Column, levels: dict[str, Column], rate_per_h: Column, direction: Column) -> Column:
    room = headroom(value, levels)
    return (
        F.when(value.isNull(), F.lit("no_value"))
        .when(room.isNull(), F.lit("above_highest_category"))
        .when(hours_to_level(room, rate_per_h, direction).isNull(), F.lit("needs_rising_trend"))
    )


def category_rank(cat: Column) -> Column:
    expr = F.when(F.lit(False), F.lit(0))
    for name, rank in CATEGORY_ORDER.items():
        expr = expr.when(cat == name, F.lit(rank))
    return expr


def category_steps(a: Column, b: Column) -> Column:
    """Distance on the category ladder; null when either side is unknown."""
    return F.abs(category_rank(a) - category_rank(b))


def prototype_risk(stage: Column, levels: dict[str, Column], validated: Column, source: Column) -> Column:
    """First-generation four-state risk: only validated levels are compared, most severe first."""
    any_level = F.coalesce(*[levels[c] for c in CATEGORIES])
    return (
        F.when(stage.isNull(), F.lit("unknown"))
        .when(~validated, F.lit("unknown"))
        .when(any_level.isNull(), F.lit("unknown"))
        .when(stage >= levels["major"], F.lit("flood"))
        .when(stage >= levels["moderate"], F.lit("flood"))
        .when(stage >= levels["minor"], F.lit("elevated"))
        .when(stage >= levels["action"], F.lit("watch"))
        .otherwise(F.lit("calm"))
    )


def prototype_reason(stage: Column, levels: dict[str, Column], validated: Column, source: Column) -> Column:
    any_level = F.coalesce(*[levels[c] for c in CATEGORIES])
    return (
        F.when(stage.isNull(), F.lit("no_stage"))
        .when(~validated & (source == "configured_pending"), F.lit("thresholds_pending"))
        .when(~validated, F.lit("thresholds_unavailable"))
        .when(any_level.isNull(), F.lit("thresholds_empty"))
        .when(stage >= levels["major"], F.lit("above_major"))
        .when(stage >= levels["moderate"], F.lit("above_moderate"))
        .when(stage >= levels["minor"], F.lit("above_minor"))
        .when(stage >= levels["action"], F.lit("above_action"))
        .otherwise(F.lit("below_action"))
    )
