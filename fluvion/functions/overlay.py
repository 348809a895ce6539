"""What may be drawn or compared together: refusal codes, windows and basis choice as columns."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from fluvion.functions.clocks import hours_between, plus_hours

# Fixed values.
MAX_WINDOW_DAYS = 45
TRAILING_WINDOW_H = 72
ID_PATTERNS = {
    "basin": r"^basin:[a-z0-9-]+$",
    "lid": r"^[A-Z0-9]{3,8}$",
    "station": r"^station:[a-z]+:[A-Za-z0-9._-]+$",
}
OBJECT_KINDS = ("channel_rt", "land", "reservoir", "terrain_rt", "forcing")
SUSPECT_QC = ("S", "N")
RECONSTRUCTED_PRODUCT = "product:nws-fls-crest"
BACKFILL_LAG_DAYS = 7
NATIVE_UNITS = {"precipitation": "kg m**-2", "snow_level": "m"}
STORED_UNITS = {"precipitation": "mm", "snow_level": "m"}
UNDECLARED_UNITS = ("unknown", "")


def threshold_refusal(basis: Column, unit: Column, datum: Column, t_basis: Column, t_unit: Column, t_datum: Column) -> Column:
    """An undeclared unit or datum on the axis does not refuse; a different one does."""
    return (
        F.when(t_basis.isNull(), F.lit("no_thresholds"))
        .when(t_basis != basis, F.lit("basis"))
        .when(t_unit != unit, F.lit("unit"))
        .when((basis == "stage") & (t_datum != datum), F.lit("datum"))
        .otherwise(F.lit("drawn"))
    )


def forecast_refusal(basis: Column, unit: Column, datum: Column, primary: Column, r_unit: Column, r_datum: Column) -> Column:
    """A run on a stage axis must declare the same datum: an unknown one refuses too."""
    return (
        F.when(primary.isNull(), F.lit("no_run"))
        .when(primary != basis, F.lit("basis"))
        .when(r_unit != unit, F.lit("unit"))
        .when((basis == "stage") & datum.isNotNull() & r_datum.isNull(), F.lit("datum_undeclared"))
        .when((basis == "stage") & (r_datum != datum), F.lit("datum"))
        .otherwise(F.lit("drawn"))
    )


def crest_refusal(basis: Column, unit: Column, datum: Column, crest: Column, crest_time: Column, c_unit: Column, c_datum: Column) -> Column:
    return (
        F.when(crest.isNull() | crest_time.isNull(), F.lit("no_crest"))
        .when(c_unit != unit, F.lit("unit"))
        .when((basis == "stage") & (c_datum != datum), F.lit("datum"))
        .otherwise(F.lit("drawn"))
    )


def choose_basis(threshold_basis: Column, headroom_basis: Column, stage: Column, flow: Column) -> Column:
    return F.coalesce(
        threshold_basis,
        headroom_basis,
        F.when(stage.isNotNull(), F.lit("stage")),
        F.when(flow.isNotNull(), F.lit("flow")),
    )


def basis_source(threshold_basis: Column, headroom_basis: Column, stage: Column, flow: Column) -> Column:
    return (
        F.when(threshold_basis.isNotNull(), F.lit("thresholds"))
        .when(headroom_basis.isNotNull(), F.lit("headroom"))
        .when(stage.isNotNull() | flow.isNotNull(), F.lit("observed"))
        .otherwise(F.lit("undeclared"))
    )


def window_problem(start: Column, end: Column) -> Column:
    """Code of what is wrong with an explicit window; 'none' for an absent pair, 'ok' when usable."""
    return (
        F.when(start.isNull() & end.isNull(), F.lit("none"))
        .when(start.isNull() | end.isNull(), F.lit("one_bound_only"))
        .when(end <= start, F.lit("end_not_after_start"))
        .when(hours_between(end, start) > MAX_WINDOW_DAYS * 24, F.lit("too_long"))
        .otherwise(F.lit("ok"))
    )


def trailing_window(at: Column) -> tuple[Column, Column]:
    end = F.date_trunc("minute", at)
    return plus_hours(end, -TRAILING_WINDOW_H), end


def clamp(t: Column, start: Column, end: Column) -> Column:
    return F.least(F.greatest(t, start), end)


def inside(t: Column, start: Column, end: Column) -> Column:
    """Half-open on the left: (start, end]."""
    return (t > start) & (t <= end)


def object_kind(key: Column) -> Column:
    """Kind named in the last path part; the first match in the fixed order wins."""
    name = F.substring_index(key, "/", -1)
    expr = F.when(F.lit(False), F.lit(""))
    for kind in OBJECT_KINDS:
        expr = expr.when(F.contains(name, F.lit(kind)), F.lit(kind))
    return expr.otherwise(F.lit("other"))


def header_matches(header_ddhhmm: Column, issued_at: Column) -> Column:
    return header_ddhhmm == F.date_format(issued_at, "ddHHmm")


def split_pair(primary_is_stage: Column, primary: Column, secondary: Column) -> tuple[Column, Column]:
    """(stage, flow) of a provider's primary/secondary pair."""
    return (
        F.when(primary_is_stage, primary).otherwise(secondary),
        F.when(primary_is_stage, secondary).otherwise(primary),
    )


def reach_number(reach_id: Column) -> Column:
    """Digits after the last colon; anything else is no reach."""
    return F.nullif(F.regexp_extract(reach_id, r"^(?:.*:)?(\d+)$", 1), F.lit("")).try_cast("long")


def field_unit(parameter: Column, native: Column) -> Column:
    """Struct(unit, flag, refusal): the expected native unit is renamed, an undeclared one flagged."""
    undeclared = F.lower(F.trim(native)).isin(*UNDECLARED_UNITS)
    expected = F.when(parameter == "precipitation", F.lit(NATIVE_UNITS["precipitation"])).when(parameter == "snow_level", F.lit(NATIVE_UNITS["snow_level"]))
    stored = F.when(parameter == "precipitation", F.lit(STORED_UNITS["precipitation"])).when(parameter == "snow_level", F.lit(STORED_UNITS["snow_level"]))
    flagged = (parameter == "snow_level") & undeclared
    refusal = F.when(expected.isNull(), F.lit("unknown_parameter")).when(~flagged & (native != expected), F.lit("unexpected_unit"))
    return F.struct(
        F.when(refusal.isNull(), stored).alias("unit"),
        F.when(flagged, F.lit("unit_from_documentation")).alias("flag"),
        refusal.alias("refusal"),
    )


def is_backfilled(quality: Column, product: Column, issued_at: Column, retrieved_at: Column) -> Column:
    late = F.coalesce(hours_between(retrieved_at, issued_at) > BACKFILL_LAG_DAYS * 24, F.lit(False))
    return F.coalesce(F.array_contains(quality, "backfilled"), F.lit(False)) | (product == RECONSTRUCTED_PRODUCT) | late


def usable_qc(qc_flag: Column) -> Column:
    return ~F.coalesce(qc_flag.isin(*SUSPECT_QC), F.lit(False))
