"""Column expressions over the four clocks and the hydrologic calendar."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Fixed values.
WINTER_MONTHS = (11, 12, 1, 2)
LEAP_YEAR_START = "2000-01-01"
DOY_KEYS = 366
OFFSET_PATTERN = r"([Zz]|[+-]\d{2}:?\d{2})$"


def knowledge_time(valid_time: Column, retrieved_at: Column, issued_at: Column | None = None) -> Column:
    """When a row could first be known: never before it was issued (or true) nor before it was fetched."""
    anchor = valid_time if issued_at is None else F.coalesce(issued_at, valid_time)
    return F.greatest(anchor, retrieved_at)


def has_offset(text: Column) -> Column:
    return F.coalesce(F.trim(text).rlike(OFFSET_PATTERN), F.lit(False))


def parse_instant(text: Column) -> Column:
    """UTC instant of an ISO string; a string without an offset is refused (null), never assumed UTC."""
    return F.when(has_offset(text), F.try_to_timestamp(F.trim(text)))


def iso_z(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def hours_between(later: Column, earlier: Column) -> Column:
    return (F.unix_micros(later) - F.unix_micros(earlier)) / F.lit(3_600_000_000.0)


def seconds_between(later: Column, earlier: Column) -> Column:
    return F.floor((F.unix_micros(later) - F.unix_micros(earlier)) / F.lit(1_000_000)).cast("long")


def plus_hours(ts: Column, hours: Column | float | int) -> Column:
    h = hours if isinstance(hours, Column) else F.lit(hours)
    return F.timestamp_micros((F.unix_micros(ts) + F.round(h * F.lit(3_600_000_000))).cast("long"))


def local_day_end(day: Column, zone: Column, known_zones: tuple[str, ...]) -> Column:
    """Instant at which a local calendar day is complete; an unknown zone falls back to UTC, flagged."""
    midnight = F.date_add(day, 1).cast("timestamp")
    known = F.coalesce(zone.isin(*known_zones), F.lit(False))
    return F.struct(
        F.when(known, F.to_utc_timestamp(midnight, F.when(known, zone).otherwise(F.lit("UTC")))).otherwise(midnight).alias("valid_time"),
        F.when(~known, F.lit("day_boundary_assumed_utc")).alias("flag"),
    )


def fixed_offset_day_end(day: Column, utc_offset_hours: Column) -> Column:
    midnight = F.date_add(day, 1).cast("timestamp")
    return F.struct(
        F.when(utc_offset_hours.isNull(), midnight).otherwise(plus_hours(midnight, -utc_offset_hours)).alias("valid_time"),
        F.when(utc_offset_hours.isNull(), F.lit("day_boundary_assumed_utc")).alias("flag"),
    )


def water_year(day: Column) -> Column:
    return F.year(day) + (F.month(day) >= 10).cast("int")


def doy_key(day: Column) -> Column:
    return F.date_format(day, "MM-dd")


def doy_index(day: Column) -> Column:
    """Position on the 366-day leap calendar, so that 29 February keeps its own slot."""
    in_leap = F.make_date(F.lit(2000), F.month(day), F.dayofmonth(day))
    return F.datediff(in_leap, F.lit(LEAP_YEAR_START).cast("date"))


def key_of_index(index: Column) -> Column:
    return F.date_format(F.date_add(F.lit(LEAP_YEAR_START).cast("date"), index), "MM-dd")


def neighbour_indices(index: Column, window_days: int = 2) -> Column:
    """The wrapped positions whose window contains ``index``."""
    return F.transform(F.sequence(F.lit(-window_days), F.lit(window_days)), lambda d: F.pmod(index + d, F.lit(DOY_KEYS)))


def is_winter(ts: Column) -> Column:
    return F.month(ts).isin(*WINTER_MONTHS)


def vtec_time(token: Column) -> Column:
    """``yymmddThhmmZ`` with the usual two-digit-year pivot (69-99 is 19xx); all zeros means undefined."""
    ok = token.rlike(r"^\d{6}T\d{4}Z$") & (token != F.lit("000000T0000Z"))
    century = F.when(F.substring(token, 1, 2) >= "69", F.lit("19")).otherwise(F.lit("20"))
    return F.when(ok, F.try_to_timestamp(F.concat(century, token), F.lit("yyyyMMdd'T'HHmm'Z'")))
