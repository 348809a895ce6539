"""Column expressions for numbers, units, quality flags and freshness."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Spellings and names that stored rows must share.
QUALIFIER_FLAGS = {
    "P": "provisional",
    "A": "approved",
    "e": "estimated",
    "E": "estimated",
    "Ice": "ice",
    "Eqp": "equipment",
    "Ssn": "seasonal",
    "Dis": "discontinued",
    "***": "suspect",
    "ESTIMATED": "estimated",
}
APPROVAL_FLAGS = {"Approved": "approved", "Provisional": "provisional"}
UNIT_ALIASES = {"ft3/s": "cfs", "ft^3/s": "cfs", "cfs": "cfs", "kcfs": "kcfs", "ft": "ft", "feet": "ft"}
UNIT_FACTORS = {("kcfs", "cfs"): 1000.0, ("cfs", "kcfs"): 0.001}
BACKFILLED = "backfilled"
DEGRADED_CADENCES = 4
NUMBER_PATTERN = r"^\s*[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?\s*$"


def literal_map(d: dict) -> Column:
    return F.create_map(*[F.lit(x) for kv in d.items() for x in kv])


def mapped_or_self(value: Column, names: dict[str, str]) -> Column:
    return F.coalesce(F.try_element_at(literal_map(names), value), value)


def number(raw: Column) -> Column:
    """A finite double, or null. Plain decimal notation only: '12f' or 'nan' is not a number."""
    text = raw.cast("string")
    parsed = F.when(text.rlike(NUMBER_PATTERN), F.trim(text).try_cast("double"))
    return F.when(F.abs(parsed) < F.lit(float("inf")), parsed)


def number_with_flag(raw: Column, sentinel: Column | float | None = None) -> Column:
    """Struct(value, flag): unparseable and sentinel numbers become null with the cause named."""
    parsed = number(raw)
    if sentinel is None:
        is_sentinel = F.lit(False)
    else:
        s = sentinel if isinstance(sentinel, Column) else F.lit(float(sentinel))
        is_sentinel = F.coalesce(parsed == s, F.lit(False))
    return F.struct(
        F.when(~is_sentinel, parsed).alias("value"),
        F.when(parsed.isNull(), F.lit("unparseable")).when(is_sentinel, F.lit("sentinel")).alias("flag"),
    )


def quality_flags(
    number_flag: Column,
    qualifiers: Column,
    value: Column,
    variable: Column,
    approval: Column | None = None,
    backfilled: bool = False,
) -> Column:
    """Flags in first-seen order: number problem, approval, qualifiers, range, origin."""
    parts = [F.array(number_flag)]
    if approval is not None:
        parts.append(F.array(mapped_or_self(approval, APPROVAL_FLAGS)))
    parts.append(F.transform(F.coalesce(qualifiers, F.array().cast("array<string>")), lambda q: mapped_or_self(q, QUALIFIER_FLAGS)))
    parts.append(F.array(F.when((variable == "flow") & (value < 0), F.lit("out_of_range"))))
    if backfilled:
        parts.append(F.array(F.lit(BACKFILLED)))
    return F.array_distinct(F.array_compact(F.concat(*parts)))


def normal_unit(raw: Column) -> Column:
    return mapped_or_self(F.trim(raw), UNIT_ALIASES)


def convert(value: Column, from_unit: Column, to_unit: Column) -> Column:
    """Same unit passes through, a known pair is scaled, anything else is null (a refusal)."""
    f, t = normal_unit(from_unit), normal_unit(to_unit)
    out = F.when(f == t, value)
    for (a, b), factor in UNIT_FACTORS.items():
        out = out.when((f == a) & (t == b), value * F.lit(factor))
    return out


def age_seconds(now: Column, valid_time: Column, retrieved_at: Column) -> Column:
    anchor = F.coalesce(valid_time, retrieved_at)
    return F.greatest(F.lit(0), F.unix_timestamp(now) - F.unix_timestamp(anchor)).cast("long")


def freshness(now: Column, valid_time: Column, retrieved_at: Column, cadence_s: Column, grace_s: Column) -> Column:
    """missing / unknown / degraded / stale / current, in that order of test."""
    age = age_seconds(now, valid_time, retrieved_at)
    silent = F.unix_timestamp(now) - F.unix_timestamp(retrieved_at)
    return (
        F.when(valid_time.isNull() & retrieved_at.isNull(), F.lit("missing"))
        .when(cadence_s.isNull() | grace_s.isNull(), F.lit("unknown"))
        .when(F.coalesce(silent > cadence_s * DEGRADED_CADENCES, F.lit(False)), F.lit("degraded"))
        .when(age > cadence_s + grace_s, F.lit("stale"))
        .otherwise(F.lit("current"))
    )


def is_stale(now: Column, latest: Column, minutes: int = 90) -> Column:
    """No instant at all counts as stale."""
    return F.coalesce(F.unix_timestamp(now) - F.unix_timestamp(latest) > minutes * 60, F.lit(True))


def ordinal(n: Column) -> Column:
    last2, last = n % 100, n % 10
    suffix = (
        F.when((last2 >= 10) & (last2 <= 20), F.lit("th"))
        .when(last == 1, F.lit("st"))
        .when(last == 2, F.lit("nd"))
        .when(last == 3, F.lit("rd"))
        .otherwise(F.lit("th"))
    )
    return F.concat(n.cast("string"), suffix)


def relative_difference(a: Column, b: Column) -> Column:
    return F.when(b != 0, (a - b) / b)
