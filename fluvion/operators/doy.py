"""Day-of-year statistics over daily means.

Input is always one row per (site, day). A (site, key) group therefore holds at most
(2w + 1) values per year of record, whatever the number of raw readings behind them, so sorting
such a group inside one task is bounded by the length of the calendar.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from fluvion.functions.arrays import quantile_sorted
from fluvion.functions.clocks import key_of_index, neighbour_indices
from fluvion.functions.values import number
from fluvion.operators.joins import calendar_lag, doy_windows

# Fixed values.
LEVELS = (5, 10, 25, 50, 75, 90, 95)
MIN_SAMPLE = 10
WINDOW_DAYS = 2
TAIL_FLOOR = 0.90
MIN_TAIL_YEARS = 5
GROWTH_TAIL_FRACTION = 0.1
GROWTH_DIGITS = 4
CANDIDATE_TAIL = (96, 97, 98, 99, 99.5)
TAIL_MIN_EXCEEDANCES = 5

P = {level: f"p{level:02d}" for level in LEVELS}


def row_problem(approval: Column, raw: Column) -> Column:
    """Why a record row is not part of the climatology; null when it is."""
    v = number(raw)
    return (
        F.when(approval != "Approved", "not_approved")
        .when(raw.isNull(), "no_value")
        .when(v.isNull(), "unparseable")
        .when(v < 0, "negative")
    )


def clean_daily(rows: DataFrame) -> DataFrame:
    """One approved, parseable, non-negative value per (site, day); the last row of the file wins."""
    good = rows.filter(row_problem(F.col("approval"), F.col("raw")).isNull())
    return good.groupBy("site", "day").agg(F.max_by(number(F.col("raw")), F.col("file_pos")).alias("value"))


def site_windows(daily: DataFrame, keys: DataFrame | None = None) -> DataFrame:
    """Window copies of the days; with ``keys`` (site, key) only those of the windows asked for.

    The copies are made map-side after the daily mean and dealt by (site, key), so a site's record is
    spread over its 366 windows and never meets in one task. Asked windows are known before the copies are made: a day is
    copied only into those of them that contain it, and the others are never written.
    """
    if keys is None:
        return doy_windows(daily, window_days=WINDOW_DAYS)
    asked = keys.groupBy("site").agg(F.collect_set("key").alias("_asked"))
    met = daily.join(asked, "site").withColumn("key", F.explode(F.array_intersect(neighbour_indices(F.col("doy"), WINDOW_DAYS), F.col("_asked"))))
    return met.drop("_asked")


def ladder(daily: DataFrame, keys: DataFrame | None = None) -> DataFrame:
    """Percentile ladder per (site, key) over the pooled window; too small a sample gives none."""
    g = site_windows(daily, keys).groupBy("site", "key").agg(
        F.count(F.lit(1)).alias("n"), F.percentile("value", [x / 100 for x in LEVELS]).alias("p")
    )
    return g.filter(F.col("n") >= MIN_SAMPLE).select("site", "key", "n", *[F.col("p")[i].alias(P[x]) for i, x in enumerate(LEVELS)])


def samples(daily: DataFrame, keys: DataFrame | None = None) -> DataFrame:
    """The sorted pooled sample of each (site, key), as an array of (value, day, wy)."""
    g = site_windows(daily, keys).groupBy("site", "key").agg(F.count(F.lit(1)).alias("n"), F.collect_list(F.struct("value", "day", "wy")).alias("pool"))
    return g.filter(F.col("n") >= MIN_SAMPLE).select("site", "key", F.sort_array("pool").alias("sample"))


def reference(daily: DataFrame, keys: DataFrame | None = None) -> DataFrame:
    """Ladder and record support of each key (or of the ``keys`` asked for) from one pass over its sorted sample.

    Support: counts, record with its day (later day on ties), p90 floor, water years above it.
    """
    s = samples(daily, keys).withColumn("v", F.transform("sample", lambda r: r["value"]))
    s = s.withColumn("tail_floor", quantile_sorted(F.col("v"), TAIL_FLOOR)).withColumn("_top", F.element_at("sample", -1))
    years = lambda c: F.size(F.array_distinct(F.transform(c, lambda r: r["wy"])))
    return s.select(
        "site", "key", F.size("sample").cast("long").alias("n"), *[quantile_sorted(F.col("v"), x / 100).alias(P[x]) for x in LEVELS],
        years(F.col("sample")).alias("water_years"), F.col("_top.value").alias("maximum"), F.col("_top.day").alias("maximum_day"), "tail_floor",
        years(F.filter("sample", lambda r: r["value"] > F.col("tail_floor"))).alias("tail_years"),
    )


CONTEXT = ("site", "key", "n", "water_years", "maximum", "maximum_day", "tail_floor", "tail_years")


def record_context(daily: DataFrame) -> DataFrame:
    """The support columns of :func:`reference`; the ladder columns are pruned away."""
    return reference(daily).select(*CONTEXT)


def record_tail(daily: DataFrame, context: DataFrame) -> DataFrame:
    """Days above the lowest floor among the windows that contain them.

    The floors of a site travel as one map of at most 366 entries, so days are joined once by site
    and never copied per window.
    """
    floors = context.groupBy("site").agg(F.map_from_entries(F.collect_list(F.struct("key", "tail_floor"))).alias("floors"))
    covering = F.transform(neighbour_indices(F.col("doy"), WINDOW_DAYS), lambda k: F.try_element_at("floors", k))
    lowest = daily.join(floors, "site").withColumn("lowest_floor", F.array_min(covering))
    return lowest.filter(F.col("value") > F.col("lowest_floor")).select("site", "day", "doy", "value", "lowest_floor")


def growth_ratios(daily: DataFrame, window_h: int) -> DataFrame:
    lag = calendar_lag(daily.select("site", "day", "value"), ["site"], max(1, window_h // 24))
    usable = lag.filter((F.col("prior") > 0) & (F.col("value") > 0))
    return usable.withColumn("growth", F.round(F.col("value") / F.col("prior"), GROWTH_DIGITS))


def growth_reference(daily: DataFrame, window_h: int) -> DataFrame:
    """Largest tenth of the change ratios per site, with the full denominator kept beside them."""
    site = W.partitionBy("site")
    ranked = (
        growth_ratios(daily, window_h)
        .withColumn("n", F.count(F.lit(1)).over(site))
        .withColumn("rn", F.row_number().over(site.orderBy(F.desc("growth"), F.desc("day"))))
    )
    return ranked.filter(F.col("rn") <= F.ceil(F.lit(GROWTH_TAIL_FRACTION) * F.col("n"))).select(
        "site", F.lit(window_h).alias("window_h"), "n", "rn", "growth"
    )


def percentile_of(value: Column) -> Column:
    """Percentile of a value in the ladder columns of the same row, clamped at both ends."""
    first, last = P[LEVELS[0]], P[LEVELS[-1]]
    expr = F.when(value.isNull() | F.col(first).isNull(), F.lit(None).cast("double"))
    expr = expr.when(value <= F.col(first), F.lit(float(LEVELS[0]))).when(value >= F.col(last), F.lit(float(LEVELS[-1])))
    for lo, hi in zip(LEVELS, LEVELS[1:]):
        a, b = F.col(P[lo]), F.col(P[hi])
        inside = value.between(a, b)
        expr = expr.when(inside & (a == b), F.lit(float(hi))).when(inside, F.lit(float(lo)) + (value - a) / (b - a) * F.lit(float(hi - lo)))
    return expr


def outside_range(value: Column) -> Column:
    return (value < F.col(P[LEVELS[0]])) | (value > F.col(P[LEVELS[-1]]))


def monotone() -> Column:
    """A ladder whose steps decrease anywhere is refused."""
    ok = F.lit(True)
    for lo, hi in zip(LEVELS, LEVELS[1:]):
        ok = ok & (F.col(P[lo]) <= F.col(P[hi]))
    return ok


def window_rank(days: DataFrame, context: DataFrame, tail: DataFrame) -> DataFrame:
    """Exact rank of each (site, key, value) in the stored tail of its window.

    ``days``: site, day, key, value. Only days at or above the floor of their key meet the tail;
    their rank is a count of tail values, made by one join on (site, key) and one aggregation.
    The tail of a key holds at most a tenth of a calendar-bounded window.
    """
    with_support = days.join(context, ["site", "key"], "left")
    hot = with_support.filter(F.col("value") >= F.col("tail_floor")).select("site", "key", "day", "value")
    stored = doy_windows(tail.select("site", "doy", F.col("value").alias("tail_value"))).drop("doy")
    stored = stored.groupBy("site", "key").agg(F.sort_array(F.collect_list("tail_value")).alias("tail"))
    ranks = hot.join(stored, ["site", "key"], "left").select(
        "site", "key", "day", (F.size(F.filter(F.coalesce("tail", F.array().cast("array<double>")), lambda v: v > F.col("value"))) + 1).alias("rank")
    )
    out = with_support.join(ranks, ["site", "key", "day"], "left")
    reason = F.when(F.col("n").isNull(), "no_record_context").when(F.col("value") < F.col("tail_floor"), "below_tail_floor")
    return out.select(
        "site", "day", "key", "value", "rank", (F.col("n") + 1).alias("rank_of"),
        F.coalesce(F.col("value") > F.col("maximum"), F.lit(False)).alias("exceeds_record"),
        F.coalesce(F.col("tail_years") < MIN_TAIL_YEARS, F.lit(False)).alias("thin_tail"), F.coalesce(reason, F.lit("ok")).alias("reason"),
    )


def growth_rank(changes: DataFrame, reference: DataFrame) -> DataFrame:
    """Rank of each change in the stored decile of its site; smaller changes are not ranked.

    The decile is held per site as one sorted array: at most a tenth of the days of record.
    """
    stored = reference.groupBy("site", "n").agg(F.sort_array(F.collect_list("growth")).alias("top"))
    g = F.round("growth", GROWTH_DIGITS)
    j = changes.join(stored, "site", "left")
    above = F.size(F.filter("top", lambda v: v > g))
    reason = F.when(F.col("top").isNull(), "no_growth_reference").when(g < F.element_at("top", 1), "outside_stored_decile")
    return j.select(
        *changes.columns, F.when(reason.isNull(), above + 1).alias("growth_rank"), F.col("n").alias("growth_rank_of"),
        F.coalesce(reason, F.lit("ok")).alias("growth_reason"),
    )


def key_name(index: Column) -> Column:
    return key_of_index(index)


def tail_support(daily: DataFrame) -> DataFrame:
    """Which levels above p95 the sample of each key can carry: value and exceedances of each."""
    s = samples(daily)
    values = F.transform("sample", lambda r: r["value"])
    out = s.withColumn("v", values).withColumn("p95", quantile_sorted(F.col("v"), 0.95))
    cols = []
    for level in CANDIDATE_TAIL:
        name = f"{level:g}".replace(".", "_")
        out = out.withColumn(f"p{name}", quantile_sorted(F.col("v"), level / 100))
        cols += [f"p{name}", count_above(F.col("v"), F.col(f"p{name}")).alias(f"above_{name}")]
    return out.select("site", "key", F.size("v").cast("long").alias("n"), "v", "p95", *cols)


def count_above(values: Column, bound: Column) -> Column:
    return F.size(F.filter(values, lambda x: x > bound))
