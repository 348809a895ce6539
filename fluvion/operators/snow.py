"""Snow-station context: basin assignment, percent of median, prototype signal."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from fluvion.functions.overlay import usable_qc

# Fixed values.
OUTSIDE_DOMAIN = "no_associated_huc_in_any_seeded_basin"
FILED_UNDER_NEIGHBOUR = "associated_only_with_other_seeded_basins"
PRECIP_WINDOW_DAYS = 14
PRIOR_DAYS = 7
STALE_AFTER_DAYS = 3
HOLDING_IN = 0.2
MAPPING_CONFIDENCE = {"high": 0.85, "medium": 0.65, "low": 0.45}


def assign_basins(stations: DataFrame, basins: DataFrame) -> DataFrame:
    """Basin by 8-digit code, with the provider's own associations as a veto.

    A station with associations but none in any basin is dropped; one associated only with other
    basins stays and is flagged. Stations whose code belongs to no basin do not appear.
    """
    codes = basins.select("basin", F.explode("huc8").alias("code")).withColumn("code", F.substring("code", 1, 8))
    placed = stations.withColumn("code", F.substring("huc", 1, 8)).join(codes, "code")
    assoc = placed.select("station", "basin", F.explode("associated").alias("a")).withColumn("code", F.substring("a", 1, 8))
    counted = (
        assoc.join(codes.withColumnRenamed("basin", "assoc_basin"), "code", "left")
        .groupBy("station")
        .agg(
            F.count(F.lit(1)).alias("n_assoc"),
            F.count("assoc_basin").alias("n_domain"),
            F.count_if(F.col("assoc_basin") == F.col("basin")).alias("n_basin"),
        )
    )
    out = placed.drop("code").join(counted, "station", "left").fillna(0, ["n_assoc", "n_domain", "n_basin"])
    verdict = (
        F.when((F.col("n_assoc") > 0) & (F.col("n_domain") == 0), OUTSIDE_DOMAIN)
        .when((F.col("n_assoc") > 0) & (F.col("n_basin") == 0), FILED_UNDER_NEIGHBOUR)
    )
    return out.withColumn("verdict", verdict)


def _context(df: DataFrame, causes: list[str], digits: int = 1) -> DataFrame:
    """Unweighted mean over usable sites per basin, with exclusions counted by cause."""
    agg = [F.count_if(F.col("cause") == c).alias(c) for c in causes]
    return (
        df.groupBy("basin", "day")
        .agg(
            F.count(F.lit(1)).alias("n_mapped"),
            F.count_if(F.col("cause").isNull()).alias("n_used"),
            F.round(F.avg(F.when(F.col("cause").isNull(), F.col("pct"))), digits).alias("value"),
            *agg,
        )
        .withColumn("reason", F.when(F.col("n_used") == 0, F.lit("no_usable_site")))
    )


def swe_percent_of_median(readings: DataFrame, sites: DataFrame) -> DataFrame:
    """Percent of median per basin on the latest day any of its sites reports a value.

    ``readings``: station, day, value, median, qc_flag. ``sites``: station, basin.
    """
    placed = readings.join(sites, "station")
    latest = placed.filter(F.col("value").isNotNull()).groupBy("basin").agg(F.max("day").alias("day"))
    wanted = sites.join(latest, "basin")
    has_series = readings.select("station").distinct().withColumn("has_series", F.lit(True))
    on_day = readings.select("station", "day", "value", "median", "qc_flag")
    rows = wanted.join(has_series, "station", "left").join(on_day, ["station", "day"], "left")
    cause = (
        F.when(F.col("has_series").isNull(), "no_series")
        .when(F.col("value").isNull(), "no_value_on_day")
        .when(~usable_qc(F.col("qc_flag")), "suspect_flag")
        .when(F.col("median").isNull(), "median_absent")
        .when(F.col("median") <= 0, "median_zero")
    )
    rows = rows.withColumn("cause", cause).withColumn("pct", F.col("value") * 100.0 / F.nullif("median", F.lit(0.0)))
    return _context(rows, ["no_series", "no_value_on_day", "suspect_flag", "median_absent", "median_zero"])


def precipitation_percent_of_median(readings: DataFrame, sites: DataFrame, window_days: int = PRECIP_WINDOW_DAYS) -> DataFrame:
    """Percent of the median increment of accumulated precipitation over a calendar window."""
    placed = readings.join(sites, "station")
    latest = placed.filter(F.col("value").isNotNull()).groupBy("basin").agg(F.max("day").alias("day"))
    wanted = sites.join(latest, "basin")
    has_series = readings.select("station").distinct().withColumn("has_series", F.lit(True))
    now = readings.select("station", "day", "value", "median", "qc_flag")
    then = readings.select(
        "station", F.date_add("day", window_days).alias("day"),
        F.col("value").alias("value0"), F.col("median").alias("median0"), F.col("qc_flag").alias("qc0"),
    )
    rows = wanted.join(has_series, "station", "left").join(now, ["station", "day"], "left").join(then, ["station", "day"], "left")
    amount, reference = F.col("value") - F.col("value0"), F.col("median") - F.col("median0")
    cause = (
        F.when(F.col("has_series").isNull(), "no_series")
        .when(F.col("value").isNull(), "no_value_on_day")
        .when(F.col("value0").isNull(), "no_value_at_window_start")
        .when(~usable_qc(F.col("qc_flag")) | ~usable_qc(F.col("qc0")), "suspect_flag")
        .when(F.col("median").isNull() | F.col("median0").isNull(), "median_absent")
        .when((amount < 0) | (reference < 0), "water_year_rollover")
        .when(reference <= 0, "median_increment_zero")
    )
    rows = rows.withColumn("cause", cause).withColumn("pct", amount * 100.0 / F.nullif(reference, F.lit(0.0)))
    causes = ["no_series", "no_value_on_day", "no_value_at_window_start", "suspect_flag", "median_absent", "water_year_rollover", "median_increment_zero"]
    return _context(rows, causes)


def prototype_signal(readings: DataFrame, today: Column) -> DataFrame:
    """Latest reading beside the one nearest to seven days earlier, with trend and confidence.

    Grouped per station with order-free aggregates: the latest by ``max_by`` and the prior by the
    smallest distance to its target day (earlier day on ties).
    """
    latest = readings.groupBy("station").agg(F.max(F.struct("day", "value")).alias("latest"))
    rows = readings.join(latest, "station")
    target = F.date_sub(F.col("latest.day"), PRIOR_DAYS)
    earlier = F.col("day") < F.col("latest.day")
    prior = F.min(F.when(earlier, F.struct(F.abs(F.datediff("day", target)).alias("gap"), F.col("day").alias("day"), F.col("value").alias("value"))))
    out = rows.groupBy("station", "latest", "mapping_confidence").agg(prior.alias("prior"))
    delta = F.col("latest.value") - F.col("prior.value")
    stale = F.datediff(today, F.col("latest.day")) > STALE_AFTER_DAYS
    base = F.coalesce(*[F.when(F.col("mapping_confidence") == k, F.lit(v)) for k, v in MAPPING_CONFIDENCE.items()], F.lit(0.5))
    return out.select(
        "station",
        F.col("latest.day").alias("day"),
        F.col("latest.value").alias("value"),
        F.col("prior.day").alias("prior_day"),
        F.col("prior.value").alias("prior"),
        F.when(F.col("prior").isNull(), "insufficient_history").when(F.abs(delta) < HOLDING_IN, "holding").when(delta > 0, "rising").otherwise("melting").alias("trend"),
        stale.alias("stale"),
        F.when(stale, F.greatest(F.lit(0.30), base - 0.30)).otherwise(base).alias("confidence"),
    )
