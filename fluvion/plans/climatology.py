"""Reference building and ranking over all sites at once."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from fluvion.functions.values import relative_difference
from fluvion.operators import doy
from fluvion.session import staged

# Fixed values.
DISAGREEMENT_THRESHOLD = 0.1
TOP_BAND = 90.0


def latest_percentile(daily: DataFrame, ladder: DataFrame, published: DataFrame) -> DataFrame:
    """Percentile of each site's latest day, cross-checked against the published median."""
    latest = daily.groupBy("site").agg(F.max(F.struct("day", "doy", "value")).alias("b")).select("site", "b.*")
    j = latest.join(ladder.withColumnRenamed("key", "doy"), ["site", "doy"], "left")
    j = j.join(published.withColumnRenamed("key", "doy"), ["site", "doy"], "left")
    diff = relative_difference(F.col("p50"), F.col("published_p50"))
    return j.select(
        "site", "day", F.round(doy.percentile_of(F.col("value")), 1).alias("percentile"), diff.alias("disagreement"),
        (F.abs(diff) > DISAGREEMENT_THRESHOLD).alias("disagrees"),
    )


def vintages(daily: DataFrame, years: Sequence[int]) -> DataFrame:
    """One ladder per (vintage, site, key) from the days before each vintage year."""
    tagged = daily.withColumn("vintage", F.explode(F.array(*[F.lit(y) for y in years]))).filter(F.year("day") < F.col("vintage"))
    both = tagged.withColumn("site", F.struct("vintage", "site"))
    return doy.ladder(both).select(F.col("site.vintage").alias("vintage"), F.col("site.site").alias("site"), F.col("key").alias("doy"), *doy.P.values())


def percentile_in_vintage(daily: DataFrame, years: Sequence[int]) -> DataFrame:
    """Rank each day in the newest ladder that existed on that day."""
    own = F.greatest(*[F.when(F.year("day") >= y, F.lit(y)) for y in years])
    days = daily.withColumn("vintage", own).filter(F.col("vintage").isNotNull())
    j = days.join(vintages(daily, years), ["vintage", "site", "doy"], "left")
    return j.withColumn("percentile", doy.percentile_of(F.col("value")))


def vintage_sensitivity(daily: DataFrame, years: Sequence[int], from_year: int) -> DataFrame:
    """Does the first day in the top band move when the ladder's vintage changes?"""
    days = daily.filter(F.year("day") >= from_year)
    j = days.join(vintages(daily, years), ["site", "doy"])
    first = F.min(F.when(doy.percentile_of(F.col("value")) >= TOP_BAND, F.col("day")))
    per = j.groupBy("site", "vintage").agg(first.alias("first_top"))
    return per.groupBy("site").agg(
        F.count(F.lit(1)).alias("n_vintages"), F.min("first_top").alias("earliest"), F.max("first_top").alias("latest"),
        (F.countDistinct("first_top") > 1).alias("moves"),
    )


def build_references(daily: DataFrame, windows_h: Sequence[int] = (24, 48)) -> DataFrame:
    """Ladder, record support and growth reference of every site in one job, counted per site."""
    reference = staged(doy.reference(daily), "reference")
    per_site = reference.groupBy("site").agg(F.count(F.lit(1)).alias("n_ladders"), F.sum("n").alias("n_pooled"), F.max("maximum").alias("record"))
    tail = doy.record_tail(daily, reference).groupBy("site").agg(F.count(F.lit(1)).alias("n_tail"))
    out = per_site.join(tail, "site", "left")
    for h in windows_h:
        ref = doy.growth_reference(daily, h).groupBy("site").agg(F.count(F.lit(1)).alias(f"n_growth_{h}h"), F.min("growth").alias(f"floor_{h}h"))
        out = out.join(ref, "site", "left")
    return out
