"""Zonal statistics: cells joined to sparse basin weights."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# Fixed values.
RADAR_MISSING, RADAR_NO_COVERAGE, RADAR_MIN_VALID = -1.0, -3.0, 0.995
SNOW_NODATA, SNOW_SATURATED, SNOW_MIN_VALID = -9999.0, 32767.0, 0.93
FORECAST_NOISE, FORECAST_MISSING_FLOOR, FORECAST_MIN_VALID = 0.1, 9998.0, 0.995

DEALS = 64


def expected(cells: DataFrame, mask: DataFrame, fields: DataFrame | None, grid_size: int | None) -> DataFrame:
    """One row per (field, basin) that must be answered, whatever was delivered.

    ``cell_count`` and ``wsum`` are those of the basin's whole mask; ``outside`` counts mask cells beyond the grid and
    ``surplus`` delivered cells beyond it. Fields are those of ``fields`` or, without a list, those with any cell.
    """
    beyond = lambda c: F.lit(False) if grid_size is None else (F.col(c) < 0) | (F.col(c) >= grid_size)
    basins = mask.groupBy("basin").agg(F.count(F.lit(1)).alias("cell_count"), F.sum("weight").alias("wsum"), F.count_if(beyond("flat_index")).alias("outside"))
    sizes = cells.groupBy("field").agg(F.count_if(beyond("flat_index")).alias("surplus"))
    listed = sizes if fields is None else fields.select("field").distinct().join(sizes, "field", "left").fillna(0, ["surplus"])
    # every basin answers for every field, a row of the result each; fields are dealt so that they meet the basins in many tasks
    dealt = basins.withColumn("_deal", F.explode(F.sequence(F.lit(0), F.lit(DEALS - 1))))
    return listed.withColumn("_deal", F.pmod(F.xxhash64("field"), F.lit(DEALS)).cast("int")).join(dealt, "_deal").drop("_deal")


def measured(cells: DataFrame, mask: DataFrame, aggregates: list[Column], fields: DataFrame | None, grid_size: int | None = None) -> DataFrame:
    """Aggregates over the weighted cells of each expected (field, basin); without a delivered cell they are null.

    A value that is null or NaN is missing: it is read as null, so that no comparison holds for it.
    """
    value = F.col("value").cast("double")
    known = cells.withColumn("value", F.when(~F.isnan(value), value))
    g = known.join(mask, "flat_index").groupBy("field", "basin").agg(*aggregates)
    return expected(cells, mask, fields, grid_size).join(g, ["field", "basin"], "left")


def _weight(cond: Column) -> Column:
    return F.coalesce(F.sum(F.when(cond, F.col("weight"))), F.lit(0.0))


def strict_mean(cells: DataFrame, mask: DataFrame, grid_size: int | None, missing: Column, fields: DataFrame | None = None) -> DataFrame:
    """Mean that refuses whole when any masked cell is missing, null, NaN, absent from the field or outside the grid.

    A field with cells beyond the grid was delivered on another grid. A mask made from the fields' own cells has no
    cell outside and needs no ``grid_size``. A mask whose weights sum to nothing has no mean.
    """
    bad = F.col("value").isNull() | F.coalesce(missing, F.lit(True))
    g = measured(cells, mask, [
        F.count(F.lit(1)).alias("met"), F.count_if(bad).alias("bad"), F.sum(F.when(~bad, F.col("value")) * F.col("weight")).alias("total"),
    ], fields, grid_size)
    g = g.withColumn("missing_cells", F.coalesce("bad", F.lit(0)) + F.col("cell_count") - F.coalesce("met", F.lit(0)))
    reason = (
        F.when(F.col("surplus") > 0, "wrong_grid_size").when(F.col("outside") > 0, "cell_out_of_range")
        .when(~(F.col("wsum") > 0), "empty_weight").when(F.col("missing_cells") > 0, "missing_values")
    )
    mean = F.when(reason.isNull(), F.col("total") / F.col("wsum"))
    return g.select("field", "basin", "cell_count", "missing_cells", mean.alias("value"), F.coalesce(reason, F.lit("ok")).alias("reason"))


def radar_stats(cells: DataFrame, mask: DataFrame, fields: DataFrame | None = None) -> DataFrame:
    """Coverage-tolerant mean: sentinels lower the valid fraction; refused below the floor."""
    v, w = F.col("value"), F.col("weight")
    valid = v >= 0.0
    g = measured(cells, mask, [
        _weight(valid).alias("wvalid"),
        _weight(v == RADAR_NO_COVERAGE).alias("wno"),
        _weight(v == RADAR_MISSING).alias("wmiss"),
        F.sum(F.when(valid, v * w)).alias("total"),
        F.max(F.when(valid, v)).alias("top"),
    ], fields).fillna(0.0, ["wvalid", "wno", "wmiss"])
    frac = F.col("wvalid") / F.col("wsum")
    ok = frac >= RADAR_MIN_VALID
    flags = F.array_compact(F.array(
        F.when(~ok, "insufficient_radar_coverage"), F.when(F.round(F.col("wno") / F.col("wsum"), 6) > 0, "radar_no_coverage_cells"),
        F.when(F.round(F.col("wmiss") / F.col("wsum"), 6) > 0, "missing_cells"),
    ))
    return g.select(
        "field", "basin", "cell_count", F.round(frac, 6).alias("valid_fraction"),
        F.round(F.col("wno") / F.col("wsum"), 6).alias("no_coverage_fraction"), F.round(F.col("wmiss") / F.col("wsum"), 6).alias("missing_fraction"),
        F.when(ok, F.col("total") / F.col("wvalid")).alias("mean"), F.when(ok, F.col("top")).alias("max"), flags.alias("flags"),
    )


def snow_stats(cells: DataFrame, mask: DataFrame, fields: DataFrame | None = None) -> DataFrame:
    """Mean, maximum and snow-covered fraction over valid land cells."""
    v, w = F.col("value"), F.col("weight")
    valid = (v >= 0) & (v != SNOW_SATURATED)
    corrupt = (v < 0) & (v != SNOW_NODATA)
    g = measured(cells, mask, [
        _weight(valid).alias("wvalid"), _weight(v == SNOW_NODATA).alias("wwater"), _weight(v == SNOW_SATURATED).alias("wsat"), _weight(corrupt).alias("wbad"),
        F.sum(F.when(valid, v * w)).alias("total"), F.max(F.when(valid, v)).alias("top"), _weight(valid & (v > 0)).alias("wsnow"),
    ], fields).fillna(0.0, ["wvalid", "wwater", "wsat", "wbad", "wsnow"])
    part = lambda c: F.round(F.col(c) / F.col("wsum"), 6)
    ok = F.col("wvalid") / F.col("wsum") >= SNOW_MIN_VALID
    flags = F.array_compact(F.array(
        F.when(~ok, "insufficient_grid_coverage"), F.when(part("wwater") > 0, "static_water_cells_present"),
        F.when(part("wsat") > 0, "swe_saturated_cells_excluded"), F.when(part("wbad") > 0, "negative_non_sentinel_cells_excluded"),
    ))
    return g.select(
        "field", "basin", "cell_count", part("wvalid").alias("valid_fraction"), part("wwater").alias("water_fraction"),
        part("wsat").alias("saturated_fraction"), part("wbad").alias("corrupt_fraction"),
        F.when(ok, F.col("total") / F.col("wvalid")).alias("mean"), F.when(ok, F.col("top")).alias("max"),
        F.when(ok, F.col("wsnow") / F.col("wvalid")).alias("snow_covered_fraction"), flags.alias("flags"),
    )


def forecast_stats(cells: DataFrame, mask: DataFrame, fields: DataFrame | None = None) -> DataFrame:
    """Precipitation mean with the small negative decoding noise clamped to zero."""
    w = F.col("weight")
    clamped = (F.col("value") < 0) & (F.col("value") >= -FORECAST_NOISE)
    v = F.when(clamped, F.lit(0.0)).otherwise(F.col("value"))
    valid = (v >= 0) & (v < FORECAST_MISSING_FLOOR)
    g = measured(cells, mask, [
        _weight(valid).alias("wvalid"), F.count_if(clamped).alias("negative_clamped_cells"), F.sum(F.when(valid, v * w)).alias("total"), F.max(F.when(valid, v)).alias("top"),
    ], fields).fillna(0.0, ["wvalid"]).fillna(0, ["negative_clamped_cells"])
    frac = F.col("wvalid") / F.col("wsum")
    ok = frac >= FORECAST_MIN_VALID
    missing = F.round(1.0 - F.round(frac, 12), 6)
    flags = F.array_compact(F.array(
        F.when(~ok, "insufficient_grid_coverage"), F.when(missing > 0, "missing_cells"), F.when(F.col("negative_clamped_cells") > 0, "jpeg_negative_clamped")
    ))
    return g.select(
        "field", "basin", "cell_count", F.round(frac, 6).alias("valid_fraction"), missing.alias("missing_fraction"), "negative_clamped_cells",
        F.when(ok, F.col("total") / F.col("wvalid")).alias("mean"), F.when(ok, F.col("top")).alias("max"), flags.alias("flags"),
    )


def overlap(a: DataFrame, b: DataFrame, a_key: str, b_key: str, cell_km2: float, minimum_km2: float) -> DataFrame:
    """Shared area of two coverage tables, by cell: exact up to the grid cell.

    Cell-by-cell the shared part is taken as the smaller of the two weights.
    """
    at = a.groupBy(a_key).agg(F.sum("weight").alias("a_total"))
    bt = b.groupBy(b_key).agg(F.sum("weight").alias("b_total"))
    shared = F.sum(F.least(F.col("wa"), F.col("wb")))
    pairs = (
        a.withColumnRenamed("weight", "wa").join(b.withColumnRenamed("weight", "wb"), "flat_index")
        .groupBy(a_key, b_key).agg(shared.alias("shared")).filter(F.col("shared") * cell_km2 >= minimum_km2)
    )
    return pairs.join(at, a_key).join(bt, b_key).select(
        a_key, b_key, (F.col("shared") * cell_km2).alias("overlap_km2"),
        (F.col("shared") / F.col("a_total")).alias("of_zone"), (F.col("shared") / F.col("b_total")).alias("of_basin"),
    )
