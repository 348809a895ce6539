"""Alert routing."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def route(alerts: DataFrame, zones: DataFrame) -> DataFrame:
    """Basins each alert touches through its zone codes: distinct, sorted, possibly none."""
    by_zone = alerts.select("alert_id", F.explode_outer("ugc").alias("zone"))
    return (
        by_zone.join(zones, "zone", "left")
        .groupBy("alert_id")
        .agg(F.sort_array(F.collect_set("basin")).alias("basins"))
    )
