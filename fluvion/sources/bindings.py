"""Logical tables bound to the given Parquet tables.

Each method is a lazy DataFrame; the instant columns are cast to UTC timestamps once, here.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from fluvion.functions import clocks

# Official levels used for every variable.
LEVELS = {"action": 50.0, "minor": 100.0, "moderate": 200.0, "major": 400.0}
HOURS = "interval 1 hour"
# forecast values a task sorts and groups
TASK_VALUES = 500_000


def hours(n: Column) -> Column:
    return F.make_dt_interval(F.lit(0), n.cast("int"))


class Tables:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.dir = sf_dir.rstrip("/")

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    def events(self) -> DataFrame:
        return self.read("events").withColumn("ts", F.col("ts").cast("timestamp"))

    def observations(self, numbered: bool = False) -> DataFrame:
        """Hourly gauge readings; several readings of one instant are its revisions, in id order."""
        hour = F.date_trunc("hour", "ts")
        known = hour + hours(F.col("event_id") % 7)
        df = self.events().select(
            F.col("event_id").alias("id"),
            F.col("user_id").alias("station"),
            F.col("event_type").alias("variable"),
            "value",
            hour.alias("valid_time"),
            known.alias("available_at"),
            known.alias("retrieved_at"),
        )
        if numbered:
            w = W.partitionBy("station", "variable", "valid_time").orderBy("id")
            df = df.withColumn("revision_seq", F.row_number().over(w) - 1)
        return df

    @staticmethod
    def with_levels(df: DataFrame) -> DataFrame:
        """The four official levels beside each row (the same at every point)."""
        return df.withColumns({k: F.lit(v) for k, v in LEVELS.items()})

    def dated_levels(self) -> DataFrame:
        """Official levels with a time from which each holds and one at which it became known; a station has several."""
        k, origin = F.col("o_orderkey"), F.timestamp_seconds(F.lit(1704067200))
        kind = F.element_at(F.array(*map(F.lit, LEVELS)), (k % 4).cast("int") + 1)
        base = F.element_at(F.array(*map(F.lit, LEVELS.values())), (k % 4).cast("int") + 1)
        return self.read("orders").select(
            F.col("o_custkey").alias("station"), kind.alias("category"), (base * (F.lit(0.75) + (k % 8) / 16.0)).alias("level"),
            (origin + hours(k % 700)).alias("effective_from"), (origin + hours(k % 700 + k % 48)).alias("known_at"), k.alias("id"),
        )

    def fast_series(self) -> DataFrame:
        """Quarter-hour gauge series: the highest reading of each 15 minutes per station group."""
        t = F.timestamp_seconds(F.floor(F.unix_timestamp("ts") / 900) * 900)
        return (
            self.events()
            .groupBy((F.col("user_id") % 10).alias("station"), t.alias("t"))
            .agg(F.max("value").alias("v"))
        )

    def lineitem(self) -> DataFrame:
        return self.read("lineitem").withColumn("day", F.col("l_shipdate").cast("date"))

    def daily_rows(self, sites: int | None = 10) -> DataFrame:
        """Unfiltered daily-mean record rows, with raw text value and approval."""
        site = F.col("l_suppkey") if sites is None else F.col("l_suppkey") % sites
        return self.lineitem().select(
            site.alias("site"),
            "day",
            F.col("l_quantity").alias("quantity"),
            F.when(F.col("l_linestatus") == "F", F.lit("Approved")).otherwise(F.lit("Provisional")).alias("approval"),
            F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice").alias("file_pos"),
        )

    def daily_means(self, sites: int | None = 10) -> DataFrame:
        """One mean per (site, day): aggregated map-side first, so later windows hold days, not rows."""
        site = F.col("l_suppkey") if sites is None else F.col("l_suppkey") % sites
        return self.lineitem().groupBy(site.alias("site"), "day").agg(F.avg("l_quantity").alias("value"))

    def forecast_runs(self) -> DataFrame:
        issued = F.col("o_orderdate").cast("timestamp")
        return self.read("orders").select(
            F.col("o_orderkey").alias("run_id"),
            F.col("o_custkey").alias("fp"),
            F.col("o_orderpriority").alias("product"),
            issued.alias("issued_at"),
            (issued + hours((F.col("o_orderkey") % 5) * 24)).alias("available_at"),
        )

    def forecast_values(self) -> DataFrame:
        """Hydrograph points keyed by run; the valid time needs the run's issue time (a join)."""
        return self.read("lineitem").select(
            F.col("l_orderkey").alias("run_id"),
            F.col("l_linenumber").alias("lead"),
            F.col("l_partkey").alias("part"),
            (F.col("l_suppkey") % 6).alias("member"),
            F.col("l_extendedprice").alias("flow"),
            F.col("l_quantity").alias("stage"),
        )

    def dealt_values(self) -> DataFrame:
        """Forecast values dealt by run, so many to a task however large the table is; a small table is left to Spark.

        The number of rows comes from the footers of the files. Joins and groups on the run need no other shuffle.
        """
        values = self.forecast_values()
        tasks = -(-self.read("lineitem").count() // TASK_VALUES)
        return values.repartition(tasks, "run_id") if tasks > self.spark.sparkContext.defaultParallelism else values

    def run_values(self, runs: DataFrame | None = None, most: bool = False) -> DataFrame:
        """Values with their run header: one shuffle join on the run key (AQE splits skewed runs).

        With ``runs``, chosen from the headers alone, only their values are joined; ``most`` says that these are most of all.
        """
        return (
            (self.forecast_runs() if runs is None else runs)
            .join(self.dealt_values() if runs is None or most else self.forecast_values(), "run_id")
            .withColumn("valid_time", F.col("issued_at") + hours(F.col("lead") * 6))
        )

    def derived_features(self) -> DataFrame:
        """Daily computed numbers; half of the days carry a 24 h window, the others none."""
        day = F.date_trunc("day", "ts")
        return (
            self.events()
            .groupBy(F.col("event_type").alias("feature"), (F.col("user_id") % 10).alias("scope"), day.alias("valid_time"))
            .agg(F.max("value").alias("value"), F.max("event_id").alias("id"))
            .withColumn("window", F.when(F.dayofmonth("valid_time") % 2 == 0, F.lit("24h")))
            .withColumn("available_at", F.col("valid_time") + hours(F.col("id") % 48))
        )

    def grid_cells(self) -> DataFrame:
        """Cell table of gridded fields, eight columns wide."""
        return self.read("embeddings").select(
            F.col("vec_id").alias("field"), F.col("label").alias("grid_hash"), F.posexplode("embedding").alias("flat_index", "value")
        ).withColumn("value", F.round(F.col("value").cast("double") * 1000).cast("double"))

    def delivered_cells(self) -> DataFrame:
        """Cells as delivered: every ninth field lacks its last four."""
        return self.grid_cells().filter(~((F.col("field") % 9 == 0) & (F.col("flat_index") >= 60)))

    def mask(self, basins: int = 6) -> DataFrame:
        """Sparse weights of six basins on the grid that the fields' own cells make up, whatever its size."""
        cells = self.grid_cells().select("flat_index").distinct()
        weight = ((F.col("flat_index") * 7 + F.col("basin")) % 10) / 10.0
        return (
            cells.select(F.explode(F.sequence(F.lit(0), F.lit(basins - 1))).alias("basin"), "flat_index")
            .withColumn("weight", weight)
            .filter("weight > 0")
        )

    def alerts(self) -> DataFrame:
        """Alert messages; each names the previous turn of its conversation as superseded."""
        sent = F.timestamp_seconds(F.lit(1704067200) + F.col("conv_id") * 3600 + F.col("turn") * 1800)
        return self.read("conversations").select(
            F.concat_ws("-", F.lit("alert"), "conv_id", "turn").alias("alert_id"),
            F.col("conv_id"),
            F.col("turn"),
            sent.alias("sent"),
            (sent + hours(F.col("turn"))).alias("available_at"),
            F.when(F.col("turn") % 3 != 0, sent + hours(F.lit(24 * 10))).alias("ends"),
            F.when(F.col("turn") % 2 == 0, sent + hours(F.lit(24 * 20))).alias("expires"),
            F.when(F.col("role") == "system", F.lit("Test")).otherwise(F.lit("Actual")).alias("status"),
            F.when(F.col("turn") == 5, F.lit("Cancel")).otherwise(F.lit("Alert")).alias("message_type"),
            F.when((F.col("turn") > 0) & (F.col("turn") % 2 == 1), F.array(F.concat_ws("-", F.lit("alert"), "conv_id", F.col("turn") - 1)))
            .otherwise(F.array().cast("array<string>"))
            .alias("references"),
            F.array(
                F.format_string("WAC%03d", (F.col("conv_id") % 25).cast("int")),
                F.format_string("WAC%03d", (F.col("turn") * 3 % 25).cast("int")),
            ).alias("ugc"),
        )

    def basins(self) -> DataFrame:
        return self.read("nation").select(
            F.col("n_nationkey").alias("basin"), F.col("n_name").alias("basin_name"), F.col("n_regionkey").alias("source")
        )

    def sources(self) -> DataFrame:
        return self.read("region").select(F.col("r_regionkey").alias("source"), F.col("r_name").alias("kind"))

    def stations(self) -> DataFrame:
        return self.read("supplier").select(
            F.col("s_suppkey").alias("station"), F.col("s_name").alias("station_name"), F.col("s_nationkey").alias("basin"), F.col("s_acctbal").alias("elevation")
        )

    def points(self) -> DataFrame:
        return self.read("customer").select(
            F.col("c_custkey").alias("fp"), F.col("c_name").alias("fp_name"), F.col("c_nationkey").alias("basin"), F.col("c_mktsegment").alias("segment")
        )

    def job_runs(self) -> DataFrame:
        return self.events().select(
            F.col("event_id").alias("run_id"), F.col("event_type").alias("job"), F.col("ts").alias("started_at"), (F.col("value") > 10).alias("ok")
        )

    def daily_key(self, df: DataFrame) -> DataFrame:
        return df.withColumn("doy", clocks.doy_index(F.col("day"))).withColumn("wy", clocks.water_year(F.col("day")))
