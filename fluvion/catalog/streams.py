"""Streaming jobs, fed by the events table landed in arrival order."""

import uuid

from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from fluvion.catalog.registry import BINDINGS, query
from fluvion.functions import flood
from fluvion.operators import precipitation
from fluvion.session import shared_dir
from fluvion.sources.bindings import Tables, hours
from fluvion.streaming import ingest, repair, windows

SLICES, FILES = 5, 4
# readings of a station are most of an hour apart
RISE_GAP_S = 7200


BINDINGS["b_land"] = f"""SELECT *, CAST(least((epoch_us(available_at) - lo) // ((hi - lo) // {SLICES} + 1), {SLICES - 1}) AS INTEGER) AS slice
  FROM (SELECT *, ts + to_hours(CAST(event_id % 7 AS INTEGER)) AS available_at FROM events), (SELECT min(epoch_us(ts + to_hours(CAST(event_id % 7 AS INTEGER)))) AS lo, max(epoch_us(ts + to_hours(CAST(event_id % 7 AS INTEGER)))) AS hi FROM events)"""


class Run:
    """Folders of one run, below the shared directory."""

    def __init__(self, t, name):
        self.t = t
        self.root = f"{shared_dir(t.spark)}/{name}-{uuid.uuid4().hex}"

    def __getitem__(self, part):
        return f"{self.root}/{part}"

    def land(self):
        """The whole events table as files in arrival order (arrival is up to six hours late)."""
        arrival = F.col("ts") + hours(F.col("event_id") % 7)
        e = self.t.events().withColumn("available_at", arrival)
        # slices cover the arrivals from the first to the last, whenever they are
        first, last = e.agg(F.unix_micros(F.min("available_at")), F.unix_micros(F.max("available_at"))).first()
        width = (((last or 0) - (first or 0)) // SLICES + 1)
        part = F.least(F.floor((F.unix_micros("available_at") - F.lit(first or 0)) / F.lit(width)), F.lit(SLICES - 1))
        # divided in one pass; each slice then lands from its own folder
        e.withColumn("slice", part).write.partitionBy("slice").parquet(self["slices"])
        divided = self.t.spark.read.schema(StructType([*e.schema.fields, StructField("slice", IntegerType())])).parquet(self["slices"])
        for i in range(SLICES):
            divided.filter(F.col("slice") == i).drop("slice").repartition(FILES).write.mode("append").parquet(self["landing"])
        return ingest.open_stream(self.t.spark, self["landing"], e.schema, FILES)

    def read(self, part):
        return self.t.spark.read.parquet(self[part])


@query(
    "J1_continuous_ingest",
    """SELECT event_type, user_id AS station, CAST(date_trunc('hour', ts) AS VARCHAR) AS valid_time, min(event_id) AS id FROM events GROUP BY event_type, user_id, date_trunc('hour', ts)""",
)
def j1(t):
    """Every key is appended once, whatever batch it comes in."""
    run = Run(t, "ingest")
    s = run.land().select("event_type", F.col("user_id").alias("station"), F.date_trunc("hour", "ts").alias("valid_time"), F.col("event_id").alias("id"))
    ingest.run_available(s, run["checkpoint"], ingest.append_absent(run["out"], ["event_type", "station", "valid_time"], ["id"], "valid_time"))
    out = run.read("out")
    return out.groupBy("event_type", "station", "valid_time").agg(F.min("id").alias("id"))


@query(
    "J2_streaming_revisions",
    """WITH a AS (SELECT user_id % 10 AS station, event_type AS variable, CAST(ts AS DATE) AS day, event_id AS id, CAST(floor(value / 40) AS INTEGER) AS state, slice FROM b_land),
      c AS (SELECT *, lag(state) OVER (PARTITION BY station, variable, day ORDER BY slice, id) IS DISTINCT FROM state AS changed FROM a)
      SELECT station, variable, CAST(day AS VARCHAR) AS day, id, state, CAST(row_number() OVER w - 1 AS INTEGER) AS revision_seq, lag(id) OVER w AS revises FROM c WHERE changed WINDOW w AS (PARTITION BY station, variable, day ORDER BY slice, id)""",
)
def j2(t):
    """Revisions of (station, variable, day): only changes are written, numbered across batches."""
    run = Run(t, "revisions")
    s = run.land().select(
        (F.col("user_id") % 10).alias("station"), F.col("event_type").alias("variable"), F.to_date("ts").alias("day"), F.col("event_id").alias("id"), F.floor(F.col("value") / 40).cast("int").alias("state")
    )
    ingest.run_available(s, run["checkpoint"], ingest.append_revisions(run["out"], ["station", "variable", "day"], ["state"], "day"))
    return run.read("out").select("station", "variable", "day", "id", "state", "revision_seq", "revises")


@query(
    "J3_lateness",
    """SELECT user_id AS station, count(*) AS n, count_if(event_id % 7 > 3) AS n_late, CAST(max(event_id % 7) AS DOUBLE) AS worst_h FROM events GROUP BY ALL""",
)
def j3(t):
    run = Run(t, "lateness")
    s = ingest.with_lateness(run.land().withColumnRenamed("ts", "valid_time")).select(F.col("user_id").alias("station"), "event_id", "lateness_h")
    ingest.run_to_table(s, run["checkpoint"], run["out"])
    return run.read("out").groupBy("station").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("lateness_h") > 3).alias("n_late"), F.max("lateness_h").alias("worst_h")
    )


@query(
    "J4_change_events",
    """WITH s AS (SELECT event_type || '.' || user_id AS product, slice, max(ts) AS t FROM b_land GROUP BY ALL), p AS (SELECT *, max(t) OVER (PARTITION BY product ORDER BY slice ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM s)
      SELECT product, CAST(t AS VARCHAR) AS content_time, CAST(before AS VARCHAR) AS previous, slice AS batch FROM p WHERE slice > 0 AND (before IS NULL OR t > before)""",
)
def j4(t):
    """Products whose newest content moved between looks; the first look primes silently."""
    run = Run(t, "changes")
    s = run.land().select(F.concat_ws(".", "event_type", F.col("user_id")).alias("product"), "ts")
    ingest.run_available(s, run["checkpoint"], ingest.change_events(run["anchors"], run["out"], "product", "ts"))
    return run.read("out").select("product", "content_time", "previous", "batch")


def quarter_rates(t, run, minimum_h=None):
    """The repaired rates of rise of all stations; arrivals may be late by any time."""
    table = repair.Rates(t.spark, run["state"], "station", gap_s=RISE_GAP_S)
    s = run.land().withColumn("station", F.col("user_id") % 10)
    ingest.run_available(s, run["checkpoint"], table.writer("ts", "value", F.lit("flow"), minimum_h))
    return table


RATE_SQL = """SELECT w.station, w.t, CAST(w.n AS INTEGER) AS n, slope, CASE WHEN w.n < 3 THEN 'INSUFFICIENT_OBSERVATIONS' WHEN w.max_gap_h > 2 THEN 'GAP_EXCEEDS_TOLERANCE' WHEN w.span_h < 3 THEN 'SPAN_BELOW_MINIMUM' ELSE 'ok' END AS refusal,
  CASE WHEN slope IS NULL THEN 'unknown' WHEN abs(slope) <= greatest(1.0, abs(w.last_v) * 0.01::DOUBLE) THEN 'steady' WHEN slope > 0 THEN 'rising' ELSE 'falling' END AS direction FROM b_w w LEFT JOIN b_rm r USING (station, t)"""


@query(
    "J5_streaming_trailing_totals",
    """WITH h AS (SELECT user_id % 6 AS basin, date_trunc('hour', ts) AS valid_time, max(value) AS value FROM events GROUP BY ALL), a AS (SELECT basin, max(valid_time) AS window_end FROM h GROUP BY ALL)
      SELECT basin, CAST(window_end AS VARCHAR) AS window_end, w AS window_h, round(sum(value), 3) AS total, CAST(count(value) AS INTEGER) AS hours_present FROM h JOIN a USING (basin), (VALUES (6), (24), (72)) AS x(w) WHERE valid_time > window_end - to_hours(w) GROUP BY basin, window_end, w""",
)
def j5(t):
    """Hours are kept current, late readings included; totals over them say how many hours exist."""
    run = Run(t, "totals")
    s = run.land().withColumn("basin", F.col("user_id") % 6)
    table = repair.hours_table(t.spark, run["hours"], "basin")
    ingest.run_available(s, run["checkpoint"], repair.hourly(table, "basin", "ts", "value"))
    return precipitation.trailing_totals(table.current(table.latest()), "basin").select("basin", "window_end", "window_h", "total", "hours_present")


@query(
    "J5_closed_hours",
    """SELECT user_id % 6 AS basin, CAST(date_trunc('hour', ts) AS VARCHAR) AS valid_time, max(value) AS value, count(*) AS n FROM events WHERE date_trunc('hour', ts) + INTERVAL 1 HOUR <= (SELECT date_trunc('second', max(ts)) FROM events) - INTERVAL 7 HOUR GROUP BY ALL""",
)
def j5_closed(t):
    """Append-only hours, each emitted once when the watermark has passed its end; rows behind it are counted."""
    run = Run(t, "closed")
    s = run.land().withColumn("basin", F.col("user_id") % 6)
    ingest.run_to_table(windows.hourly(s, "basin", "ts", "value", "7 hours"), run["checkpoint"], run["out"])
    return run.read("out")


@query("J6_streaming_rates", f"SELECT station, CAST(t AS VARCHAR) AS window_end, n, round(slope, 6) AS slope, direction, refusal FROM ({RATE_SQL})")
def j6(t):
    """Rates of rise per quarter hour; a late reading corrects every window it belongs to."""
    table = quarter_rates(t, Run(t, "rates"))
    return table.rates.current(table.rates.latest())


@query("J6_closed_rates")
def j6_closed(t):
    """Append-only rates by windows of the stream itself, emitted behind the watermark."""
    run = Run(t, "closed-rates")
    s = run.land().withColumn("station", F.col("user_id") % 10)
    ingest.run_to_table(windows.rates(s, "station", "ts", "value", "7 hours", F.lit("flow")), run["checkpoint"], run["rates"])
    return run.read("rates")


RISE_SQL = f"""WITH r AS ({RATE_SQL}), u AS (SELECT station, t, CASE WHEN epoch(t) - epoch(lag(t) OVER w) <= {RISE_GAP_S} THEN 0 ELSE 1 END AS new FROM r WHERE direction = 'rising' WINDOW w AS (PARTITION BY station ORDER BY t)),
  g AS (SELECT *, sum(new) OVER (PARTITION BY station ORDER BY t) AS run FROM u), s AS (SELECT station, run, count(*) AS n, min(t) AS first_window, max(t) AS last_window FROM g GROUP BY ALL), e AS (SELECT station, max(t) AS newest FROM r GROUP BY ALL)
  SELECT station, n, CAST(first_window AS VARCHAR) AS first_window, CAST(last_window AS VARCHAR) AS last_window, round((epoch(last_window) - epoch(first_window)) / 3600.0::DOUBLE, 6) AS span_h, CASE WHEN newest > last_window THEN 'closed' ELSE 'open' END AS status
  FROM s JOIN e USING (station) WHERE epoch(last_window) - epoch(first_window) >= 7200"""


@query("J7_sustained_rises", RISE_SQL)
def j7(t):
    """Rises of two hours or more, kept across batches: open while nothing later is known, closed then."""
    rises = quarter_rates(t, Run(t, "rises"), 2.0).rises
    return rises.current(rises.latest()).filter(repair.span_h() >= 2.0).select("station", "n", "first_window", "last_window", repair.span_h().alias("span_h"), "status")


@query("J7_closed_rises")
def j7_closed(t):
    """A second stream over a table of closed rates: sessions of rising windows, emitted behind the watermark."""
    run = Run(t, "closed-rises")
    s = run.land().withColumn("station", F.col("user_id") % 10)
    ingest.run_to_table(windows.rates(s, "station", "ts", "value", "7 hours", F.lit("flow")), run["checkpoint"], run["rates"])
    rises = windows.sustained_rises(ingest.open_stream(t.spark, run["rates"], run.read("rates").schema), "station")
    ingest.run_to_table(rises, run["checkpoint2"], run["out"])
    return run.read("out")


@query("J8_staleness_timers")
def j8(t):
    """Stations that fell silent, announced by event-time timers."""
    run = Run(t, "stale")
    s = run.land().withColumnRenamed("user_id", "station")
    ingest.run_to_table(windows.staleness(s, "station", "ts", 12 * 3600, 6 * 3600, "7 hours"), run["checkpoint"], run["out"])
    return run.read("out")


@query(
    "J8_silences",
    """WITH g AS (SELECT user_id AS station, ts AS last_seen, lead(ts) OVER (PARTITION BY user_id ORDER BY ts) AS next_seen FROM (SELECT DISTINCT user_id, ts FROM events))
      SELECT station, state, CAST(last_seen + to_hours(h) AS VARCHAR) AS since, CAST(last_seen AS VARCHAR) AS last_seen FROM g, (VALUES ('stale', 18), ('degraded', 48)) AS x(state, h) WHERE last_seen + to_hours(h) <= (SELECT max(ts) FROM events) AND (next_seen IS NULL OR last_seen + to_hours(h) < next_seen)""",
)
def j8_silences(t):
    """The announcements that stand once late readings are in: a reading takes away those it contradicts."""
    run = Run(t, "silences")
    s = run.land().withColumnRenamed("user_id", "station")
    table = repair.Silences(t.spark, run["state"], "station", 18 * 3600)
    ingest.run_available(s, run["checkpoint"], table.writer("ts"))
    version = table.gaps.latest()
    now = table.gaps.current(version).agg(F.max("last_seen")).first()[0]
    return table.announced(version, {"stale": 18 * 3600, "degraded": 48 * 3600}, F.lit(now).cast("timestamp"))


@query(
    "J9_stream_static_join",
    """SELECT s_nationkey AS basin, CASE WHEN value >= 400 THEN 'major' WHEN value >= 200 THEN 'moderate' WHEN value >= 100 THEN 'minor' WHEN value >= 50 THEN 'action' ELSE 'none' END AS category, count(*) AS n FROM events JOIN supplier ON s_suppkey = user_id GROUP BY ALL""",
)
def j9(t):
    run = Run(t, "static")
    s = Tables.with_levels(run.land().withColumnRenamed("user_id", "station")).join(t.stations().select("station", "basin"), "station")
    s = s.select("basin", flood.category(F.col("value"), flood.level_columns()).alias("category"))
    ingest.run_to_table(s, run["checkpoint"], run["out"])
    return run.read("out").groupBy("basin", "category").agg(F.count(F.lit(1)).alias("n"))


@query(
    "J9_dated_levels",
    """WITH e AS (SELECT event_id, user_id AS station, value, ts AS valid_time, ts + to_hours(CAST(event_id % 7 AS INTEGER)) AS available_at FROM events),
      l AS (SELECT e.event_id, category, arg_max(level, (effective_from, known_at, id)) AS level FROM e JOIN b_dated d ON d.station = e.station AND effective_from <= valid_time AND known_at <= available_at GROUP BY ALL),
      p AS (SELECT e.station, e.event_id, any_value(value) AS v, max(CASE WHEN category = 'action' THEN level END) AS a, max(CASE WHEN category = 'minor' THEN level END) AS b, max(CASE WHEN category = 'moderate' THEN level END) AS c, max(CASE WHEN category = 'major' THEN level END) AS d FROM e LEFT JOIN l USING (event_id) GROUP BY ALL)
      SELECT station, CASE WHEN a IS NULL AND b IS NULL AND c IS NULL AND d IS NULL THEN 'unknown' WHEN v >= d THEN 'major' WHEN v >= c THEN 'moderate' WHEN v >= b THEN 'minor' WHEN v >= a THEN 'action' ELSE 'none' END AS category, count(*) AS n FROM p GROUP BY ALL""",
)
def j9_dated(t):
    """Readings beside the levels valid and known when they came; the levels are read anew in every batch."""
    run = Run(t, "dated")
    s = run.land().select("event_id", F.col("user_id").alias("station"), "value", F.col("ts").alias("valid_time"), "available_at")

    def judged(batch, levels):
        rows = ingest.as_of(batch, levels, "station", "event_id", "category", "level", flood.CATEGORIES)
        return rows.select("event_id", "station", flood.category(F.col("value"), flood.level_columns()).alias("category"))

    ingest.run_available(s, run["checkpoint"], ingest.beside_dimension(run["out"], t.dated_levels, judged))
    return run.read("out").groupBy("station", "category").agg(F.count(F.lit(1)).alias("n"))


@query(
    "J10_replayed_knowledge",
    """SELECT user_id AS station, CAST(max(ts) AS VARCHAR) AS ts, arg_max(event_id, (ts, event_id)) AS event_id, arg_max(value, (ts, event_id)) AS value FROM events GROUP BY ALL""",
)
def j10(t):
    """The archive replayed in knowledge order; the last version equals the batch answer."""
    run = Run(t, "replay")
    s = run.land().withColumnRenamed("user_id", "station")
    table = ingest.snapshot_table(t.spark, run["out"], "station long, ts timestamp, event_id long, value double", "station")
    ingest.run_available(s, run["checkpoint"], ingest.snapshots(table, "station", ["ts", "event_id"]))
    return table.current(table.latest())
