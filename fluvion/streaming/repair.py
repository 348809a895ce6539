"""Event-time results that late data corrects: hours, rates of rise, sustained rises, silences.

Each micro-batch finds what its rows touch, computes that anew from stored state, and upserts the corrected rows. No
watermark drops anything: however late a row comes, the table after the last batch equals the batch operator over all
rows. The work of a batch goes with the windows its own rows lie in, not with the archive.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from fluvion.functions.arrays import ESTIMATORS
from fluvion.operators import trend
from fluvion.operators.revisions import beside, matching
from fluvion.streaming.ingest import held, write_batch
from fluvion.streaming.state import KeyedTable

QUARTER_S = 900
#: rising windows further apart than this are two rises
RISE_GAP_S = 16 * 60


def merged(new: DataFrame, stored: DataFrame, keys: list[str], value: str, count: str | None = None) -> DataFrame:
    """Partial maxima (and counts) of a batch with those stored: the rows that change."""
    before = stored.select(*[F.col(k).alias(f"_h_{k}") for k in keys], F.col(value).alias("_v"), *([F.col(count).alias("_n")] if count else []), F.lit(True).alias("_had"))
    both = new.join(before, [F.col(k).eqNullSafe(F.col(f"_h_{k}")) for k in keys], "left")
    out = both.withColumn("_new", F.greatest(value, "_v"))
    if count:
        return out.select(*keys, F.col("_new").alias(value), (F.col(count) + F.coalesce("_n", F.lit(0))).alias(count))
    return out.filter(F.col("_had").isNull() | ~F.col("_new").eqNullSafe(F.col("_v"))).select(*keys, F.col("_new").alias(value))


def hours_table(spark: SparkSession, path: str, scope: str, kind: str = "long") -> KeyedTable:
    return KeyedTable(spark, path, f"{scope} {kind}, valid_time timestamp, value double, n long", [scope, "valid_time"], "valid_time")


def hourly(table: KeyedTable, scope: str, instant: str, value: str) -> Callable[[DataFrame, int], None]:
    """Batch writer: highest value and number of readings of each hour a batch has readings of."""

    @held
    def each(batch: DataFrame, batch_id: int) -> None:
        new = batch.groupBy(scope, F.date_trunc("hour", instant).alias("valid_time")).agg(F.max(value).alias("value"), F.count(F.lit(1)).alias("n"))
        table.commit(merged(new, table.lookup(new, batch_id - 1), [scope, "valid_time"], "value", "n"), batch_id)

    return each


def rated(windows: DataFrame, scope: str, basis: Column) -> DataFrame:
    """(scope, window_end, n, slope, direction, refusal) of trailing windows, each reading one."""
    refusal = trend.window_refusal()
    slope = ESTIMATORS[trend.SHIPPED](F.when(refusal.isNull(), F.col("pts")))
    return windows.withColumn("slope", slope).select(
        scope, F.col("t").alias("window_end"), F.col("n").cast("int").alias("n"), "slope",
        trend.direction(F.col("slope"), trend.steady_epsilon(basis, F.col("last_v"))).alias("direction"), F.coalesce(refusal, F.lit("ok")).alias("refusal"),
    )


class Rates:
    """Six-hour rates of rise at every quarter hour with a reading, and the rises they make up.

    ``bins`` holds the highest reading of each quarter hour, ``rates`` a row per window, ``rises`` a row per rise with its
    status: ``open`` while no later window of its scope is known, ``closed`` from then on.
    """

    def __init__(self, spark: SparkSession, path: str, scope: str, kind: str = "long", gap_s: int = RISE_GAP_S):
        self.scope, self.path, self.gap_s = scope, path, gap_s
        at = f"{scope} {kind}"
        self.bins = KeyedTable(spark, f"{path}/bins", f"{at}, t timestamp, v double", [scope, "t"], "t")
        self.rates = KeyedTable(spark, f"{path}/rates", f"{at}, window_end timestamp, n int, slope double, direction string, refusal string", [scope, "window_end"], "window_end")
        self.rises = KeyedTable(spark, f"{path}/rises", f"{at}, first_window timestamp, last_window timestamp, n long, status string", [scope, "first_window"], places=[scope])

    def upsert(self, new: DataFrame, batch_id: int, basis: Column) -> DataFrame:
        """Bins of a batch (scope, t, v) into the tables; returns the rates that were written."""
        scope, window_s = self.scope, int(trend.WINDOW_H * 3600)
        bins, sec = self.bins, F.unix_timestamp("t")
        changed = merged(new, bins.lookup(new, batch_id - 1), [scope, "t"], "v")
        bins.commit(changed, batch_id)
        # a reading reaches the windows up to six hours after it, which reach six hours back
        changed = bins.written(batch_id).select(scope, "t")
        reach = changed.select(scope, F.explode(F.sequence(F.floor((sec - window_s) / window_s), F.floor((sec + window_s) / window_s))).alias("_part")).distinct()
        hours = f"{trend.WINDOW_H:g} hours"
        near = bins.current(batch_id, bins.touched(changed, hours, f"-{hours}"))
        series = matching(near.withColumn("_part", F.floor(sec / window_s)), reach, [scope, "_part"], "left_semi").drop("_part")
        ends = changed.select(scope, F.explode(F.sequence(sec, sec + window_s, F.lit(QUARTER_S))).alias("_s")).distinct().select(scope, F.timestamp_seconds("_s").alias("t"))
        windows = matching(trend.trailing_windows(series, scope), ends, [scope, "t"], "left_semi")
        self.rates.commit(rated(windows, scope, basis), batch_id)
        return self.rates.written(batch_id)

    def writer(self, instant: str, value: str, basis: Column, minimum_h: float | None = None) -> Callable[[DataFrame, int], None]:
        """Batch writer; with ``minimum_h`` also of rises, whose changes of status go to ``<path>/told``."""

        @held
        def each(batch: DataFrame, batch_id: int) -> None:
            t = F.timestamp_seconds(F.floor(F.unix_timestamp(instant) / QUARTER_S) * QUARTER_S)
            new = batch.groupBy(self.scope, t.alias("t")).agg(F.max(value).alias("v"))
            rates = self.upsert(new, batch_id, basis)
            if minimum_h is not None:
                self.follow(rates, batch_id, minimum_h)

        return each

    def follow(self, changed: DataFrame, batch_id: int, minimum_h: float) -> None:
        """Rises around changed windows made anew, and what there is to tell of them."""
        scope, rises = self.scope, self.rises
        changed = changed.select(scope, "window_end")
        # a rise can be touched up to one gap before and after; the last of a scope can be closed by any later window
        stored = rises.current(batch_id - 1, rises.touched(changed))
        day = lambda c: F.floor(c / 86400)
        sec = F.unix_timestamp("window_end")
        near = F.unix_timestamp("first_window") - self.gap_s, F.unix_timestamp("last_window") + self.gap_s
        spread = stored.withColumn("_day", F.explode(F.sequence(day(near[0]), day(near[1]))))
        at = changed.select(F.col(scope).alias("_scope"), day(sec).alias("_at"), sec.alias("_s"))
        touched = spread.join(at, F.col(scope).eqNullSafe(F.col("_scope")) & (F.col("_day") == F.col("_at")) & F.col("_s").between(*near), "left_semi").drop("_day")
        scopes = changed.select(scope).distinct()
        waiting = matching(stored.filter("status = 'open'"), scopes, [scope], "left_semi")
        old = touched.unionByName(waiting).distinct().persist()
        # rising windows of the touched rises, and the changed ones that rise now
        within = old.select(scope, F.explode(F.sequence(F.unix_timestamp("first_window"), F.unix_timestamp("last_window"), F.lit(QUARTER_S))).alias("_s"))
        wanted = within.union(changed.select(scope, sec)).distinct().select(scope, F.timestamp_seconds("_s").alias("window_end"))
        new = islands(self.rates.lookup(wanted, batch_id).filter("direction = 'rising'"), scope, self.gap_s)
        new = beside(new, self.newest(changed, batch_id), [scope])
        status = F.when(F.col("newest") > F.col("last_window"), "closed").otherwise("open")
        new = new.select(scope, "first_window", "last_window", "n", status.alias("status")).persist()
        rises.commit(matching(new, old, [*rises.keys, *rises.values], "left_anti"), batch_id, matching(old, new, rises.keys, "left_anti"))
        write_batch(told(old, new, scope, minimum_h), f"{self.path}/told", batch_id)
        for kept in (old, new):
            kept.unpersist()

    def newest(self, changed: DataFrame, batch_id: int) -> DataFrame:
        """(scope, newest): the newest window of each scope of a batch, kept as a small table of its own."""
        scope = self.scope
        kind = changed.schema[scope].dataType.simpleString()
        clock = KeyedTable(changed.sparkSession, f"{self.path}/clock", f"{scope} {kind}, newest timestamp", [scope])
        seen = changed.groupBy(scope).agg(F.max("window_end").alias("newest"))
        clock.commit(merged(seen, clock.lookup(seen, batch_id - 1), [scope], "newest"), batch_id)
        return clock.lookup(seen, batch_id)


def islands(rising: DataFrame, scope: str, gap_s: int = RISE_GAP_S) -> DataFrame:
    """(scope, first_window, last_window, n): runs of rising windows no further apart than the gap."""
    w = W.partitionBy(scope).orderBy("window_end")
    gap = F.unix_timestamp("window_end") - F.unix_timestamp(F.lag("window_end").over(w))
    marked = rising.withColumn("_new", F.when(gap <= gap_s, 0).otherwise(1)).withColumn("_run", F.sum("_new").over(w))
    return marked.groupBy(scope, "_run").agg(F.min("window_end").alias("first_window"), F.max("window_end").alias("last_window"), F.count(F.lit(1)).alias("n")).drop("_run")


def span_h(first: str = "first_window", last: str = "last_window") -> Column:
    return (F.unix_timestamp(last) - F.unix_timestamp(first)) / 3600.0


def told(old: DataFrame, new: DataFrame, scope: str, minimum_h: float) -> DataFrame:
    """What changes hands: a rise of the minimum span is told once when open, once when closed, and withdrawn if corrected away."""
    shape = lambda df, p: df.filter(span_h() >= minimum_h).select(F.col(scope).alias(f"{p}_scope"), F.col("first_window").alias(f"{p}_first"), F.col("last_window").alias(f"{p}_last"), F.col("status").alias(f"{p}_status"))
    a, b = shape(old, "o"), shape(new, "n")
    both = a.join(b, a["o_scope"].eqNullSafe(b["n_scope"]) & (a["o_first"] == b["n_first"]), "full")
    moved = both.filter(~F.col("o_status").eqNullSafe(F.col("n_status")))
    return moved.select(
        F.coalesce("n_scope", "o_scope").alias(scope), F.coalesce("n_first", "o_first").alias("first_window"), F.coalesce("n_last", "o_last").alias("last_window"),
        F.coalesce("n_status", F.lit("withdrawn")).alias("status"),
    )


class Silences:
    """Stretches without readings longer than the first announcement, and the last reading of each key.

    The state of a key is its long gaps with the open one after its last reading; a row that comes late splits the gap it
    falls into, or takes it away. Readings closer together than the limit leave no trace.
    """

    def __init__(self, spark: SparkSession, path: str, key: str, after_s: int, kind: str = "long"):
        self.key, self.after_s = key, after_s
        self.gaps = KeyedTable(spark, f"{path}/gaps", f"{key} {kind}, last_seen timestamp, next_seen timestamp", [key, "last_seen"], places=[key])

    def writer(self, instant: str) -> Callable[[DataFrame, int], None]:
        key, gaps = self.key, self.gaps

        @held
        def each(batch: DataFrame, batch_id: int) -> None:
            limit_us = self.after_s * 1_000_000
            us = F.unix_micros(instant)
            # inside a stretch as long as the limit only the first and the last reading can bound a gap
            ends = batch.filter(F.col(instant).isNotNull()).groupBy(key, F.floor(us / limit_us).alias("_p")).agg(F.min(instant).alias("a"), F.max(instant).alias("b"))
            seen = ends.select(key, F.explode(F.array("a", "b")).alias("t")).distinct()
            keys = seen.select(key).distinct()
            stored = matching(gaps.current(batch_id - 1, gaps.touched(keys)), keys, [key], "left_semi").persist()
            gap = stored.filter("last_seen IS NOT NULL")
            # +1 where a stored gap opens, -1 where it ends; a row without a last reading names the first one
            marks = gap.select(key, F.col("last_seen").alias("t"), F.lit(1).alias("_step")).union(gap.filter("next_seen IS NOT NULL").select(key, "next_seen", F.lit(-1)))
            firsts = stored.filter("last_seen IS NULL").select(key, "next_seen", F.lit(0))
            at = marks.union(firsts).withColumn("_known", F.lit(True)).union(seen.select(key, "t", F.lit(0), F.lit(False)))
            at = at.groupBy(key, "t").agg(F.sum("_step").alias("_step"), F.max("_known").alias("_known"))
            w = W.partitionBy(key).orderBy("t")
            first = F.min(F.when(F.col("_known"), F.col("t"))).over(W.partitionBy(key))
            placed = at.withColumns({"_in": F.sum("_step").over(w), "_first": first, "_next": F.lead("t").over(w)})
            # inside a stored gap or before the first reading; elsewhere stored neighbours are nearer than the limit
            open_here = (F.col("_in") > 0) | F.col("_first").isNull() | (F.col("t") < F.col("_first"))
            wide = F.col("_next").isNull() | (F.unix_micros("_next") - F.unix_micros("t") > limit_us)
            new = placed.filter(open_here & wide).select(key, F.col("t").alias("last_seen"), F.col("_next").alias("next_seen"))
            bounds = at.groupBy(key).agg(F.min("t").alias("next_seen")).select(key, F.lit(None).cast("timestamp").alias("last_seen"), "next_seen")
            new = new.unionByName(bounds).persist()
            gaps.commit(matching(new, stored, [key, "last_seen", "next_seen"], "left_anti"), batch_id, matching(stored, new, [key, "last_seen"], "left_anti"))
            for kept in (stored, new):
                kept.unpersist()

        return each

    def announced(self, version: int, steps: dict[str, int], now: Column) -> DataFrame:
        """(key, state, since, last_seen): every announcement that was due by ``now`` and not overtaken by a reading."""
        rows = self.gaps.current(version).filter("last_seen IS NOT NULL")
        each = F.explode(F.array(*[F.struct(F.lit(s).alias("state"), (F.col("last_seen") + F.make_dt_interval(secs=F.lit(n))).alias("since")) for s, n in steps.items()]))
        due = rows.withColumn("_a", each).select(self.key, "_a.state", "_a.since", "last_seen", "next_seen")
        return due.filter((F.col("since") <= now) & (F.col("next_seen").isNull() | (F.col("since") < F.col("next_seen")))).drop("next_seen")
