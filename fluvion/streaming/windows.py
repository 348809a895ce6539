"""Event-time aggregates kept current: hourly totals, rates of rise, sustained rises, staleness."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from fluvion.functions.arrays import ESTIMATORS
from fluvion.operators import trend

# Fixed values.
DEGRADED_CADENCES = 4
# part of a checkpoint: another number needs a new one
KEY_GROUPS = 1024


def hourly(stream: DataFrame, scope: str, instant: str, value: str, lateness: str) -> DataFrame:
    """Closed hours per scope; an hour is emitted once the watermark has passed its end."""
    return (
        stream.withWatermark(instant, lateness)
        .groupBy(scope, F.window(instant, "1 hour").alias("w"))
        .agg(F.max(value).alias("value"), F.count(F.lit(1)).alias("n"))
        .select(scope, F.col("w.start").alias("valid_time"), "value", "n")
    )


def rates(stream: DataFrame, scope: str, instant: str, value: str, lateness: str, basis: Column) -> DataFrame:
    """Six-hour rate of rise every 15 minutes.

    The first window reduces the stream to its cadence, so the second holds at most 25 readings
    per scope: those from six hours before its last instant up to and with that instant, the same closed
    window as in `trend.trailing_windows`. The slope is then computed over that array in the row.
    """
    bins = (
        stream.withWatermark(instant, lateness)
        .groupBy(scope, F.window(instant, "15 minutes").alias("bin"))
        .agg(F.max(value).alias("v"))
        .select(scope, F.window_time("bin").alias("t"), F.col("bin.start").alias("at"), "v")
    )
    w = bins.groupBy(scope, F.window("t", "375 minutes", "15 minutes").alias("w")).agg(
        F.sort_array(F.collect_list(F.struct((F.unix_timestamp("at") / 3600.0).alias("x"), F.col("v").alias("y")))).alias("pts")
    )
    first, last = F.element_at("pts", 1), F.element_at("pts", -1)
    gaps = F.transform(F.slice("pts", 2, F.greatest(F.size("pts") - 1, F.lit(0))), lambda q, i: q["x"] - F.get("pts", i)["x"])
    shaped = w.select(
        scope, (F.col("w.end") - F.expr("interval 15 minutes")).alias("window_end"), "pts", F.size("pts").alias("n"), (last["x"] - first["x"]).alias("span_h"),
        F.coalesce(F.array_max(gaps), F.lit(0.0)).alias("max_gap_h"), last["y"].alias("last_v"),
    )
    refusal = trend.window_refusal()
    slope = ESTIMATORS[trend.SHIPPED](F.when(refusal.isNull(), F.col("pts")))
    return shaped.withColumn("slope", slope).select(
        scope, "window_end", "n", "slope", trend.direction(F.col("slope"), trend.steady_epsilon(basis, F.col("last_v"))).alias("direction"),
        F.coalesce(refusal, F.lit("ok")).alias("refusal"),
    )


def sustained_rises(stream: DataFrame, scope: str, gap: str = "16 minutes", minimum_h: float = 2.0, lateness: str = "1 hour") -> DataFrame:
    """Runs of consecutive rising windows, as sessions over the rising rows only."""
    rising = stream.withWatermark("window_end", lateness).filter(F.col("direction") == "rising")
    s = rising.groupBy(scope, F.session_window("window_end", gap).alias("s")).agg(
        F.count(F.lit(1)).alias("n"), F.min("window_end").alias("first_window"), F.max("window_end").alias("last_window")
    )
    span = (F.unix_timestamp("last_window") - F.unix_timestamp("first_window")) / 3600.0
    return s.withColumn("span_h", span).filter(F.col("span_h") >= minimum_h).select(scope, "n", "first_window", "last_window", "span_h")


STALE_OUTPUT = "key string, state string, since timestamp, last_seen timestamp"
STALE_STATE = "key array<string>, last_us array<long>, announced array<int>, timer_ms array<long>"


def staleness(stream: DataFrame, key: str, instant: str, cadence_s: int, grace_s: int, lateness: str) -> DataFrame:
    """Announce a silent key: stale after cadence + grace, degraded after four cadences.

    Event-time timers fire without new data of the key. Keys are dealt into `KEY_GROUPS` groups; a call of Python serves a
    group, whose state holds newest instant, step and timer of each of its keys and whose timer is the first of theirs. Calls are
    thereby bounded by groups and batches, not by keys. The function streams over the batch frames, so a key with many
    rows costs no memory.
    """
    stale_us, degraded_us = (cadence_s + grace_s) * 1_000_000, cadence_s * DEGRADED_CADENCES * 1_000_000
    steps = sorted([("stale", stale_us), ("degraded", degraded_us)], key=lambda s: s[1])

    def follow(group: tuple[Any, ...], frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        watermark = state.getCurrentWatermarkMs()
        known = {k: of for k, *of in zip(*state.get, strict=True)} if state.exists else {}
        newest: dict[str | None, int] = {}
        for f in () if state.hasTimedOut else frames:
            for k, us in f.groupby("key", dropna=False)["us"].max().dropna().astype("int64").items():
                k = k if isinstance(k, str) else None
                newest[k] = max(us, newest.get(k, us))

        def wait(k: str | None, last: int, announced: int) -> None:
            # a timer that is due already fires in a later batch
            timer = max((last + steps[announced][1]) // 1000, watermark + 1) if announced < len(steps) else None
            known[k] = [last, announced, timer]

        # a key with rows in this batch is heard before its timer is looked at
        due = [(k, last, announced) for k, (last, announced, timer) in known.items() if timer is not None and timer < watermark and k not in newest]
        for k, last, announced in due:
            wait(k, last, announced + 1)
        for k, us in newest.items():
            last, announced, _ = known.get(k, (0, 0, None))
            wait(k, *((us, 0) if us > last else (last, announced)))
        if due:
            told = pd.DataFrame([(str(k), steps[n][0], last + steps[n][1], last) for k, last, n in due], columns=["key", "state", "since", "last_seen"])
            yield told.astype({"since": "datetime64[us]", "last_seen": "datetime64[us]"})
        if known:
            state.update(tuple([*column] for column in zip(*([k, *of] for k, of in known.items()), strict=True)))
        if timers := [timer for _, _, timer in known.values() if timer is not None]:
            state.setTimeoutTimestamp(min(timers))

    keyed = stream.withWatermark(instant, lateness).select(F.col(key).cast("string").alias("key"), instant, F.unix_micros(instant).alias("us"))
    grouped = keyed.withColumn("key_group", F.pmod(F.xxhash64("key"), F.lit(KEY_GROUPS)).cast("int"))
    return grouped.groupBy("key_group").applyInPandasWithState(follow, STALE_OUTPUT, STALE_STATE, "append", GroupStateTimeout.EventTimeTimeout)
