"""Replay of evaluations over a grid of knowledge times."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from fluvion.functions.clocks import hours_between, plus_hours
from fluvion.operators import trend
from fluvion.operators.sinks import MAX_FILE_RECORDS


def projection_state(families: Sequence[tuple[str, DataFrame, str]]) -> DataFrame:
    """Per family: rows, and rows visible at their own evidence clock."""
    out = None
    for name, df, clock in families:
        one = df.agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(F.col("available_at") == F.col(clock)).alias("n_at_own_clock")).select(F.lit(name).alias("family"), "*")
        out = one if out is None else out.unionByName(one)
    return out


def time_grid(spans: DataFrame, hours: Sequence[int], event_start: str, event_end: str) -> DataFrame:
    """Evaluation instants: every day of each span at fixed hours, tagged event or control."""
    day = F.explode(F.sequence("lo", "hi")).alias("day")
    rows = spans.select("*", day).withColumn("hour", F.explode(F.array(*[F.lit(h) for h in hours])))
    role = F.when(F.col("day").between(F.lit(event_start).cast("date"), F.lit(event_end).cast("date")), "event").otherwise("control")
    as_of = F.timestamp_seconds(F.unix_timestamp(F.col("day").cast("timestamp")) + F.col("hour") * 3600)
    return rows.withColumn("as_of", as_of).withColumn("role", role)


# The two replay modes and how each row family becomes visible.
KNOWLEDGE_TIME, RETROSPECTIVE = "KNOWLEDGE_TIME", "RETROSPECTIVE"
ARMS = {"old": "0.1.0", "new": "0.2.0"}
# family, clock it becomes visible by, how that is earlier than any real retrieval, whether it could not have existed
PROJECTION_RULES = (
    ("observation", "valid_time", "publication_latency", False),
    ("derived_feature", "valid_time", "publication_lag_and_approved_values", False),
    ("reference", "cutoff", "rebuilt_from_later_fetch", False),
    ("threshold", "declared_epoch", "vintage_unverified", True),
    ("forecast_run", "issued_at", "none", False),
)


def projected(df: DataFrame, mode: str, evidence_clock: str) -> DataFrame:
    """Visibility clock of a replay mode as a derived view; the archive itself is never rewritten."""
    if mode not in (KNOWLEDGE_TIME, RETROSPECTIVE):
        raise ValueError(f"unknown replay mode {mode!r}")
    own = F.col("available_at") if mode == KNOWLEDGE_TIME else F.col(evidence_clock)
    return df.withColumn("archived_available_at", F.col("available_at")).withColumn("available_at", own)


def restored(df: DataFrame) -> DataFrame:
    return df.withColumn("available_at", F.col("archived_available_at")).drop("archived_available_at")


def disclosure(evaluations: DataFrame, mode: str) -> DataFrame:
    """What must accompany the numbers of a run: mode, families with their clock and optimism, and those that could not have existed."""
    rules = PROJECTION_RULES if mode == RETROSPECTIVE else ()
    families = [f for f, _, _, _ in rules]
    optimism = [f"{f}:{clock}:{early}" for f, clock, early, _ in rules]
    stale = [f for f, _, _, bad in rules if bad]
    text = (
        "rows were read exactly as the deployed system reads them"
        if mode == KNOWLEDGE_TIME
        else "rows were made visible by their own evidence clock; the figures say what was reconstructable, not what was known"
    )
    names = lambda xs: F.array(*[F.lit(x) for x in xs]) if xs else F.array().cast("array<string>")
    return evaluations.groupBy("arm").agg(F.count(F.lit(1)).alias("n")).select(
        "arm", "n", F.lit(mode).alias("mode"), names(families).alias("projected"), names(optimism).alias("optimism"), names(stale).alias("anachronistic"), F.lit(text).alias("disclosure")
    )


def content(columns: Sequence[Column]) -> tuple[Column, Column]:
    """Aggregates (rows, digest) of a table, whatever the order of its rows: a sum over the digests of the rows."""
    row = F.sha2(F.concat_ws("|", *[F.coalesce(c.cast("string"), F.lit("~")) for c in columns]), 256)
    return F.count(F.lit(1)), F.sum(F.conv(F.substring(row, 1, 15), 16, 10).cast("decimal(38,0)"))


def content_sha256(rows: Column, digest: Column) -> Column:
    return F.sha2(F.concat_ws(":", rows.cast("string"), F.coalesce(digest, F.lit(0)).cast("string")), 256)


def run_document(evals: DataFrame, columns: Sequence[Column], mode: str, grid: tuple[str, str, int], event: tuple[str, str], inputs: dict[str, tuple[DataFrame, Sequence[Column]]]) -> DataFrame:
    """One row that says what a run was: mode, grid, event, arms, inputs, counts and content, each from one aggregation.

    ``run_id`` is a hash of all of it: a changed input or evaluation changes it, a run repeated does not.
    """
    rows, digest = content(columns)
    doc = evals.agg(
        rows.alias("n_evaluations"), F.count_if(F.col("role") == "event").alias("n_event"), F.count_if(F.col("role") == "control").alias("n_control"),
        F.countDistinct("site").alias("n_sites"), F.min("as_of").alias("first_as_of"), F.max("as_of").alias("last_as_of"), digest.alias("_digest"),
    ).withColumn("content_sha256", content_sha256(F.col("n_evaluations"), F.col("_digest")))
    told = []
    for name, (df, parts) in inputs.items():
        n, d = content(parts)
        one = df.agg(n.alias("_n"), d.alias("_d")).select(F.concat_ws("=", F.lit(name), content_sha256(F.col("_n"), F.col("_d"))).alias(f"_in_{name}"))
        doc = doc.crossJoin(one)  # one row each
        told.append(F.col(f"_in_{name}"))
    names = [f for f, _, _, _ in PROJECTION_RULES] if mode == RETROSPECTIVE else []
    doc = doc.withColumns({
        "mode": F.lit(mode), "grid": F.concat_ws("|", *map(F.lit, map(str, grid))), "event": F.concat_ws("|", *map(F.lit, event)),
        "arms": F.array(*[F.lit(f"{k}=susceptibility@{v}") for k, v in ARMS.items()]), "projected": F.array(*map(F.lit, names)).cast("array<string>"), "inputs": F.array(*told),
    })
    identity = F.concat_ws("\n", "mode", "grid", "event", F.concat_ws("|", "arms"), F.concat_ws("|", "inputs"), "content_sha256")
    shape = ["mode", "grid", "event", "arms", "projected", "inputs", "n_evaluations", "n_event", "n_control", "n_sites", "first_as_of", "last_as_of", "content_sha256"]
    return doc.select(F.sha2(identity, 256).alias("run_id"), *shape)


def grid_trends(series: DataFrame, grid: tuple[str, str, int], key: str = "site", window_h: float = trend.WINDOW_H) -> DataFrame:
    """Six-hour trend at every grid instant that any reading is near: (key, as_of, trend_direction, trend_refusal).

    ``series``: key, t, v; one row per cadence step. Each reading goes to the grid instants whose closed window
    [as_of - window, as_of] holds it, so a window is bounded by its length over the cadence.
    """
    t0, t1 = (F.lit(x).cast("timestamp") for x in grid[:2])
    n_slots = F.floor(hours_between(t1, t0) / grid[2]).cast("int")
    age = hours_between(F.col("t"), t0)
    first, last = F.greatest(F.lit(0), F.ceil(age / grid[2]).cast("int")), F.least(n_slots, F.floor((age + window_h) / grid[2]).cast("int"))
    near = series.filter((F.col("t") <= t1) & (F.col("t") >= plus_hours(t0, -window_h)))
    seen = near.select(key, "t", "v", F.explode(F.when(first <= last, F.sequence(first, last))).alias("slot"))
    as_of = plus_hours(t0, F.col("slot") * grid[2])
    pts = seen.withColumn("as_of", as_of).select(key, "as_of", F.struct(hours_between(F.col("t"), F.col("as_of")).alias("x"), F.col("v").alias("y")).alias("p"))
    w = trend.window_shape(pts.groupBy(key, "as_of").agg(F.sort_array(F.collect_list("p")).alias("pts")))
    e = trend.estimate(w, F.lit("FLUVIAL"), F.lit("flow"))
    return e.select(key, "as_of", F.col("direction").alias("trend_direction"), F.col("refusal").alias("trend_refusal"))


def with_trends(evals: DataFrame, trends: DataFrame, key: str = "site") -> DataFrame:
    """Evaluations with the trend at their instant; where no reading was near, it is unknown."""
    j = evals.join(trends.select(key, "as_of", "trend_direction"), [key, "as_of"], "left")
    return j.withColumn("trend_direction", F.coalesce("trend_direction", F.lit("unknown")))


def evaluations(ranked_days: DataFrame, grid: tuple[str, str, int], event: tuple[str, str], max_age_h: float = 48.0) -> DataFrame:
    """One row per (site, evaluation time, arm).

    ``ranked_days`` already carries percentile, changes and ranks per (site, day) with valid_time
    and available_at; the replay is one as-of join of that table against the time grid, so no
    surface is recomputed per instant.
    """
    from fluvion.functions import bands
    from fluvion.operators.joins import latest_at_grid

    payload = ["day", "value", "percentile", "direction_24h", "direction_48h", "growth_rank", "growth_rank_of"]
    at = latest_at_grid(ranked_days, ["site"], ["valid_time"], payload, *grid, max_age_h)
    role = F.when(F.to_date("as_of").between(F.lit(event[0]).cast("date"), F.lit(event[1]).cast("date")), "event").otherwise("control")
    arm = F.explode(F.array(*[F.lit(a) for a in ARMS]))
    both = at.withColumn("role", role).withColumn("band", F.coalesce(bands.band(F.col("percentile")), F.lit("unknown"))).withColumn("arm", arm)
    new = F.col("arm") == "new"
    for c in ("direction_24h", "direction_48h", "growth_rank", "growth_rank_of"):
        both = both.withColumn(c, F.when(new, F.col(c)))
    return both


def rule_columns(fraction: float = 0.01) -> dict[str, tuple[Column, bool]]:
    """Escalation rules as (boolean column, answerable by the old arm)."""
    from fluvion.functions import bands

    at_least = lambda name: bands.band_index(F.col("band")) >= bands.BANDS.index(name) + 1
    very_high, rising24 = at_least("very_high"), F.col("direction_24h") == "rising"
    within = F.col("growth_rank") <= F.greatest(F.lit(1), F.ceil(F.lit(fraction) * F.col("growth_rank_of")))
    rules = {
        "band_very_high": (very_high, True), "band_high": (at_least("high"), True), "rising_24h": (rising24, False),
        "rising_48h": (F.col("direction_48h") == "rising", False),
        "any_escalation": (F.coalesce(very_high, F.lit(False)) | F.coalesce(rising24, F.lit(False)), True),
        "trend_rising_6h": (F.col("trend_direction") == "rising", True),
        f"growth_rank_top_{fraction:g}_24h": (within, False),
    }
    return rules


#: Rules whose constant was fixed before looking at the outcome; only these may claim a lead time.
CHOSEN_RULES_PREFIX = "growth_rank_top"


def apply_rules(evals: DataFrame, rules: Sequence[str] | None = None) -> DataFrame:
    """(evaluation, rule, holds); a rule the arm cannot answer is null, not false."""
    cols = {k: v for k, v in rule_columns().items() if rules is None or k in rules}
    structs = [
        F.struct(F.lit(k).alias("rule"), F.when((F.col("arm") == "new") | F.lit(old_ok), F.coalesce(c, F.lit(False))).alias("holds"))
        for k, (c, old_ok) in cols.items()
    ]
    return evals.select("site", "as_of", "arm", "role", F.explode(F.array(*structs)).alias("r")).select("site", "as_of", "arm", "role", "r.*")


def earliest_escalation(ruled: DataFrame) -> DataFrame:
    """First event instant each rule held, and how often it fired in the control instants."""
    event = F.col("role") == "event"
    return ruled.groupBy("site", "rule", "arm").agg(
        F.min(F.when(event & F.col("holds"), F.col("as_of"))).alias("first_time"), F.count_if(event).alias("evaluations"),
        F.count_if(~event & F.coalesce("holds", F.lit(False))).alias("control_firings"), F.bool_and(F.col("holds").isNotNull()).alias("applicable"),
    )


def compare_arms(escalations: DataFrame) -> DataFrame:
    """Old against new per (site, rule): a difference counts as lead time only for fixed rules."""
    pick = lambda arm, c: F.max(F.when(F.col("arm") == arm, F.col(c)))
    g = escalations.groupBy("site", "rule").agg(
        pick("old", "first_time").alias("old_time"), pick("new", "first_time").alias("new_time"),
        F.bool_or(F.when(F.col("arm") == "old", F.col("applicable"))).alias("old_ok"), F.bool_or(F.when(F.col("arm") == "new", F.col("applicable"))).alias("new_ok"),
    )
    diff = F.round((F.unix_timestamp("old_time") - F.unix_timestamp("new_time")) / 3600.0, 2)
    fixed = ~F.col("rule").startswith(CHOSEN_RULES_PREFIX)
    both = F.col("old_ok") & F.col("new_ok")
    verdict = (
        F.when(~F.col("old_ok") & ~F.col("new_ok"), "not_applicable")
        .when(~both & F.coalesce(F.col("new_time"), F.col("old_time")).isNotNull(), "earlier_but_not_a_lead_time")
        .when(~both, "no_difference")
        .when(F.col("old_time").isNull() & F.col("new_time").isNull(), "no_difference")
        .when(F.col("new_time").isNull(), "later")
        .when(F.col("old_time").isNull(), "earlier_but_not_a_lead_time")
        .when((diff > 0) & fixed, "lead_time")
        .when(diff > 0, "earlier_but_not_a_lead_time")
        .when(diff < 0, "later")
        .otherwise("no_difference")
    )
    return g.select("site", "rule", "old_time", "new_time", diff.alias("difference_h"), verdict.alias("verdict"))


def base_rate(ranked_days: DataFrame, skip: int = 3) -> DataFrame:
    """How often each rule would have held over the whole record, all year and in winter.

    Days per site are numbered once (a calendar-bounded window) to skip the first few.
    """
    from pyspark.sql import Window as W

    from fluvion.functions.clocks import is_winter

    days = ranked_days.withColumn("_i", F.row_number().over(W.partitionBy("site").orderBy("day"))).filter(F.col("_i") > skip)
    winter = is_winter(F.col("valid_time"))
    rising24, rising48 = F.col("direction_24h") == "rising", F.col("direction_48h") == "rising"
    high, top = F.coalesce(F.col("percentile") >= 75, F.lit(False)), F.coalesce(F.col("percentile") >= 90, F.lit(False))
    rules = {
        "rising_24h": rising24, "rising_48h": rising48, "band_high": high, "band_very_high": top,
        "any_escalation": top | rising24, "rising_24h_below_p90": rising24 & ~top,
    }
    g = days.groupBy("site").agg(
        F.count(F.lit(1)).alias("days"), F.count_if(winter).alias("winter_days"),
        *[F.count_if(c).alias(k) for k, c in rules.items()], *[F.count_if(c & winter).alias(f"{k}_winter") for k, c in rules.items()],
    )
    per_year = F.greatest(F.lit(1e-9), F.col("days") / 365.25)
    return g.withColumns({f"{k}_per_year": F.round(F.col(k) / per_year + 1e-9, 1) for k in rules})


def write_evaluations(evals: DataFrame, path: str) -> None:
    """Evaluations partitioned by arm, so that rules can be applied again without a replay; an arm is split by its size."""
    evals.hint("rebalance", F.col("arm")).write.mode("errorifexists").option("maxRecordsPerFile", MAX_FILE_RECORDS).partitionBy("arm").parquet(path)
