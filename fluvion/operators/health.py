"""Freshness anchors, job states and their summaries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

# Fixed values.
LATE_CADENCES = 4
RECOVERY_S = 24 * 3600
PROVIDER_STATE = {"ok": "healthy", "pending": "unknown", "late": "degraded", "failing": "degraded", "down": "down"}
PROVIDER_RANK = {"healthy": 0, "unknown": 1, "degraded": 2, "down": 3}


def freshness_anchors(
    parts: Sequence[tuple[str, DataFrame]], fetched: DataFrame, metadata_only: Sequence[str], valid_until_superseded: Sequence[str]
) -> DataFrame:
    """Newest value and retrieval time per product over several tables.

    Each part (product, value_time, retrieved_at) is reduced by its own partial aggregation before
    the union. Fetches alone anchor only products that hold no values by design; products that
    stay valid until superseded take the poll time as well, but not as content time.
    """
    newest = [F.max("value_time").alias("value_time"), F.max("retrieved_at").alias("retrieved_at")]
    union = None
    for rank, (kind, df) in enumerate([*parts, ("raw_artifact", fetched)]):
        one = df.groupBy("product").agg(*newest).filter(F.col("product").isNotNull()).select(F.lit(rank).alias("rank"), F.lit(kind).alias("kind"), "*")
        union = one if union is None else union.unionByName(one)
    raw = F.col("kind") == "raw_artifact"
    val = F.max(F.when(~raw, F.col("value_time")))
    g = union.groupBy("product").agg(
        val.alias("content_time"),
        F.max(F.when(~raw, F.col("retrieved_at"))).alias("value_retrieved"),
        F.max(F.when(raw, F.col("value_time"))).alias("fetch_time"),
        F.max(F.when(raw, F.col("retrieved_at"))).alias("fetch_retrieved"),
        F.concat_ws("+", F.transform(F.sort_array(F.collect_list(F.when(~raw, F.struct("rank", "kind")))), lambda x: x["kind"])).alias("kinds"),
    )
    has_values, has_fetch = F.col("kinds") != "", F.col("fetch_time").isNotNull()
    merges = F.col("product").isin(*valid_until_superseded) & has_fetch
    alone = ~has_values & has_fetch & F.col("product").isin(*metadata_only)
    merged_kind = F.concat_ws("+", F.nullif("kinds", F.lit("")), F.lit("raw_artifact"))
    return g.filter(has_values | merges | alone).select(
        "product",
        F.when(merges, merged_kind).when(alone, F.lit("raw_artifact")).otherwise(F.col("kinds")).alias("kind"),
        F.when(merges, F.greatest("content_time", "fetch_time")).when(alone, F.col("fetch_time")).otherwise(F.col("content_time")).alias("valid_time"),
        F.when(merges, F.greatest("value_retrieved", "fetch_retrieved")).when(alone, F.col("fetch_retrieved")).otherwise(F.col("value_retrieved")).alias("retrieved_at"),
        F.when(alone & ~merges, F.col("fetch_time")).otherwise(F.col("content_time")).alias("content_time"),
    )


def latest_runs(runs: DataFrame) -> DataFrame:
    """Last run and last successful run per job, in one partial aggregation."""
    order = F.struct("started_at", "run_id")
    ok = F.when(F.col("ok"), order)
    return runs.groupBy("job").agg(
        F.max(F.struct("started_at", "run_id", "ok")).alias("last"),
        F.max(ok).alias("last_ok"),
    )


def job_states(catalog: DataFrame, latest: DataFrame, now: Column) -> DataFrame:
    """State of every registered job: ``catalog`` is (job, provider, cadence_s)."""
    j = catalog.join(latest, "job", "left")
    late_after = F.col("cadence_s") * LATE_CADENCES
    since = lambda c: (F.unix_timestamp(now) - F.unix_timestamp(c)).cast("long")
    ok_age, run_age = since("last_ok.started_at"), since("last.started_at")
    failed = F.col("last.ok") == F.lit(False)
    state = (
        F.when(failed & F.col("last_ok").isNull(), "down")
        .when(failed & (ok_age > F.greatest(F.lit(RECOVERY_S), late_after)), "down")
        .when(failed, "failing")
        .when(F.col("last_ok").isNotNull() & (ok_age > late_after), "late")
        .when(F.col("last_ok").isNotNull(), "ok")
        .when(F.col("last").isNotNull() & (run_age > late_after), "down")
        .otherwise("pending")
    )
    reason = (
        F.when(failed & F.col("last_ok").isNull(), "failed_never_succeeded")
        .when(failed & (ok_age > F.greatest(F.lit(RECOVERY_S), late_after)), "failed_no_recent_success")
        .when(failed, "last_run_failed")
        .when(F.col("last_ok").isNotNull() & (ok_age > late_after), "success_too_old")
        .when(F.col("last_ok").isNotNull(), F.lit(None))
        .when(F.col("last").isNotNull(), "no_outcome_recorded")
        .otherwise("never_run")
    )
    return j.select("job", "provider", "cadence_s", state.alias("state"), ok_age.alias("age_s"), reason.alias("reason"))


def provider_states(jobs: DataFrame) -> DataFrame:
    """A provider is as bad as its worst job."""
    rank = F.lit(0)
    for job_state, provider in PROVIDER_STATE.items():
        rank = F.when(F.col("state") == job_state, F.lit(PROVIDER_RANK[provider])).otherwise(rank)
    names = F.array(*[F.lit(n) for n, _ in sorted(PROVIDER_RANK.items(), key=lambda kv: kv[1])])
    return jobs.groupBy("provider").agg(F.element_at(names, F.max(rank) + 1).alias("state"), F.count(F.lit(1)).alias("n_jobs"))


def overall(jobs: DataFrame, products: DataFrame) -> DataFrame:
    """degraded on any evidence of failure, unknown on any gap, ok otherwise."""
    signals = jobs.select(
        F.col("state").isin("late", "failing", "down").alias("alarming"), (F.col("state") == "pending").alias("unknown")
    ).unionByName(
        products.select(F.col("state").isin("stale", "degraded").alias("alarming"), F.col("state").isin("missing", "unknown").alias("unknown"))
    )
    g = signals.agg(F.count_if("alarming").alias("n_alarming"), F.count_if("unknown").alias("n_unknown"))
    return g.withColumn("status", F.when(F.col("n_alarming") > 0, "degraded").when(F.col("n_unknown") > 0, "unknown").otherwise("ok"))


def config_drift(declared: DataFrame, stored: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """Stored settings that differ from the declared ones, named column by column."""
    s = stored.select(key, F.struct(*columns).alias("s"))
    j = declared.join(s, key, "left")
    parts = [F.when(F.col("s").isNotNull() & ~F.col(c).eqNullSafe(F.col(f"s.{c}")), F.concat(F.lit(f"{c}: "), F.col(f"s.{c}").cast("string"), F.lit(" != "), F.col(c).cast("string"))) for c in sorted(columns)]
    return j.select(key, F.when(F.col("s").isNull(), "not_stored").otherwise(F.nullif(F.concat_ws(", ", *parts), F.lit(""))).alias("drift"))
