"""Append-only writes: revisions, absent keys, change-only dimensions, completion, supersession."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F


def matching(rows: DataFrame, other: DataFrame, keys: Sequence[str], how: str) -> DataFrame:
    """``rows`` joined with the keys of ``other`` (semi or anti); null equals null in every key part."""
    have = other.select(*[F.col(k).alias(f"_h_{k}") for k in keys])
    return rows.join(have, [F.col(k).eqNullSafe(F.col(f"_h_{k}")) for k in keys], how)


def beside(rows: DataFrame, other: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``rows`` with the other columns of the row of ``other`` that has the same keys, null equal to null, if any."""
    named = other.select(*[F.col(k).alias(f"_h_{k}") if k in keys else F.col(k) for k in other.columns])
    return rows.join(named, [F.col(k).eqNullSafe(F.col(f"_h_{k}")) for k in keys], "left").drop(*[f"_h_{k}" for k in keys])


def new_revisions(stored: DataFrame, batch: DataFrame, keys: Sequence[str], compared: Sequence[str], order: str) -> DataFrame:
    """Rows of ``batch`` that differ from the version before them, linked and numbered.

    The version before is the latest stored revision for the first arrival of a key and the
    previous arrival of the same batch afterwards. Identical arrivals are not written. The latest
    stored revision is reduced map-side before it meets the batch.
    ``stored`` has id and revision_seq; ``order`` is the arrival order of the batch.
    """
    last = stored.groupBy(*keys).agg(F.max(F.struct("revision_seq", "id", *compared)).alias("s"))
    last = last.select(*keys, F.col("s.id").alias("id"), F.lit(None).cast(batch.schema[order].dataType).alias(order),
                       *[F.col(f"s.{c}").alias(c) for c in compared], F.col("s.revision_seq").alias("_seq"), F.lit(True).alias("_stored"))
    touched = matching(last, batch.select(*keys).distinct(), keys, "left_semi")
    arrivals = batch.select(*keys, "id", order, *compared).withColumn("_seq", F.lit(None).cast("int")).withColumn("_stored", F.lit(False))
    w = W.partitionBy(*keys).orderBy(F.col(order).asc_nulls_first(), F.col("id"))
    state = F.struct(*compared)
    seen = touched.unionByName(arrivals).withColumn("_prev", F.lag(state).over(w))
    changed = F.when(F.col("_stored"), 0).when(F.col("_prev").isNull() | ~F.col("_prev").eqNullSafe(state), 1).otherwise(0)
    counted = seen.withColumn("_changed", changed)
    running = F.sum("_changed").over(w.rowsBetween(W.unboundedPreceding, 0))
    # identical arrivals are not written, so the link skips them
    written = F.when(F.col("_stored") | (F.col("_changed") == 1), F.col("id"))
    counted = counted.withColumn("_written", F.last(written, ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, -1)))
    base = F.max("_seq").over(W.partitionBy(*keys))
    return (
        counted.withColumn("revision_seq", (F.coalesce(base, F.lit(-1)) + running).cast("int"))
        .filter((F.col("_changed") == 1))
        .select(*keys, "id", *compared, "revision_seq", F.col("_written").alias("revises"))
    )


def absent(batch: DataFrame, stored: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """First row per natural key that the store does not hold; null equals null in every key part."""
    w = W.partitionBy(*keys).orderBy(*order)
    first = batch.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")
    return matching(first, stored.select(*keys).distinct(), keys, "left_anti")


def complete_instants(stored: DataFrame, expected: DataFrame, instant: str, scope: str) -> DataFrame:
    """Instants for which every expected scope has a row."""
    scopes = expected.select(scope).distinct()
    have = stored.join(scopes, scope, "left_semi").groupBy(instant).agg(F.countDistinct(scope).alias("n_have"))
    n_expected = scopes.agg(F.count(F.lit(1))).scalar()
    return have.withColumn("n_expected", n_expected).withColumn("complete", F.col("n_have") >= F.col("n_expected"))


def above_high_water(batch: DataFrame, stored: DataFrame, keys: Sequence[str], instant: str) -> DataFrame:
    """Batch rows newer than the newest stored instant of their key."""
    mark = stored.groupBy(*keys).agg(F.max(instant).alias("_mark"))
    return beside(batch, mark, keys).filter(F.col("_mark").isNull() | (F.col(instant) > F.col("_mark"))).drop("_mark")


def changed_dimension_rows(stored: DataFrame, batch: DataFrame, keys: Sequence[str], compared: Sequence[str]) -> DataFrame:
    """Rows to append to a slowly changing dimension: only where the compared columns changed."""
    last = stored.groupBy(*keys).agg(F.max(F.struct("effective_from", "id", *compared)).alias("_s"))
    joined = beside(batch, last, keys)
    same = F.lit(True)
    for c in compared:
        same = same & F.col(c).eqNullSafe(F.col(f"_s.{c}"))
    return joined.filter(F.col("_s").isNull() | ~same).withColumn("change", F.when(F.col("_s").isNull(), "new").otherwise("changed")).drop("_s")


def link_supersession(runs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Each run names the one issued before it for the same keys.

    The lag runs inside (keys, month) blocks; the first run of a block takes the last run of the
    block before it, found over one row per block. A point that holds a third of all runs is so
    spread over its months instead of being sorted in one task.
    """
    blocked = runs.withColumn("_block", F.trunc(F.to_date("issued_at"), "month"))
    inside = F.lag("run_id").over(W.partitionBy(*keys, "_block").orderBy("issued_at", "run_id"))
    last = blocked.groupBy(*keys, "_block").agg(F.max(F.struct("issued_at", "run_id")).alias("_last"))
    both = [*keys, "_block"]
    carry = last.select(*[F.col(c).alias(f"_at_{c}") for c in both], F.lag("_last.run_id").over(W.partitionBy(*keys).orderBy("_block")).alias("_carry"))
    linked = blocked.withColumn("_inside", inside).join(carry, [F.col(c).eqNullSafe(F.col(f"_at_{c}")) for c in both])
    return linked.select(*runs.columns, F.coalesce("_inside", "_carry").alias("supersedes"))
