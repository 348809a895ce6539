"""Numbers, runs and predecessors inside a key of any size, dealt by blocks of the order.

Rows are worked on inside (key, block) partitions. What a block needs of those before it is one row of state per block
(counts, the last row, the open run), carried along the blocks of a key; states merge associatively, so a key that holds a
third of all rows is spread over its blocks and only its block states meet.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F


def day_block(instant: str = "t", days: int = 1) -> Column:
    """The block of time an instant lies in."""
    return F.floor(F.unix_timestamp(instant) / (86400 * days))


def numbered(rows: DataFrame, keys: Sequence[str], block: Sequence[str], order: Sequence[str | Column], name: str) -> DataFrame:
    """``rows`` with ``name``: their number per key, from 1, in the order of ``block`` and then ``order``.

    Rows are numbered inside (key, block) partitions; what comes before a block is a running sum over the
    counts of the blocks, one row each. A key that holds a third of all rows is so spread over its
    blocks. Nulls in keys and blocks are values like others and come first.
    """
    inside = F.row_number().over(W.partitionBy(*keys, *block).orderBy(*order))
    counts = rows.groupBy(*keys, *block).agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(W.partitionBy(*keys).orderBy(*block).rowsBetween(W.unboundedPreceding, -1))
    both = [*keys, *block]
    carry = counts.select(*[F.col(c).alias(f"_at_{c}") for c in both], F.coalesce(before, F.lit(0)).alias("_before"))
    on = [F.col(c).eqNullSafe(F.col(f"_at_{c}")) for c in both]
    counted = rows.withColumn("_inside", inside).join(carry, on)
    return counted.select(*rows.columns, (F.col("_inside") + F.col("_before")).cast("int").alias(name))


def _carried(rows: DataFrame, states: DataFrame, both: Sequence[str]) -> DataFrame:
    """``rows`` beside the state carried into their block."""
    named = states.select(*[F.col(c).alias(f"_at_{c}") for c in both], *[c for c in states.columns if c not in both])
    return rows.join(named, [F.col(c).eqNullSafe(F.col(f"_at_{c}")) for c in both]).drop(*[f"_at_{c}" for c in both])


def lagged(rows: DataFrame, keys: Sequence[str], block: Column, order: str, columns: dict[str, str]) -> DataFrame:
    """``rows`` with columns of the row before them in their key, in the order of ``order``; ``columns`` maps new names to old.

    ``block`` is a function of ``order`` that never falls. The first row of a block takes the last row of the block before it.
    """
    both = [*keys, "_block"]
    blocked = rows.withColumn("_block", block)
    here = F.struct(*[F.col(old).alias(new) for new, old in columns.items()])
    inside = F.lag(here).over(W.partitionBy(*both).orderBy(order))
    last = blocked.groupBy(*both).agg(F.max_by(here, order).alias("_last"))
    carry = last.select(*both, F.lag("_last").over(W.partitionBy(*keys).orderBy("_block")).alias("_carry"))
    met = _carried(blocked.withColumn("_prev", inside), carry, both)
    prev = F.coalesce("_prev", "_carry")
    return met.select(*rows.columns, *[prev[new].alias(new) for new in columns])


def runs(rows: DataFrame, keys: Sequence[str], block: Column, order: str, inside: Column) -> DataFrame:
    """Rows for which ``inside`` holds, with ``run`` (rows that break a run before it, per key) and ``nth`` (place in the run, from 1).

    A run goes on over the border of a block if nothing breaks it: a block's state is its number of breaks and the length of what
    stands after its last one, and the length carried into a block is the sum of these since the last block with a break.
    """
    both = [*keys, "_block"]
    blocked = rows.withColumns({"_block": block, "_break": F.when(F.coalesce(inside, F.lit(False)), 0).otherwise(1)})
    w = W.partitionBy(*both).orderBy(order)
    counted = blocked.withColumn("_breaks", F.sum("_break").over(w))
    state = counted.groupBy(*both).agg(F.max("_breaks").alias("_total"), F.count(F.lit(1)).alias("_n"))
    tail = _carried(counted, state, both).filter("_breaks = _total AND _break = 0").groupBy(*both).agg(F.count(F.lit(1)).alias("_tail"))
    state = state.join(tail.select(*[F.col(c).alias(f"_at_{c}") for c in both], "_tail"), [F.col(c).eqNullSafe(F.col(f"_at_{c}")) for c in both], "left")
    state = state.select(*both, "_total", F.coalesce("_tail", F.lit(0)).alias("_tail"))
    along = W.partitionBy(*keys).orderBy("_block")
    # blocks of one group: a block with a break, and those after it up to the next one
    state = state.withColumn("_group", F.sum(F.when(F.col("_total") > 0, 1).otherwise(0)).over(along))
    ahead = W.partitionBy(*keys, "_group").orderBy("_block")
    state = state.withColumn("_upto", F.sum("_tail").over(ahead)).select(
        *both, F.coalesce(F.sum("_total").over(along.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_before"),
        F.coalesce(F.lag("_upto").over(along), F.lit(0)).alias("_open"),
    )
    here = F.row_number().over(W.partitionBy(*both, "_breaks").orderBy(order))
    met = _carried(counted.filter("_break = 0").withColumn("_here", here), state, both)
    nth = F.col("_here") + F.when(F.col("_breaks") == 0, F.col("_open")).otherwise(0)
    return met.select(*rows.columns, (F.col("_breaks") + F.col("_before")).alias("run"), nth.cast("long").alias("nth"))
