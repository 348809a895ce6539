"""Placement of rows on shards through a permutation-filled lookup table, in DataFrame functions only.

Each shard has its own permutation of the slots of a prime-sized table (an offset and a step from its
name). Shards take turns; each claims the first slot of its permutation that is still free, until none
is. Every shard so gets its even share to within one slot, and adding or removing a shard moves few
slots. The table has a fixed number of rows, so it may always be broadcast; placing a row is one hash and
one lookup, without a shuffle.

Defined results: a null key is hashed like any other value, so all null keys share one slot; equal keys
always share one. No column besides the key is read.
"""

from __future__ import annotations

from hashlib import blake2b

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

SLOTS = 65_537
SHARDS = tuple(f"shard-{i:03d}" for i in range(64))


def _number(name: str, salt: str) -> int:
    return int.from_bytes(blake2b(f"{salt}:{name}".encode(), digest_size=8).digest(), "big")


def filled(shards: tuple[str, ...] = SHARDS, slots: int = SLOTS) -> list[int]:
    """The index of the shard that owns each slot."""
    if not shards or len(set(shards)) != len(shards) or len(shards) > slots:
        raise ValueError("shards must be distinct names, at least one and no more than slots")
    if any(slots % d == 0 for d in range(2, int(slots**0.5) + 1)):
        raise ValueError("the number of slots must be prime")
    offset = [_number(s, "offset") % slots for s in shards]
    step = [_number(s, "step") % (slots - 1) + 1 for s in shards]
    owner, taken = [-1] * slots, 0
    while True:
        for i in range(len(shards)):
            while owner[offset[i]] >= 0:
                offset[i] = (offset[i] + step[i]) % slots
            owner[offset[i]] = i
            taken += 1
            if taken == slots:
                return owner


def lookup(spark: SparkSession, shards: tuple[str, ...] = SHARDS, slots: int = SLOTS) -> DataFrame:
    """(slot, shard): the table as rows, always ``slots`` of them."""
    owners = F.split(F.lit(",".join(map(str, filled(shards, slots)))), ",")
    names = F.array(*map(F.lit, shards))
    rows = spark.range(1).select(F.posexplode(owners).alias("slot", "owner"))
    return rows.select(F.col("slot").cast("long").alias("slot"), F.get(names, F.col("owner").cast("int")).alias("shard"))


def slot_of(*key: Column, slots: int = SLOTS) -> Column:
    return F.pmod(F.xxhash64(*key), F.lit(slots))


def placed(rows: DataFrame, key: list[str], shards: tuple[str, ...] = SHARDS, slots: int = SLOTS) -> DataFrame:
    """``rows`` with the columns ``slot`` and ``shard``; the broadcast side has exactly ``slots`` short rows."""
    table = lookup(rows.sparkSession, shards, slots)
    at = rows.withColumn("slot", slot_of(*(F.col(f"`{k}`") for k in key), slots=slots))
    return at.join(F.broadcast(table), "slot", "left").select(*(at[f"`{c}`"] for c in rows.columns), "slot", "shard")
