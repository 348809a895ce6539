"""Continuous ingest: idempotent appends, revisions, change events and snapshots per micro-batch.

What a batch writes goes to its own ``batch=<id>`` folder with overwrite, so a batch that is run again after
a failure replaces its own output and nothing else. What it must know of earlier batches is held in keyed tables
(`fluvion.streaming.state`), read at the version before the batch and only where the batch's own keys lie.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import wraps

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from fluvion.operators import revisions, selection
from fluvion.streaming.state import KeyedTable


def held(each: Callable[[DataFrame, int], None]) -> Callable[[DataFrame, int], None]:
    """A batch writer whose batch is computed once, however often it reads it."""

    @wraps(each)
    def run(batch: DataFrame, batch_id: int) -> None:
        batch.persist()
        try:
            each(batch, batch_id)
        finally:
            batch.unpersist()

    return run


def open_stream(spark: SparkSession, path: str, schema, files_per_trigger: int | None = None) -> DataFrame:
    """File-source stream over a landing folder."""
    reader = spark.readStream.schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(path)


def run_available(df: DataFrame, checkpoint: str, each: Callable[[DataFrame, int], None]) -> StreamingQuery:
    """Process everything that has landed, one micro-batch at a time, then stop."""
    q = df.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(each).start()
    q.awaitTermination()
    return q


def run_to_table(df: DataFrame, checkpoint: str, path: str) -> StreamingQuery:
    """Append-mode stream into Parquet: exactly once through the sink's own log.

    What a watermark kept out is not lost unseen: ``<path>_late`` receives one row (ended_at, n_dropped) per run
    that dropped any. A stateful step counts rows after its map-side combine.
    """
    q = (
        df.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint)
        .outputMode("append").trigger(availableNow=True).start()
    )
    dropped = late_rows(q)
    if dropped:
        one = df.sparkSession.range(1).select(F.current_timestamp().alias("ended_at"), F.lit(dropped).cast("long").alias("n_dropped"))
        one.write.mode("append").parquet(f"{path}_late")
    return q


def late_rows(q: StreamingQuery, look_s: float = 0.5) -> int:
    """Rows dropped by the watermarks of a query, over all batches until it ends.

    Progress is kept of the last batches only, so it is looked at again and again while the query runs.
    """
    dropped: dict[int, int] = {}

    def look() -> None:
        for p in q.recentProgress:
            dropped[p.batchId] = max(dropped.get(p.batchId, 0), sum(op.numRowsDroppedByWatermark for op in p.stateOperators))

    while not q.awaitTermination(look_s):
        look()
    look()
    return sum(dropped.values())


def earlier_batches(spark: SparkSession, path: str, batch_id: int, like: DataFrame) -> DataFrame:
    """Rows written by batches before ``batch_id``; none yet gives an empty table."""
    try:
        return spark.read.parquet(path).filter(F.col("batch") < batch_id).drop("batch")
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return like.limit(0)


def write_batch(df: DataFrame, path: str, batch_id: int) -> None:
    df.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")


def _schema(df: DataFrame, *columns: str) -> str:
    return ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in columns)


def append_absent(path: str, keys: Sequence[str], order: Sequence[str], instant: str) -> Callable[[DataFrame, int], None]:
    """Batch writer: only rows whose natural key (which includes ``instant``) is not stored yet.

    The keys of all batches are a keyed table beside the rows, so that only the batch's own months and key hashes are read.
    """

    @held
    def each(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        known = KeyedTable(spark, f"{path}_keys", _schema(batch, *keys), keys, instant)
        write_batch(revisions.absent(batch, known.lookup(batch.select(*keys).distinct(), batch_id - 1), keys, [F.asc(c) for c in order]), path, batch_id)
        known.commit(spark.read.schema(batch.schema).parquet(f"{path}/batch={batch_id}"), batch_id)

    return each


def append_revisions(path: str, keys: Sequence[str], compared: Sequence[str], instant: str) -> Callable[[DataFrame, int], None]:
    """Batch writer: only rows that differ from the latest stored revision of their key; the latest are a keyed table."""

    @held
    def each(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        kinds = _schema(batch, *keys, "id", *compared)
        last = KeyedTable(spark, f"{path}_last", f"{kinds}, revision_seq int", keys, instant)
        stored = last.lookup(batch.select(*keys).distinct(), batch_id - 1)
        write_batch(revisions.new_revisions(stored, batch.withColumn("arrived", F.col("id")), keys, compared, "arrived"), path, batch_id)
        new = spark.read.schema(f"{kinds}, revision_seq int").parquet(f"{path}/batch={batch_id}")
        newest = F.max_by(F.struct("id", *compared, "revision_seq"), "revision_seq").alias("s")
        last.commit(new.groupBy(*keys).agg(newest).select(*keys, "s.*"), batch_id)

    return each


def change_events(anchors_path: str, events_path: str, key: str, instant: str) -> Callable[[DataFrame, int], None]:
    """Batch writer: a key whose newest content time moved since the last look becomes an event.

    The first batch only primes: nothing changed while nobody was looking. The anchors are a keyed table.
    """

    @held
    def each(batch: DataFrame, batch_id: int) -> None:
        seen = batch.groupBy(key).agg(F.max(instant).alias("content_time"))
        anchors = KeyedTable(batch.sparkSession, anchors_path, _schema(seen, key, "content_time"), [key])
        previous = anchors.lookup(seen, batch_id - 1).withColumnRenamed("content_time", "previous")
        moved = revisions.beside(seen, previous, [key]).filter(F.col("previous").isNull() | (F.col("content_time") > F.col("previous")))
        if batch_id > 0:
            write_batch(moved.select(key, "content_time", "previous"), events_path, batch_id)
        anchors.commit(moved.select(key, "content_time"), batch_id)

    return each


def snapshot_table(spark: SparkSession, path: str, schema: str, key: str) -> KeyedTable:
    return KeyedTable(spark, path, schema, [key])


def snapshots(table: KeyedTable, key: str, order: Sequence[str]) -> Callable[[DataFrame, int], None]:
    """Batch writer: the newest row per key after each batch, as a version of a keyed table."""

    @held
    def each(batch: DataFrame, batch_id: int) -> None:
        by = [F.desc(c) for c in order]
        incoming = selection.newest(batch.select(*table.schema.names), [key], by)
        stored = table.lookup(incoming, batch_id - 1)
        newest = selection.newest(stored.withColumn("_new", F.lit(False)).unionByName(incoming.withColumn("_new", F.lit(True))), [key], [*by, F.asc("_new")])
        table.commit(newest.filter("_new"), batch_id)

    return each


def as_of(rows: DataFrame, versions: DataFrame, on: str, row_key: str, of: str, value: str, kinds: Sequence[str]) -> DataFrame:
    """``rows`` with a column per kind: the value of the newest version valid at ``valid_time`` and known at ``available_at``.

    ``versions``: on, ``of`` (its kind), value, effective_from, known_at, id. Versions of a key are few, so each row meets
    those of its key and one aggregation keeps the newest of each kind.
    """
    met = rows.join(versions.select(F.col(on).alias("_on"), of, F.col(value).alias("_value"), "effective_from", "known_at", F.col("id").alias("_id")), F.col(on) == F.col("_on"), "left")
    valid = (F.col("effective_from") <= F.col("valid_time")) & (F.col("known_at") <= F.col("available_at"))
    newest = [F.max(F.when(valid & (F.col(of) == k), F.struct("effective_from", "known_at", "_id", "_value"))).alias(k) for k in kinds]
    keep = [F.first(c).alias(c) for c in rows.columns if c != row_key]
    g = met.groupBy(row_key).agg(*keep, *newest)
    return g.select(*rows.columns, *[F.col(f"{k}._value").alias(k) for k in kinds])


def beside_dimension(path: str, dimension: Callable[[], DataFrame], join: Callable[[DataFrame, DataFrame], DataFrame]) -> Callable[[DataFrame, int], None]:
    """Batch writer: each batch meets the dimension as it is stored when the batch runs, not when the stream began."""

    @held
    def each(batch: DataFrame, batch_id: int) -> None:
        write_batch(join(batch, dimension()), path, batch_id)

    return each


def with_lateness(df: DataFrame) -> DataFrame:
    """Late data is kept: the row says how late it was known, and no watermark drops it."""
    return df.withColumn("lateness_h", (F.unix_timestamp("available_at") - F.unix_timestamp("valid_time")) / 3600.0)
