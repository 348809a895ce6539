"""Sinks: partitioned appends, content-addressed catalogue, retention, snapshots, nested documents."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

# Fixed values.
RASTER_RETENTION_H = 72
#: bounds the size of a file, not of a result
MAX_FILE_RECORDS = 20_000_000


def write_by_month(df: DataFrame, path: str, instant: str = "valid_time", mode: str = "append") -> None:
    """Append partitioned by month of valid time.

    The rebalance hint gathers a month's rows and splits a month of any size into as many tasks as its bytes
    need, so neither the number of writers nor of files depends on a fixed number of salts.
    """
    month = F.trunc(F.to_date(instant), "month")
    out = df.withColumn("month", month).hint("rebalance", F.col("month"))
    out.write.mode(mode).option("maxRecordsPerFile", MAX_FILE_RECORDS).partitionBy("month").parquet(path)


def read_months(spark: SparkSession, path: str, lo: str, hi: str) -> DataFrame:
    """Read a month-partitioned table; the explicit month bound prunes partitions."""
    first, last = F.trunc(F.lit(lo).cast("date"), "month"), F.lit(hi).cast("date")
    return spark.read.parquet(path).filter(F.col("month").between(first, last))


def object_key(sha: Column, suffix: str, prefix: str = "") -> Column:
    """Content address with a two-level fan-out, optionally below a lifecycle prefix."""
    if prefix and not prefix.endswith("/"):
        raise ValueError("an object key prefix must end with '/'")
    return F.concat(F.lit(prefix), F.concat_ws("/", F.substring(sha, 1, 2), F.substring(sha, 3, 2), F.concat(sha, F.lit(suffix))))


def archive_rows(payloads: DataFrame, known: DataFrame, content: str, suffix: str, prefix: str, retention: str) -> DataFrame:
    """Catalogue rows of payloads whose bytes are not archived yet, one per distinct content.

    Only the digest is shuffled, never the bytes.
    """
    sha = F.sha2(F.col(content).cast("binary"), 256)
    rows = payloads.select(sha.alias("sha256"), F.octet_length(content).alias("size_bytes"), "fetched_at", "id")
    first = rows.groupBy("sha256").agg(F.min(F.struct("fetched_at", "id", "size_bytes")).alias("f"))
    return first.join(known.select("sha256"), "sha256", "left_anti").select(
        "sha256", object_key(F.col("sha256"), suffix, prefix).alias("object_key"), F.col("f.size_bytes").alias("size_bytes"),
        F.col("f.id").alias("id"), F.lit(retention).alias("retention_class"),
    )


def retained(rows: DataFrame, product: str, now: Column, hours: int = RASTER_RETENTION_H) -> DataFrame:
    """What stays after retention: other products whole, this product's rows of the last hours."""
    keep = (F.col("product") != product) | (F.unix_timestamp("valid_time") >= F.unix_timestamp(now) - hours * 3600)
    return rows.filter(keep)


def latest_snapshot(stored: DataFrame, incoming: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """Upsert: one row per key, the newest of the stored and incoming ones."""
    both = stored.unionByName(incoming)
    others = [c for c in both.columns if c != key and c not in order]
    best = both.groupBy(key).agg(F.max(F.struct(*order, *others)).alias("b"))
    return best.select(key, *[F.col(f"b.{c}").alias(c) for c in both.columns if c != key])


def ladder_document(ladder: DataFrame, levels: Sequence[str]) -> DataFrame:
    """One nested document per site: a map key → (n, levels), at most 366 entries."""
    entry = F.struct(F.col("key").cast("string").alias("key"), F.struct("n", *levels).alias("rung"))
    return ladder.groupBy("site").agg(F.map_from_entries(F.sort_array(F.collect_list(entry))).alias("ladder"))


def from_ladder_document(docs: DataFrame, levels: Sequence[str]) -> DataFrame:
    return docs.select("site", F.explode("ladder").alias("key", "r")).select("site", F.col("key").cast("long").alias("key"), "r.n", *[f"r.{x}" for x in levels])


def with_refusals(results: DataFrame, refused: DataFrame) -> DataFrame:
    """Results and refusals in one table: a number that was not computed is a null with its reason."""
    return results.withColumn("reason", F.lit(None).cast("string")).unionByName(
        refused.withColumn("value", F.lit(None).cast("double")), allowMissingColumns=True
    )


def load_report(rows: DataFrame, key: str, reason: str, value: str) -> DataFrame:
    """Per-site report of a load: written, rejected by reason, and the peak written."""
    ok = F.col(reason).isNull()
    return rows.groupBy(key).agg(
        F.count_if(ok).alias("written"), F.count_if(~ok).alias("rejected"), F.max(F.when(ok, F.col(value))).alias("peak"),
        F.mode(F.col(reason), True).alias("main_reason"),
    )


def seed_problems(rows: DataFrame, primary: DataFrame, key: str, zone: str, allowed: Sequence[str]) -> DataFrame:
    """Addenda that name no seeded key, and zones that are not allowed."""
    unknown = rows.join(primary.select(key).distinct(), key, "left_anti").select(F.col(key), F.lit("unknown_key").alias("problem"))
    bad_zone = rows.filter(F.col(zone).isNotNull() & ~F.col(zone).isin(*allowed)).select(F.col(key), F.lit("zone_not_allowed").alias("problem"))
    return unknown.unionByName(bad_zone)


def newest_rank(keys: Sequence[str], *order: Column) -> Column:
    return F.row_number().over(W.partitionBy(*keys).orderBy(*order))
