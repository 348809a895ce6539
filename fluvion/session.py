"""Session settings every job relies on."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(app_name: str = "fluvion", cores: int | None = None, **extra: str) -> SparkSession:
    """A local session for tests and benches; on a cluster the submitter owns master and memory."""
    n = cores or os.cpu_count() or 4
    builder = (
        SparkSession.builder.master(f"local[{n}]")
        .appName(app_name)
        .config("spark.sql.shuffle.partitions", str(n))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        # small inputs: keep every core busy (a cluster keeps Spark's own defaults)
        .config("spark.sql.adaptive.coalescePartitions.minPartitionSize", "256k")
        .config("spark.sql.files.maxPartitionBytes", "4m")
        .config("spark.sql.files.openCostInBytes", "64k")
        .config("spark.driver.memory", os.environ.get("FLUVION_DRIVER_MEMORY", "8g"))
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
    )
    for key, value in extra.items():
        builder = builder.config(key.replace("__", "."), value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return use_utc(spark)


def use_utc(spark: SparkSession) -> SparkSession:
    """All instants are UTC; a session in another zone would move every day boundary."""
    if spark.conf.get("spark.sql.session.timeZone") != "UTC":
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


_MADE: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors can reach, as the cluster names it in ``spark.checkpoint.dir``.

    A session on one machine that names none gets a folder of its own, removed when the driver ends; on a
    cluster a missing setting is an error, because no folder of the driver is seen by the executors.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    sc = spark.sparkContext
    if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    if sc.applicationId not in _MADE:
        _MADE[sc.applicationId] = made = tempfile.mkdtemp(prefix="fluvion-")
        atexit.register(shutil.rmtree, made, ignore_errors=True)
    return _MADE[sc.applicationId]


def staged(df: DataFrame, label: str) -> DataFrame:
    """Write a reduced intermediate once to the shared folder and read it back.

    For results that several branches of one plan need: the wide scan behind them runs once, the
    branches prune columns from Parquet, and a lost executor costs a re-read, not a recomputation.
    """
    path = f"{shared_dir(df.sparkSession)}/staged/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
