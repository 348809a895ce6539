"""Keyed tables that streams keep current: runs of changed rows, merged as they grow, read by version.

A micro-batch reads the rows of its own keys as the batches before it left them and adds one run with what it
changed. A run is a folder divided by month and by a hash of the key, so that a lookup opens only the places that the
batch's own rows fall in: one late row adds one place, not the time between. A version is a manifest, one row per run, written last;
a batch that is run again writes the same folders and the same manifest. Runs are merged when the newer ones have
grown to half of an older one, as digits of a counter carry over: a table of n rows has about log n runs and a row is rewritten about
log n times. Earlier versions stay readable, as folders of merged runs are not removed.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from fluvion.operators.revisions import matching

BUCKETS = 8
GROWTH = 2
NO_MONTH = "all"


class KeyedTable:
    """The newest row of each key.

    ``schema`` names keys and values; ``places`` are the key columns whose hash divides the table (all keys if
    not given) and ``instant`` the key column whose month does, if any.
    """

    def __init__(self, spark: SparkSession, path: str, schema: str, keys: Sequence[str], instant: str | None = None, places: Sequence[str] | None = None, buckets: int = BUCKETS):
        self.spark, self.path, self.keys, self.instant, self.buckets = spark, path, list(keys), instant, buckets
        self.places = list(places or [k for k in keys if k != instant] or keys)
        self.schema = spark.createDataFrame([], schema).schema
        self.values = [f.name for f in self.schema if f.name not in self.keys]

    def month(self) -> Column:
        # one folder for rows without an instant
        return F.lit(NO_MONTH) if self.instant is None else F.coalesce(F.date_format(self.instant, "yyyy-MM"), F.lit(NO_MONTH))

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.places), F.lit(self.buckets)).cast("int")

    def touched(self, rows: DataFrame, *shifts: str) -> list[tuple[str, int]]:
        """The places of rows, and of rows moved by the given intervals: at most months times buckets."""
        moved = [rows] + [rows.withColumn(self.instant, F.col(self.instant) + F.expr(f"interval {s}")) for s in shifts]
        found = [x.select(self.month().alias("m"), self.bucket().alias("b")) for x in moved]
        for more in found[1:]:
            found[0] = found[0].union(more)
        return [tuple(x) for x in found[0].distinct().collect()]

    def runs(self, version: int) -> list[tuple[str, int]]:
        """(folder, rows) of the runs of a version, oldest first; a version before the first batch has none."""
        if version < 0:
            return []
        rows = self.spark.read.schema("at int, run string, n long").json(f"{self.path}/versions/batch={version}").collect()
        return [(r["run"], r["n"]) for r in sorted(rows) if r["run"]]

    def _rows(self, runs: Sequence[tuple[str, int]], places: Sequence[tuple[str, int]] | None = None) -> DataFrame:
        columns = [*self.schema.names, "removed", "at_batch"]
        kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in self.schema)
        full = f"{kinds}, removed boolean, at_batch int, run string, month string, bucket int"
        if not runs:
            return self.spark.createDataFrame([], full).select(*columns)
        base = f"{self.path}/rows"
        rows = self.spark.read.schema(full).option("basePath", base).parquet(*[f"{base}/run={name}" for name, _ in runs])
        if places is not None:
            by_month: dict[str, list[int]] = {}
            for m, b in places:
                by_month.setdefault(m, []).append(b)
            inside = F.lit(False)
            for m, b in sorted(by_month.items()):
                inside = inside | ((F.col("month") == m) & F.col("bucket").isin(b))
            rows = rows.filter(inside)
        return rows.select(*columns)

    def _newest(self, rows: DataFrame) -> DataFrame:
        kept = F.max_by(F.struct(*self.values, "removed", "at_batch"), "at_batch").alias("_s")
        return rows.groupBy(*self.keys).agg(kept).select(*self.keys, *[F.col(f"_s.{c}").alias(c) for c in (*self.values, "removed", "at_batch")])

    def current(self, version: int, places: Sequence[tuple[str, int]] | None = None) -> DataFrame:
        """The table as a version left it, or only its given places."""
        runs = self.runs(version)
        return self._newest(self._rows(runs, places)).filter("NOT removed").select(*self.schema.names)

    def lookup(self, rows: DataFrame, version: int) -> DataFrame:
        """The rows of a version whose key is among ``rows``; a null in a key equals a null."""
        return matching(self.current(version, self.touched(rows)), rows, self.keys, "left_semi")

    def _write(self, rows: DataFrame, name: str) -> list[tuple[str, int]]:
        """The run, if it has any rows."""
        placed = rows.withColumns({"month": self.month(), "bucket": self.bucket()})
        placed.hint("rebalance", "month", "bucket").write.mode("overwrite").partitionBy("month", "bucket").parquet(f"{self.path}/rows/run={name}")
        n = self._rows([(name, 0)]).count()
        return [(name, n)] if n else []

    def written(self, batch_id: int) -> DataFrame:
        """The rows a batch has committed, without those it removed."""
        return self._rows([(f"{batch_id:08d}", 0)]).filter("NOT removed").select(*self.schema.names)

    def latest(self) -> int:
        """The newest version, -1 if there is none."""
        try:
            newest = self.spark.read.schema("at int, batch int").json(f"{self.path}/versions").agg(F.max("batch")).first()[0]
        except AnalysisException as missing:
            if missing.getCondition() != "PATH_NOT_FOUND":
                raise
            newest = None
        return -1 if newest is None else newest

    def commit(self, changed: DataFrame, batch_id: int, removed: DataFrame | None = None) -> None:
        """Version ``batch_id``: the version before it with these rows new or changed, and the keys in ``removed`` gone.

        ``changed`` has one row per key, and no key is in both.
        """
        rows = changed.select(*self.schema.names, F.lit(False).alias("removed"))
        if removed is not None:
            gone = [F.lit(None).cast(self.schema[c].dataType).alias(c) if c in self.values else F.col(c) for c in self.schema.names]
            rows = rows.unionByName(removed.select(*gone, F.lit(True).alias("removed")))
        mine = self._write(rows.withColumn("at_batch", F.lit(batch_id)), f"{batch_id:08d}")
        runs = self.runs(batch_id - 1) + mine
        if mine:
            first, total = len(runs) - 1, mine[0][1]
            while first and runs[first - 1][1] <= GROWTH * total:
                first -= 1
                total += runs[first][1]
            if first < len(runs) - 1:
                merged = self._newest(self._rows(runs[first:]))
                # what is gone needs no trace in the oldest run
                merged = merged.filter("NOT removed") if first == 0 else merged
                runs[first:] = self._write(merged, f"{batch_id:08d}-merged")
        rows = [(i, name, n) for i, (name, n) in enumerate(runs)] or [(0, None, 0)]
        self.spark.createDataFrame(rows, "at int, run string, n long").coalesce(1).write.mode("overwrite").json(f"{self.path}/versions/batch={batch_id}")
