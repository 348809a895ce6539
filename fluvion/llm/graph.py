"""Connected components over an edge table, by alternating star contraction.

Every round only groups by node with a minimum (combined map-side) and joins the minimum back, so a
hub costs no more memory than any other node and its join is split by adaptive execution. Each round
is written to the shared folder; no links and no components ever reach the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from fluvion.llm.common import staged


def _digest(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
    return row["n"], row["h"]


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    # written, so that the join reads two plain shuffles, of which a hub's rows can be split; else they would stay where the minimum was taken
    least = staged(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")), "least")
    return both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    moved = down.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.union(least.select("a", F.col("m").alias("b"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node reachable from each node that has an edge.

    ``edges`` has two long columns ``a`` and ``b``; order and repetition do not matter, loops and
    nulls are ignored. Nodes without an edge are absent: they are their own root.
    """
    now = staged(edges.select("a", "b").where("a <> b").distinct(), "edges")
    before = _digest(now)
    while before[0]:
        now = staged(_small_star(_large_star(now)), "stars")
        after = _digest(now)
        if after == before:
            break
        before = after
    return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
