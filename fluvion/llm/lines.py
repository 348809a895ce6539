"""Line deduplication by the number of distinct sites a line is seen on.

Lines are hashed; a HyperLogLog sketch of the sites of each hash is merged by aggregation. Lines whose
estimate is far from the limit are decided by it; those within the margin get an exact distinct count.
Of a line that reaches the limit (cross-site boilerplate) one occurrence stays, in the smallest doc_id at
the first position; all others are removed, so that text which was only copied is not lost.

Sketches and counts are combined map-side, so a line on every page is one row per task. Documents are
shuffled once, by their key, to meet the positions to be removed.

Defined results: null text counts as empty and comes back empty; lines end at ``\\n`` and are compared
after trimming blanks, tabs and other ASCII white space; blank lines are never removed. Null sites are not counted. Rows with equal
doc_id and text are treated alike; of equal lines under null ids the first position stays.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from fluvion.llm.common import let, staged, text_or_empty

MIN_SITES = 8
LG_K, MARGIN = 10, 0.15  # standard error of the sketch is 0.026 at most; the margin is over five of it

_SPACE = " \t\r\x0b\x0c"


def split_lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def line_keys(text: Column) -> Column:
    """Hash of each line of a text, null for blank ones: two 64-bit hashes, so that no two lines meet by chance."""
    trimmed = lambda line: F.btrim(line, F.lit(_SPACE))
    return F.transform(split_lines(text), lambda line: let(trimmed(line), lambda t: F.when(t != "", F.struct(F.xxhash64(t).alias("h1"), F.xxhash64(t, F.lit(1)).alias("h2")))))


def _keyed(docs: DataFrame, site: str) -> DataFrame:
    text = text_or_empty()
    return docs.select("doc_id", F.xxhash64(text).alias("_text"), F.col(site).cast("string").alias("site"), F.posexplode(line_keys(text)).alias("pos", "line")).where("line is not null").select("doc_id", "_text", "site", "pos", F.col("line.h1").alias("h1"), F.col("line.h2").alias("h2"))


def boilerplate(lines: DataFrame, min_sites: int = MIN_SITES, lg_k: int = LG_K, margin: float = MARGIN) -> DataFrame:
    """(h1, h2): the lines seen on at least ``min_sites`` distinct sites."""
    spread = lines.groupBy("h1", "h2").agg(F.hll_sketch_agg("site", lg_k).alias("sketch")).select("h1", "h2", F.hll_sketch_estimate("sketch").alias("sites"))
    # the margin is at least one site wide
    band = max(1.0, min_sites * margin)
    candidates = staged(spread.where(F.col("sites") >= min_sites - band), "line-candidates")
    near = candidates.where(F.col("sites") <= min_sites + band).select("h1", "h2")
    exact = lines.join(near, ["h1", "h2"]).select("h1", "h2", "site").distinct().groupBy("h1", "h2").agg(F.count("site").alias("n")).where(F.col("n") >= min_sites)
    return candidates.where(F.col("sites") > min_sites + band).select("h1", "h2").union(exact.select("h1", "h2"))


def removals(docs: DataFrame, site: str = "source", min_sites: int = MIN_SITES) -> DataFrame:
    """(doc_id, _text, drop): positions of the lines to be removed from the documents that have any."""
    lines = _keyed(docs, site)
    common = staged(boilerplate(lines, min_sites), "boilerplate")
    seen = staged(lines.join(common, ["h1", "h2"]).select("h1", "h2", "doc_id", "_text", "pos"), "boilerplate-lines")
    order = F.struct(F.col("doc_id").isNull().alias("n"), F.col("doc_id").alias("d"), F.col("_text").alias("t"), F.col("pos").alias("p"))
    # one row per boilerplate line, written so that its size decides how it meets the lines
    first = staged(seen.groupBy("h1", "h2").agg(F.min(order).alias("first")), "first-lines")
    extra = seen.join(first, ["h1", "h2"]).where(~order.eqNullSafe(F.col("first")))
    return extra.groupBy("doc_id", "_text").agg(F.collect_set("pos").alias("drop"))


def deduplicated(docs: DataFrame, site: str = "source", min_sites: int = MIN_SITES) -> DataFrame:
    """``docs`` with the removed lines gone from ``text``, and ``n_lines`` and ``n_removed``."""
    gone = removals(docs, site, min_sites)
    text = text_or_empty()
    base = docs.withColumn("_text", F.xxhash64(text))
    joined = base.join(gone.withColumnsRenamed({"doc_id": "_doc", "_text": "_key"}), F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("_text") == F.col("_key")), "left")
    lines = split_lines(text)
    left = F.array_join(F.filter(F.transform(lines, lambda line, i: F.when(~F.array_contains("drop", i), line)), lambda line: line.isNotNull()), "\n")
    kept = F.when(F.col("drop").isNull(), text).otherwise(left)
    others = [F.col(f"`{c}`") if c != "text" else kept.alias("text") for c in docs.columns]
    return joined.select(*others, F.size(lines).cast("long").alias("n_lines"), F.coalesce(F.size("drop"), F.lit(0)).cast("long").alias("n_removed"))
