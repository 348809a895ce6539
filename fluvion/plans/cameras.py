"""Flood evidence of viewpoints, and zones that touch a basin's box."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

# Fixed values.
RIVER_WORDS = ("river", "slough", "creek")
STEM_NEAR_M, STEM_EVIDENCE_M, STEM_REPORT_M = 400, 600, 5000


def evidence(cameras: DataFrame, words: tuple[str, ...] = RIVER_WORDS) -> DataFrame:
    """Reasons and tier of each viewpoint.

    Distances count as they are told, in tens of metres. ``cameras``: title, at_gauge, stem_m (distance to the mainstem), floodway (true inside a
    floodway, false inside a floodplain only, null outside both).
    """
    named = F.lit(False)
    for w in words:
        named = named | F.contains(F.lower("title"), F.lit(w))
    stem = F.round("stem_m", -1)
    near = F.coalesce(stem < STEM_NEAR_M, F.lit(False))
    floodway, zone = F.coalesce("floodway", F.lit(False)), F.col("floodway").isNotNull()
    reasons = F.array_compact(F.array(
        F.when(F.col("at_gauge"), "at_usgs_gauge"), F.when(named, "river_named_in_camera_title"),
        F.when(F.col("stem_m") < STEM_REPORT_M, F.format_string("%.0f_m_from_mainstem_river", stem)),
        F.when(floodway, "inside_floodway").when(zone, "inside_1pct_floodplain"),
    ))
    tier = F.when(F.col("at_gauge") | (named & near) | floodway, "A").when(zone | near | named, "B").otherwise("C")
    seen = F.col("at_gauge") | zone | F.coalesce(stem <= STEM_EVIDENCE_M, F.lit(False))
    return cameras.withColumn("reasons", reasons).withColumn("tier", tier).withColumn("evidenced", seen)


def zones_touching(paths: DataFrame, boxes: DataFrame, path_id: str, cell: float) -> DataFrame:
    """(box, path) pairs with any vertex of the path inside the box.

    Vertices and boxes meet on grid cells, never all against all.
    """
    c = lambda v: F.floor(v / cell).cast("int")
    v = paths.select(*[x for x in paths.columns if x != "path"], F.explode("path").alias("p")).withColumns({"_cx": c(F.col("p.x")), "_cy": c(F.col("p.y"))})
    b = boxes.withColumn("_cx", F.explode(F.sequence(c(F.col("west")), c(F.col("east"))))).withColumn("_cy", F.explode(F.sequence(c(F.col("south")), c(F.col("north")))))
    hit = v.join(b, ["_cx", "_cy"]).filter(F.col("p.x").between(F.col("west"), F.col("east")) & F.col("p.y").between(F.col("south"), F.col("north")))
    keep = [x for x in paths.columns if x not in ("path", path_id)]
    return hit.groupBy("box", path_id).agg(*[F.first(x).alias(x) for x in keep])
