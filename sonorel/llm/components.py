"""Connected components of a large graph by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sonorel.llm.common import drop_table, materialize


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """Links neighbours to the smallest neighbour: larger neighbours (large), or smaller ones and the vertex itself. The smallest is aggregated within tasks first, then joined, so a hub's links are never gathered."""
    if large:
        both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        return both.where("b > a").join(least, "a").select(
            F.col("b").alias("a"),
            F.col("m").alias("b"),
        ).where("a <> b").distinct()
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    joined = down.join(least, "a")
    return joined.select(
        F.col("b").alias("a"),
        F.col("m").alias("b"),
    ).union(least.select("a", F.col("m").alias("b"))).where("a <> b").distinct()


def _settled(edges: DataFrame) -> bool:
    """Whether links (a > b) are stars about the smallest of each component: each a has one link, and no b has any."""
    ends = edges.select(F.col("a").alias("v"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(
        edges.select("b", F.lit(0), F.lit(1))
    )
    degrees = ends.groupBy("v").agg(F.sum("up").alias("up"), F.sum("down").alias("down"))
    return degrees.where("up > 1 or (up > 0 and down > 0)").count() == 0


def components(edges: DataFrame) -> DataFrame:
    """a, b: each vertex of an edge that isn't the smallest of its component, and that smallest. No edges, no rows.

    Each star is written before the next reads it. The small star reads its links three times, so one plan of both holds
    the large star three times, with all its exchanges and broadcasts, which the driver keeps."""
    spark = edges.sparkSession
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    now = materialize(down.where("a <> b").distinct(), "edges")
    while not _settled(now):
        for large in (True, False):
            new = materialize(_stars(now, large), "stars")
            drop_table(spark, now)
            now = new
    return now
