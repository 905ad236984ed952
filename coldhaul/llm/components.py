"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from coldhaul.llm.common import stored


def _around(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return both.where("u <> v")


def _large_star(edges: DataFrame) -> DataFrame:
    near = _around(edges)
    least = near.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return near.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v")
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    own = least.select("u", F.col("m").alias("v"))
    return moved.unionByName(own).where("u <> v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(u, component) for every vertex that has an edge and is not the least of its component.

    Each round is written to the scratch folder; the number of rounds grows with the
    logarithm of the longest path, not with the size of a component.
    """
    now = stored(edges.select("u", "v").where("u <> v").distinct(), "edges")
    state = None
    while True:
        now = stored(_small_star(_large_star(now)), "edges")
        found = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(found) == state:
            return now.select("u", F.col("v").alias("component"))
        state = tuple(found)
