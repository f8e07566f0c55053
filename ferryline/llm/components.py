"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import drop_path, materialize


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))


def _large_star(edges: DataFrame) -> DataFrame:
    near = _both_ways(edges)
    least = near.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
    return near.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """Label every vertex of ``edges(u long, v long)`` with the least vertex it reaches.

    Returns (vertex long, component long), one row per vertex that has an edge to another vertex.
    Edges with a null end and self-loops are ignored; repeated edges count once; an empty input gives
    an empty result. Only edge lists move between stages, every step starts from a written table, and
    minima are combined before the shuffle, so a vertex with very many edges does not fill one task.
    The steps end when two successive edge lists are equal (same count and same sum of hashes).
    """
    spark = edges.sparkSession
    # A step reads its edges twice; what finds them runs once.
    clean, clean_path = materialize(edges.select(F.col("u").cast("long").alias("u"), F.col("v").cast("long").alias("v")).where("u <> v"), "edges")
    current, path = materialize(_small_star(clean), "star")
    drop_path(spark, clean_path)
    seen = None
    while True:
        after, next_path = materialize(_small_star(_large_star(current)), "star")
        drop_path(spark, path)
        current, path = after, next_path
        sign = tuple(after.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if sign == seen:
            return current.select(F.col("u").alias("vertex"), F.col("v").alias("component")).unionByName(
                current.select(F.col("v").alias("vertex"), F.col("v").alias("component")).distinct()
            )
        seen = sign
