"""Connected components by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import few_files


def _minima(near: DataFrame) -> DataFrame:
    """Smallest label next to each vertex of ``near(u, v)``, the vertex itself included."""
    return near.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))


def components(edges: DataFrame) -> DataFrame:
    """Smallest vertex reachable from each vertex of ``edges(a, b)``: v, component.

    Every round is written to the shared folder. A vertex with many edges is a hot join key, which
    AQE splits; no neighbour list is ever gathered. Vertices without edges do not occur.
    """
    e = few_files(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "edges")
    before = None
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # Large star: larger neighbours move to the smallest label around u.
        large = both.join(_minima(both), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = few_files(large, "large_star")
        # Small star: smaller neighbours and u itself move to the smallest of them.
        low = _minima(large)
        small = (large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .unionByName(low.select("u", F.col("m").alias("v"))).where("u <> v").distinct())
        e = few_files(small, "small_star")
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if now == before:
            # Stars only: every vertex but the roots points to its root.
            return e.select(F.col("u").alias("v"), F.col("v").alias("component")).unionByName(e.select(F.col("v"), F.col("v").alias("component")).distinct())
        before = now
