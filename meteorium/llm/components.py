"""Connected components of an edge table by alternating star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize, release


def _star(pairs: DataFrame, larger: bool) -> DataFrame:
    """Each node's neighbours (the larger ones, or the smaller ones and itself) are tied to the least node in its sight."""
    both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v"))) if larger else pairs
    least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
    tied = both.join(least, "u")
    if larger:
        out = tied.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = tied.filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return out.filter("u != v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """node, component (the least node of the component) for every node of an edge (u, v); edges may stand either way round.

    Minima are combined before each shuffle, and a node with very many edges only meets them in a join that Spark can split.
    """
    now = materialize(edges.filter("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    mark = None
    while True:
        seen = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if seen == mark:
            return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
                now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
        mark = seen
        before, now = now, materialize(_star(_star(now, True), False))
        release(now.sparkSession, before)
