"""Connected components by alternating stars: distributed union-find with DataFrame operations only.

Edges shrink towards stars around each component's least node, in a number of rounds that grows with the logarithm of the
longest path. A node with very many neighbours costs partial minima and a join that AQE can split, never one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lithic.llm.common import stage, unstage


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = stage(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "cc-least")
    out = both.where(F.col("v") > F.col("u")).join(least, "u").where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
    done = stage(out, "cc-large")
    unstage(least)
    return done


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = stage(down.groupBy("u").agg(F.min("v").alias("m")), "cc-least")
    out = down.join(least, "u").where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).distinct()
    done = stage(out, "cc-small")
    unstage(least)
    return done


def _stars(edges: DataFrame) -> bool:
    """Every node points to one centre at most, and no centre points further: nothing is left to do."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("centre")).unionByName(edges.select(F.col("v").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("centre")))
    return ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("centre").alias("centre")).where("up > 1 OR (up > 0 AND centre > 0)").isEmpty()


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of each node that an edge (u, v) touches; a component is named by its least node."""
    now = stage(edges.where(F.col("u") != F.col("v")).select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "cc-edges")
    while not _stars(now):
        large = _large_star(now)
        small = _small_star(large)
        unstage(large)
        unstage(now)
        now = small
    out = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return out.unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
