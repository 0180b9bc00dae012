"""Connected components of an edge table by alternating large and small stars; each round is a table in the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .common import remove, written


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """large: a node's larger neighbours link to the least of its neighbourhood. small: its smaller neighbours and itself do."""
    if large:
        near = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        near = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = near.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("k"), F.least("u", "m").alias("m"))
    linked = near.join(least, F.col("u") == F.col("k"))
    if large:
        out = linked.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = linked.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select(F.col("k").alias("u"), F.col("m").alias("v")))
    return out.where("u <> v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """edges (u, v): (node, component) for every node that has an edge; component is the least node in it."""
    now, seen = written(edges.where("u <> v").select("u", "v").distinct(), "edges"), None
    while True:
        new = written(_star(_star(now, True), False), "stars")
        state = new.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        remove(now)
        now = new
        if state == seen:
            break
        seen = state
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(now.select("v", "v").distinct())
