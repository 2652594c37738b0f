"""Connected components of a graph given as edges, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxelweave.session import Scratch


def _print(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of the edges (a, b); a component's name is its smallest node.

    Minima are partial aggregates and neighbours are never gathered, so a node with very many edges is no hot
    spot. Each round's edges are written to the shared folder, and those of the round before deleted. Self loops and repeated edges are allowed.
    """
    scratch, rounds = Scratch(edges.sparkSession, "components"), 0
    e = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    e = scratch.keep(e, "0")
    seen = _print(e)
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        lowest = large.groupBy("u").agg(F.min("v").alias("m"))
        linked = large.join(lowest, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        rounds += 1
        e = scratch.keep(linked.unionByName(lowest.select("u", F.col("m").alias("v"))).distinct(), str(rounds))
        scratch.drop(str(rounds - 1))
        now = _print(e)
        if now == seen:
            break
        seen = now
    own = e.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return own.unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
