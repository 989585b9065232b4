"""Connected components of a table of links, by alternating star contractions; nothing but a checksum leaves Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flintsieve.llm.common import discard, written


def components(links: DataFrame) -> DataFrame:
    """(node, root) of every node of the links (columns a and b of integers); root is the smallest node reachable.

    Each round points all larger neighbours of a node to its smallest one (large star), then all smaller ones too
    (small star). Minima are combined before the shuffle, so a node with very many links is no burden; each round is
    written to the shared folder, which cuts lineage and keeps it when executors are lost, and the last one is deleted.
    """
    edges = links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    edges, seen = written(edges, "links"), None
    while True:
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == seen or not state[0]:
            break
        seen = state
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        small = large.groupBy("u").agg(F.min("v").alias("m"))
        last, edges = edges, written(large.join(small, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(small.select("u", F.col("m").alias("v"))).distinct(), "links")
        discard(last)
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
