"""Connected components by alternating large-star and small-star."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skipscan.llm.common import discard, materialize, measured


def _large_star(edges: DataFrame) -> DataFrame:
    """Each larger neighbour of u is linked with the least of u's neighbours and u."""
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """u and each of its smaller neighbours are linked with the least of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v")
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of edges (u, v), component being its least
    node, as a table. Each round is a table in the shared folder, so a lost executor costs a
    round at most; it ends when a round changes no edge. Self-links are ignored."""
    edges, before = measured(edges.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges", "u", "v")
    while before[0]:
        last = edges
        edges, now = measured(_small_star(_large_star(edges)), "edges", "u", "v")
        discard(last)
        if now == before:
            break
        before = now
    stars = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    out = materialize(stars.unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()), "components")
    discard(edges)
    return out
