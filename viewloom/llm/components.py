"""Connected components by alternating large-star and small-star rounds, as joins and aggregations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, written


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is linked to the smallest node of the neighbourhood, the node included."""
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.filter(F.col("v") > F.col("u")).join(least, "u").select(F.col("m").alias("a"), F.col("v").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Every smaller neighbour of a node, and the node, are linked to the smallest of them."""
    down = edges.select(F.col("b").alias("u"), F.col("a").alias("v"))  # v < u
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    near = down.join(least, "u").filter(F.col("v") != F.col("m")).select(F.col("m").alias("a"), F.col("v").alias("b"))
    return near.union(least.select(F.col("m").alias("a"), F.col("u").alias("b")))


def _mark(edges: DataFrame) -> tuple:
    r = edges.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("x")).first()
    return r["n"], r["x"]


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of the edges (a, b), as a written table; root is the smallest node that it reaches.

    A round halves the distances, so the number of rounds follows the logarithm of the largest component. Only
    joins, whose hot keys can be split, and aggregations that combine before the shuffle are used.
    """
    ordered = edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter(F.col("a") < F.col("b")).distinct()
    now = written(ordered, "edges")
    mark = _mark(now)
    while mark[0]:
        nxt = written(_small_star(_large_star(now).distinct()).distinct(), "edges")
        new = _mark(nxt)
        discard(now)
        now = nxt
        if new == mark:
            break
        mark = new
    roots = now.select(F.col("b").alias("node"), F.col("a").alias("root"))
    out = written(roots.union(now.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct()), "roots")
    discard(now)
    return out
