"""Connected components of an edge table by alternating large-star and small-star rounds.

Every round is joins and grouped minima over the edges; a vertex's minimum is combined before the shuffle and the join of
a hot vertex with its minimum is one that Spark splits. The edges of each round are written to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Each vertex links its larger (or, small star, its other) neighbours to the least vertex around it."""
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    # as a table of its own: Spark splits a hot vertex only in a join whose two sides are both shuffled for it
    least = written(both.groupBy(F.col("a").alias("c")).agg(F.min("b").alias("m")).select("c", F.least("c", "m").alias("m")))
    near = both.join(least, both["a"] == least["c"])
    if large:
        out = near.where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = near.select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select(F.col("c").alias("a"), F.col("m").alias("b")))
    return out.where(F.col("a") != F.col("b")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(vertex, label) of every vertex of edges (a, b): label is the least vertex of its component.

    Self-links and repeated links change nothing; no edges give no rows.
    """
    now = written(edges.select("a", "b").where(F.col("a") != F.col("b")))
    while True:
        then = written(_star(_star(now, large=True), large=False))
        # a star forest, every leaf linked to its least vertex, is a fixed point
        centres, leaves = then.select(F.col("b").alias("v")), then.select(F.col("a").alias("v"))
        twice = then.groupBy("a").agg(F.count("*").alias("n")).where("n > 1").isEmpty()
        if twice and centres.join(leaves, "v", "left_semi").isEmpty():
            break
        now = then
    return then.select(F.col("a").alias("vertex"), F.col("b").alias("label")).union(then.select("b", "b").distinct())
