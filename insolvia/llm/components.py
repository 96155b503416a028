"""Connected components by alternating large-star and small-star steps, nothing on the driver but counts."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize


def connected_components(links: DataFrame) -> DataFrame:
    """node and part (the smallest node reachable) of every node of the links (a, b).

    Every round points nodes at smaller ones of their neighbourhood; the minima are joined back to the
    links, so a node with a third of all links is one row on the joined side and its links can be split.
    """
    edges = materialize(links.where("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links")
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        # large star: every larger neighbour of u is linked to u's smallest
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        # small star: u and its smaller neighbours are linked to the smallest of them
        small = large.join(least, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v")
        edges = materialize(small.where("u != v").distinct(), "links")
        # A star forest maps to itself; the number and sum of links tell when nothing moves any more.
        now = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == before:
            roots = edges.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("part"))
            return edges.select(F.col("u").alias("node"), F.col("v").alias("part")).unionByName(roots)
        before = now
