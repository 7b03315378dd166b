"""Connected components of a graph given as edges, by minimum labels over written tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.session import released, removed, stored


def components(edges: DataFrame, folder: str) -> DataFrame:
    """node, root (its component's least node) for each node of ``edges`` (a, b: long).

    Alternates large-star and small-star steps (Kiveris et al., SoCC 2014) until no edge
    changes; every step's edges are a table, so lineage stays short. A star step sends
    each node's least neighbour to its neighbours: rows stay as many as the edges,
    and the sum that tells whether anything changed is all that reaches the driver.
    """
    spark = edges.sparkSession
    current = stored(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), f"{folder}/small0")
    before, step = None, 0
    while True:
        # large star: each larger neighbour of a node goes to the least of the node and its neighbours
        both = current.unionByName(current.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.hint("merge").join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        large = stored(large, f"{folder}/large{step}")
        # small star: a node's smaller neighbours and the node itself go to the least of them
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.hint("merge").join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b"))).distinct()
        step += 1
        current = stored(small, f"{folder}/small{step}")
        removed(spark, f"{folder}/large{step - 1}", f"{folder}/small{step - 1}")
        released(spark)  # or the shuffles of all steps lie on disk together
        now = tuple(current.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if now == before:
            break
        before = now
    return current.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(current.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
