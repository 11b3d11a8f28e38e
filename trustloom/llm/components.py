"""Connected components of a table of links, by alternating star contractions.

Each round joins every node's neighbours to the smallest of them, first the
larger ones, then the smaller ones; the number of rounds grows with the
logarithm of the longest path.  Rounds are written to the shared folder, so a
lost executor costs one round.  Minima are combined before they shuffle and
the joins are left to adaptive skew splitting, so a hub of any degree is dealt
to many tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trustloom.llm._shared import written


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select("b", "a")).toDF("u", "v")
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").where("v <> m").select(F.col("v").alias("a"), F.col("m").alias("b"))
    return moved.union(least.select(F.col("u").alias("a"), F.col("m").alias("b"))).distinct()


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, component) of every node in the columns a and b; the component is its smallest node."""
    edges = written(edges.where("a <> b").select("a", "b").distinct(), "links")
    mark = None
    for _ in range(most_rounds):
        edges = written(_small_star(_large_star(edges)), "links")
        found = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if found == mark or not found[0]:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).union(edges.select(F.col("b"), F.col("b")).distinct())
        mark = found
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")
