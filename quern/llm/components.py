"""Connected components of an edge table, by alternating large and small stars.

Each round points every node's neighbours to the least node among them. Rounds are joins and grouped minima, so
a hub with a third of the edges is a large equi-join partition that Spark splits, never one group
in memory. Their number grows with the logarithm of the longest chain. Each round is checkpointed, so lost
executors cost a round at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.common import cut, release


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of `edges` (a, b); root is the least node of its component. Rounds go on until every component is a star."""
    now = cut(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    while not _is_forest_of_stars(now):
        now = cut(_small_star(_large_star(now)))
        release(now.sparkSession)
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(now.select("b", "b").distinct())


def _is_forest_of_stars(edges: DataFrame) -> bool:
    """Whether every child has one parent, and no parent is a child."""
    ends = edges.select(F.col("a").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(edges.select("b", F.lit(0), F.lit(1)))
    return ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down")).filter("up + down > 1 and up > 0").isEmpty()


def _large_star(edges: DataFrame) -> DataFrame:
    """Every greater neighbour v of u is tied to the least of u and its neighbours."""
    both = edges.union(edges.select("b", "a"))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), F.least("a", "m").alias("m"))
    return both.join(least, F.col("a") == F.col("u")).filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b")


def _small_star(edges: DataFrame) -> DataFrame:
    """u and its lesser neighbours are tied to the least of them; edges have a > b."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    others = edges.join(least.withColumnRenamed("a", "u"), F.col("a") == F.col("u")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    return others.union(least.select("a", F.col("m").alias("b"))).filter("a <> b").distinct()
