"""Connected components of an edge table, by repeated joins on Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanworks.workdir import materialize


def join_dealt_anew(left: DataFrame, right: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """Join on a whole-number key to an aggregate by that key.

    An aggregate keeps its partitioning, and adaptive execution splits a large key only
    between two fresh exchanges; joining on the complement of the key asks for them.
    """
    right = right.withColumn("_dealt", F.bitwise_not(key)).drop(key)
    return left.withColumn("_dealt", F.bitwise_not(key)).join(right, "_dealt", how).drop("_dealt")


def _toward_least(edges: DataFrame, larger_only: bool) -> DataFrame:
    """Connects the neighbours of each node to the least of its neighbours and itself."""
    if larger_only:
        both = edges.select("u", "v").unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        both = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("least"))
    joined = join_dealt_anew(both, least, "u")
    if larger_only:
        out = joined.where("v > u").select(F.col("v").alias("u"), F.col("least").alias("v"))
    else:
        out = joined.select("u", F.col("least").alias("v")).unionAll(joined.select(F.col("v").alias("u"), F.col("least").alias("v")))
    return out.where("u <> v").distinct()


def _is_star_forest(edges: DataFrame) -> bool:
    """Whether every node is either the end of edges alone or the start of one edge alone."""
    nodes = edges.select(F.col("u").alias("node"), F.lit(1).alias("starts"), F.lit(0).alias("ends")).unionAll(
        edges.select(F.col("v").alias("node"), F.lit(0), F.lit(1)))
    per_node = nodes.groupBy("node").agg(F.sum("starts").alias("starts"), F.max("ends").alias("ends"))
    return per_node.where("starts > 1 or (starts > 0 and ends > 0)").isEmpty()


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node reachable over ``edges`` (u, v), for nodes with an edge.

    Alternates between linking larger and linking smaller neighbours to the least one
    until every component is a star around its least node. The number of rounds grows
    with the logarithm of the longest path. Only one truth value a round reaches the driver.
    """
    edges = edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    edges = materialize(edges, "edges")
    while not _is_star_forest(edges):
        edges = materialize(_toward_least(_toward_least(edges, True), False), "edges")
    stars = edges.select("u", F.col("v").alias("component"))
    return stars.withColumnRenamed("u", "node").unionAll(stars.select(F.col("component").alias("node"), "component").distinct())
