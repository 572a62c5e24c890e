"""Connected components of an edge list, by joins and aggregates only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed


def star(edges: DataFrame, large: bool) -> DataFrame:
    """One star step over edges(a, b), b < a: every node's neighbours move to its smallest one. The result has b < a, and may repeat edges.

    large: of each node, the larger neighbours; else each node with its smaller
    neighbours. The smallest neighbour is found with map-side combine and joined
    back; a node with very many neighbours is a skewed join that Spark's adaptive
    execution splits, as an exchange follows.
    """
    back = F.struct(F.col("b").alias("a"), F.col("a").alias("b"))
    both = edges.select(F.inline(F.array(F.struct("a", "b"), back))) if large else edges
    low = both.groupBy("a").agg(F.min("b").alias("low")).select("a", F.least("a", "low").alias("low"))
    if large:
        return edges.select(F.col("b").alias("a"), F.col("a").alias("b")).join(low, "a").select(F.col("b").alias("a"), F.col("low").alias("b"))
    # the smallest neighbour itself stays with its node
    return edges.join(low, "a").select(F.when(F.col("b").eqNullSafe(F.col("low")), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("low").alias("b"))


def uneven(edges: DataFrame) -> bool:
    """Whether any node of edges(a, b) has two smaller neighbours, or a smaller and a larger one. If none has, each edge is a node and its component."""
    ends = edges.select(F.inline(F.array(F.struct(F.col("a").alias("node"), F.lit(True).alias("over")), F.struct(F.col("b").alias("node"), F.lit(False).alias("over")))))
    return bool(ends.groupBy("node").agg(F.count_if("over").alias("over"), F.count(F.lit(1)).alias("n")).where("over > 1 or over = 1 and n > 1").head(1))


def connected_components(edges: DataFrame) -> DataFrame:
    """edges(a, b) of any orderable type -> node, component: the smallest node reachable.

    Distributed union-find by alternating large and small stars until nothing but
    stars is left; one checkpoint a round, some log of the longest path rounds. Null
    ends and loops are left out; nodes without an edge have no row.
    """
    now = checkpointed(edges.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    while uneven(now):
        now = checkpointed(star(star(now, True), False).distinct())
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
