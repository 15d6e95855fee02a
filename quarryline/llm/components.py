"""Connected components of an edge table, by alternating large-star and small-star steps.

Each step is a minimum per node and a join, so a node with very many edges is summed before
the shuffle and its join can be split; each round is written to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarryline.llm.common import discard, materialize


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Large: larger neighbours of u move to u's least neighbour. Small: smaller ones and u itself."""
    if large:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        out = both.where(F.col("b") > F.col("a")).join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        least = edges.groupBy("a").agg(F.min("b").alias("m"))
        moved = edges.join(least, "a")
        out = moved.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
    return out.where(F.col("a") != F.col("b")).distinct()


def _finished(edges: DataFrame) -> bool:
    """Whether every edge leads from a node with no other edge to the least node of its component."""
    ends = edges.select(F.col("a").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down"))
    ends = ends.unionByName(edges.select(F.col("b").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    return ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where((F.col("up") > 1) | ((F.col("up") > 0) & (F.col("down") > 0))).isEmpty()


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, component) of every node of an edge, the component being its smallest node."""
    e = edges.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).where(F.col("a") != F.col("b")).distinct()
    e = materialize(e, "edges")
    while not _finished(e):
        old, e = e, materialize(_star(_star(e, True), False), "edges")
        discard(old)
    return e.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(e.select(F.col("b").alias("node"), F.col("b").alias("component"))).distinct()
