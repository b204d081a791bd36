"""Connected components of an edge table as Spark joins and aggregates.

Alternating star contraction: every round points each node's larger
neighbours, then each node's smaller ones, at the smallest label in reach.
Rounds use ``min`` aggregates (combined before the shuffle) and equi-joins
against one row per node, so a node with very many edges is split like any
skewed join side and never gathered into one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tenura.llm.scratch import stored


def components(edges: DataFrame) -> DataFrame:
    """``edges`` (a, b) of 64-bit integers to (node, component), the smallest
    node reachable.  Loops and repeated edges are allowed; a node without an
    edge to another one does not appear."""
    e = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    e = stored(e, "edges")
    while True:
        both = e.union(e.select("b", "a"))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        # large star: neighbours above a node move to the smallest one around it
        large = (both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
                 .where("a <> b").distinct())
        large = stored(large, "edges")
        # small star: a node and its smaller neighbours move to the smallest of them
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        joined = large.join(low, "a")
        small = (joined.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
                 .union(low.select("a", F.col("m").alias("b"))).distinct())
        new = stored(small, "edges")
        # finished when both stars leave the edges as they were: every node hangs on one root
        if _same(e, new):
            return new.select(F.col("a").alias("node"), F.col("b").alias("component")).union(
                new.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
        e = new


def _same(x: DataFrame, y: DataFrame) -> bool:
    def digest(d):
        return d.agg(F.count(F.lit(1)), F.expr("bit_xor(xxhash64(a, b))"), F.sum(F.xxhash64("b", "a").cast("decimal(38,0)"))).first()
    return digest(x) == digest(y)
