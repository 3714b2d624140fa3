"""Connected components of an edge table by alternating large-star and small-star steps.

Every step is a group-by with map-side minima and an equi join; row counts stay linear in the edges, and nothing
is gathered on the driver but one count a round. Rounds are cut by checkpoint() in the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.llm.common import cut


def _step(edges: DataFrame, both: bool) -> DataFrame:
    """edges (a, b) with a > b. both: large-star (all neighbours, larger ones move); else small-star (smaller ones move)."""
    side = edges.select(F.col("a").alias("u"), F.col("b").alias("v"))
    if both:
        side = side.unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    least = side.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    moved = side.join(least, "u")
    if both:
        moved = moved.filter("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    else:
        moved = moved.select(F.col("v").alias("a"), F.col("m").alias("b")).unionByName(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
    return moved.filter("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Edges between long ids → (node, component): the smallest id reachable, for every node that has an edge to another."""
    edges = edges.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).filter("a != b").distinct()
    sign = F.struct(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s"))
    edges = cut(edges)
    before = edges.agg(sign).first()[0]
    while True:
        edges = cut(_step(_step(edges, True), False))
        now = edges.agg(sign).first()[0]
        if now == before:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
        before = now
