"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyspark.llm.common import discard, join_spread, materialise


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for each node of ``edges`` (u, v): root is the smallest node it can reach.

    Alternates large-star and small-star steps until the edges are stars: neighbours move to the smallest
    one, as joins and minima over edge rows; it ends when each node has one edge and no root has any. Minima are made where the rows lie before they are dealt, and edges of a node
    that has very many meet its minimum by broadcast (``join_spread``), so no node's edges are gathered anywhere.
    Each round's edges are written to the shared checkpoint folder, which cuts the lineage, and the round's before are
    removed. Loops and repeated edges change nothing; no edges, no rows."""
    edges = materialise(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    n = edges.count()
    while n:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n")).select("u", F.least("u", "m").alias("m"), "n")
        large = join_spread(both, least, "u", "n", 2 * n).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n"))
        small = join_spread(large, least, "u", "n", 2 * n).select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        before, edges = edges, materialise(small.where("u <> v").distinct(), "edges")
        discard(before)
        n = edges.count()
        if n == edges.select("u").distinct().count() and not edges.join(edges.select(F.col("v").alias("u")).distinct(), "u", "left_semi").limit(1).count():
            break
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
