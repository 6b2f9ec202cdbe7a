"""Connected components by alternating large-star and small-star steps, as joins and aggregations.

Every step keeps connectivity: large-star hangs each node's larger neighbours on its smallest neighbour, small-star
the smaller ones. Nothing is gathered per node, only minima are, so a star of any size is handled by partial
aggregation, and the join of a hot centre with its one minimum is split like any skewed join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ferrolith.llm.common import materialize


def _step(edges: DataFrame, large: bool) -> DataFrame:
    """``edges``: distinct (a, b) with a > b. Hang neighbours on the smallest neighbour of each node."""
    if large:
        pairs = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    else:
        pairs = edges.select(F.col("a").alias("u"), F.col("b").alias("v"))
    least = pairs.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("mu"), F.least("u", "m").alias("m"))
    hung = pairs.join(least.hint("merge"), F.col("u") == F.col("mu"))  # both grow with the graph: never through the driver
    if large:
        out = hung.where(F.col("v") > F.col("u")).select(F.col("v").alias("a"), F.col("m").alias("b"))
    else:
        out = hung.select(F.col("v").alias("a"), F.col("m").alias("b")).unionByName(least.select(F.col("mu").alias("a"), F.col("m").alias("b")))
    return out.where(F.col("a") != F.col("b")).distinct()


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Nodes that have an edge and the smallest node of their component: (node, root).

    Edges are pairs of longs; loops, repeats and nulls do no harm. Each round is written to the shared folder;
    rounds grow with the logarithm of the longest chain.
    """
    pairs = edges.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).where(F.col("a") != F.col("b")).distinct()
    now, before = materialize(pairs, "edges"), None
    while True:
        # the steps leave stars on their least nodes unchanged, and nothing else; the sum of hashes tells whether anything changed
        stats = tuple(now.agg(F.count("a"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if not stats[0] or stats == before:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
        before = stats
        now = materialize(_step(_step(now, large=True), large=False), "edges")
