"""Connected components of an edge table by alternating large-star and small-star steps.

Each step is an aggregation by node and a join back on it, both spread over the keys; a node with
very many neighbours is one aggregated row and a skewed join that Spark splits. Every round is
written to the shared folder, so lineage stays short and survives lost executors, and replaces the one
before it. Nothing but a count and a checksum per round comes to the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import scratch


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node, root``: the smallest node reachable, for every node that reaches a smaller one (a root has
    no row of its own).

    Nodes are longs; self-loops, repeated edges and nulls are ignored; no edges give no rows.
    """
    pairs = edges.select(F.col(a).cast("long").alias("a"), F.col(b).cast("long").alias("b")).where("a <> b")
    now = scratch.save(pairs.select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("u")).distinct(), "edges")
    before = None
    while True:
        # large star: neighbours above a node hang on the smallest of the node and its neighbours
        both = now.union(now.select(F.col("u").alias("v"), F.col("v").alias("u")))
        low = both.groupBy("v").agg(F.min("u").alias("m")).select(F.col("v").alias("c"), F.least("v", "m").alias("m"))
        large = both.join(low, F.col("v") == F.col("c")).where("u > v").select(F.col("u").alias("v"), F.col("m").alias("u")).where("u <> v").distinct()
        large, old = scratch.save(large, "edges"), now
        scratch.discard(old)
        # small star: a node and its neighbours below it hang on the smallest of them
        low = large.groupBy("v").agg(F.min("u").alias("m")).select(F.col("v").alias("c"), "m")
        hung = large.join(low, F.col("v") == F.col("c")).where("u <> m").select(F.col("u").alias("v"), F.col("m").alias("u"))
        now = scratch.save(hung.union(low.select(F.col("c").alias("v"), F.col("m").alias("u"))).distinct(), "edges")
        scratch.discard(large)
        state = now.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("v", "u").cast("decimal(20,0)")).alias("s")).head()
        if state == before:
            return now.select(F.col("v").alias("node"), F.col("u").alias("root"))
        before = state
