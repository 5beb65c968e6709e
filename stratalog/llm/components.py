"""Connected components of an edge table, as joins and aggregations.

Alternating large-star and small-star steps: each joins or groups the edges by
one end, keeps at most as many edges as there were, and halves distances to the
smallest node. Edges of nodes with very many neighbours are first summed up per
partition, as every step only needs each node's smallest neighbour.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratalog.session import settle_table


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of ``edges`` (a, b); component is the smallest node reachable.

    Loops and repeated edges do no harm; edges with a null end are left out.
    """
    edges = settle_table(edges.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    nodes = edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct()
    state = None
    while True:
        edges = _step(edges)
        now = edges.agg(F.count(F.lit(1)), F.sum(F.hash("a", "b").cast("long")), F.bit_xor(F.xxhash64("a", "b"))).first()
        if now == state:
            break
        state = now
    # every edge now leads from a node straight to the smallest of its component
    found = edges.groupBy("a").agg(F.min("b").alias("component"))
    return nodes.join(found, F.col("node") == F.col("a"), "left").select("node", F.coalesce("component", "node").alias("component"))


def _step(edges: DataFrame) -> DataFrame:
    """One large-star and one small-star step over edges with a > b."""
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("n"), F.least("a", "m").alias("m"))
    large = both.join(least, both["a"] == least["n"]).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    large = large.where("a <> b")
    least = large.groupBy("a").agg(F.min("b").alias("m")).withColumnRenamed("a", "n")
    joined = large.join(least, large["a"] == least["n"])
    small = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).union(joined.select("a", F.col("m").alias("b")))
    return settle_table(small.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
