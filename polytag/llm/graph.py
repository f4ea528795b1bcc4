"""Connected components of an edge table, entirely as joins and grouped minima."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .store import Scratch


def connected_components(spark: SparkSession, edges: DataFrame, scratch: Scratch) -> DataFrame:
    """``edges (a, b)`` with a != b -> ``(node, component)``, component = smallest node reachable.

    Alternates two rewritings until every edge points at its component's smallest node: each
    larger neighbour of a node is hung on the smallest one (large star), then each node's smaller
    neighbours are (small star).  The number of rounds grows with the logarithm of a component's size.  A node
    with very many edges is never one task's work: minima are combined before the shuffle and joined back, and
    the join splits a skewed key.  Every round is a written table.
    """
    cur = scratch.write(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    mark = None
    if cur.isEmpty():
        return cur.select(F.col("u").alias("node"), F.col("v").alias("component"))
    while True:
        both = cur.unionAll(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(low, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        small_low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(small_low, "u")
        nxt = (
            small.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
            .unionAll(small_low.select("u", F.col("m").alias("v")))
            .distinct()
        )
        nxt = scratch.write(nxt, "edges")
        scratch.drop(cur)
        cur = nxt
        now = cur.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == tuple(now):
            break
        mark = tuple(now)
    return cur.select(F.col("u").alias("node"), F.col("v").alias("component")).unionAll(
        cur.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )
