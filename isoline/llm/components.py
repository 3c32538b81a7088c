"""Connected components of an edge table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, written


def _with_least(edges: DataFrame) -> DataFrame:
    """edges (a, b) with m, the least b of each a. The minimum is summed up before it is shuffled, and meets the edges in a join, which can be split where one a has many."""
    return edges.join(edges.groupBy("a").agg(F.min("b").alias("m")), "a")


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    return _with_least(both).filter("b > a").select(F.col("b").alias("a"), F.least("a", "m").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    rows = _with_least(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")))
    linked = rows.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(rows.select("a", F.col("m").alias("b")))
    return linked.filter("a <> b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for each node of edges (a, b), both long: root is its component's least node.

    Each round replaces the edges by stars and writes them; it ends when a round
    changes nothing, after about the logarithm of the longest path. Self-loops
    and null ends are left out. Only a row count and a checksum reach the driver.
    """
    now = written(edges.filter("a is not null and b is not null and a <> b").select("a", "b").distinct(), "edges")
    sign = lambda df: df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    before = None
    while True:
        after = sign(now)
        if after == before or not after[0]:
            break
        before = after
        last, now = now, written(_small_star(_large_star(now)), "edges")
        forget(last)
    nodes = now.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return nodes.unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root"))).distinct()
