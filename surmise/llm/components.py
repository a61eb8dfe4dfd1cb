"""Connected components by alternating large-star and small-star steps, over tables in the shared folder.

Neither links nor components pass through the driver: only a count and a checksum of the edges do, to
see when a step changes nothing.  Minima are combined before each exchange.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from surmise.llm._shared import drop_table, written


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """edges: (a, b).  Every node's neighbours point at the smallest of them and itself.

    The minima are written before they are joined: both sides of the join then come from plain exchanges, which
    Spark can split where a node is hot.
    """
    spark = edges.sparkSession
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else edges
    least = written(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("k"), F.least("a", "m").alias("m")), "least")
    moved = both.join(least, F.col("a") == F.col("k"))
    if large:
        out = moved.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = moved.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select(F.col("k").alias("a"), F.col("m").alias("b")))
    found = written(out.where("a != b").distinct(), "edges")
    drop_table(spark, least)
    return found


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first())


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b); a root is the smallest node of its component."""
    spark = edges.sparkSession
    now = written(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a != b").distinct(), "edges")
    mark = _mark(now)
    while mark[0]:
        half = _star(now, True)
        nxt = _star(half.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")), False)
        new = _mark(nxt)
        drop_table(spark, half)
        drop_table(spark, now)
        now, done, mark = nxt, new == mark, new
        if done:
            break
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
