"""Connected components of an edge table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .common import cut, remove


def _minimum(edges: DataFrame) -> DataFrame:
    """Each node's smallest neighbour; combined before the shuffle, so a hub costs no more than others."""
    return edges.groupBy("u").agg(F.min("v").alias("m"))


def _large(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = _minimum(both).select("u", F.least("u", "m").alias("m"))
    return both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    low = _minimum(down)
    moved = down.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(low.select("u", F.col("m").alias("v"))).where("u <> v").distinct()


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) of every node that has an edge to another: root is the smallest node reachable.

    Self-loops, repeated and reversed edges are harmless, edges with a null end are left out, an empty
    table has no nodes. Each round ends in a table in the shared folder; rounds grow with the logarithm
    of the number of nodes.
    """
    spark = edges.sparkSession
    now, path = cut(edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u <> v"), "edges")
    before = None
    while True:
        new, new_path = cut(_small(_large(now)), "stars")
        row = new.agg(F.count("*").alias("n"), F.sum(F.hash("u", "v").cast("long")).alias("s")).first()
        remove(spark, path)
        now, path = new, new_path
        if (row["n"], row["s"]) == before or row["n"] == 0:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        before = (row["n"], row["s"])
