"""Connected components of an edge table, as rounds of Spark joins and minima."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import shared_dir


def components(edges: DataFrame) -> DataFrame:
    """(a, b) edges -> (node, root): every node with an edge, and the least node of its component.

    Alternates "large star" (larger neighbours move to the least neighbour) and "small star"
    (smaller neighbours do) until nothing changes; the number of rounds is about the logarithm
    of the longest path. Minima are combined before the shuffle, the joins hold a key's
    minimum once, so a node with very many neighbours only makes many small rows, which
    adaptive execution may split. Each round ends in checkpoint(): a lost executor costs at
    most one round. Self loops and nulls are left out; no edges give no rows.
    """
    shared_dir(edges.sparkSession)
    e = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct().checkpoint()
    mark = None
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        e = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct().checkpoint()
        low = e.groupBy("u").agg(F.min("v").alias("m"))
        moved = e.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = moved.unionByName(low.select("u", F.col("m").alias("v"))).distinct().checkpoint()
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == mark:
            return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        mark = now
