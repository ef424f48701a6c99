"""Connected components of link tables, with the rows never leaving Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import tables


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): the smallest node that each node of links reaches.

    Alternating large-star and small-star steps; each round is written, so that plans stay short and a lost
    executor costs one round. Rounds grow with the logarithm of a component's size. A hub's neighbours are joined to
    its minimum, dealt to several tasks.
    """
    edges = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u > v").distinct()
    edges = tables.saved(edges, "edges")
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        lowest = tables.saved(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count(F.lit(1)).alias("n")), "lowest")
        large = tables.join_hot(both, lowest, ["u"], ["v"], "n").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        least = large.where("u > v")
        least = tables.saved(least, "least")
        small = tables.saved(least.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n")), "small")
        joined = tables.join_hot(least, small, ["u"], ["v"], "n")
        stepped = joined.select(F.col("u"), F.col("m").alias("v")).unionByName(joined.where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))).where("u > v").distinct()
        edges = tables.saved(stepped, "edges")
        # done when every node points at one node, which points nowhere
        ends = edges.select(F.explode(F.array(F.struct(F.col("u").alias("node"), F.lit(1).alias("out")), F.struct(F.col("v").alias("node"), F.lit(0).alias("out")))).alias("e")).select("e.*")
        told = ends.groupBy("node").agg(F.sum("out").alias("out"), F.min("out").alias("low"))
        if not told.where("out > 1 or (out = 1 and low = 0)").limit(1).count():
            break
    roots = edges.select(F.col("v").alias("node")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots.select("node", F.col("node").alias("component")))
