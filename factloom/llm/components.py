"""Connected components by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm.common import fixed


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for every node of an undirected edge list; root is the smallest node reachable.

    Each round hangs the larger neighbours of a node on its smallest one, then
    the smaller ones; only minima are gathered per node, never neighbour lists,
    so a node with very many edges is pre-aggregated. Each round's edges are
    fixed in the shared folder. Loops (a = b) only name their node; null ends
    are left out; an empty list gives an empty result.
    """
    x, y = F.col(a).cast("long"), F.col(b).cast("long")
    named = edges.select(F.greatest(x, y).alias("v"), F.least(x, y).alias("u"), x.isNotNull() & y.isNotNull())
    named = fixed(named.where(named[2]).select("v", "u").distinct())
    loops = named.where("u = v").select(F.col("v").alias("node"), F.col("v").alias("root"))
    now, mark = named.where("u < v"), None
    while True:
        both = now.union(now.select("u", "v"))
        least = both.groupBy("v").agg(F.min("u").alias("m")).withColumn("m", F.least("v", "m"))
        large = both.where("u > v").join(least, "v").select(F.col("u").alias("v"), F.col("m").alias("u"))
        large = large.where("u < v").distinct()
        below = large.groupBy("v").agg(F.min("u").alias("m"))
        small = large.join(below, "v").select(F.col("u").alias("v"), F.col("m").alias("u")).where("u < v")
        now = fixed(small.union(below.select("v", F.col("m").alias("u"))).distinct())
        seen = now.agg(F.count("*"), F.sum(F.xxhash64("v", "u").cast("decimal(38,0)"))).first()
        if seen == mark:
            break
        mark = seen
    stars = now.select(F.col("v").alias("node"), F.col("u").alias("root"))
    roots = now.select(F.col("u").alias("node"), F.col("u").alias("root"))
    return stars.union(roots).union(loops).groupBy("node").agg(F.min("root").alias("root"))
