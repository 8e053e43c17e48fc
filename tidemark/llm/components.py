"""Connected components of a graph given by its edges, by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import checkpointed


def components(edges: DataFrame) -> DataFrame:
    """``(node, component)`` of every node of ``edges(a, b)``; the component is its smallest node.

    Each round links, for every node, its larger neighbours to its smallest neighbour (large star), then its
    smaller neighbours (small star). Rows never exceed the edges; a node's neighbours are reduced to one
    minimum by partial aggregation before the shuffle, so a hub is no single task's burden. The rounds,
    logarithmic in practice, end when every edge points to a root; only counts reach the driver.
    """
    now = checkpointed(edges.where("a <> b").select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("u")).distinct())
    while True:
        both = now.select("v", "u").unionByName(now.select(F.col("u").alias("v"), F.col("v").alias("u")))
        least = both.groupBy("v").agg(F.min("u").alias("m")).select("v", F.least("m", "v").alias("m"))
        large = both.join(least, "v").where("u > v").select(F.col("u").alias("v"), F.col("m").alias("u"))
        large = large.unionByName(least.where("m < v").select("v", F.col("m").alias("u"))).distinct()
        down = large.groupBy("v").agg(F.min("u").alias("m"))
        small = large.join(down, "v").where("u <> m").select(F.col("u").alias("v"), F.col("m").alias("u"))
        after = checkpointed(small.unionByName(down.select("v", F.col("m").alias("u"))).distinct())
        roots = after.select(F.col("u").alias("v")).distinct()
        if after.join(roots, "v", "left_semi").limit(1).count() == 0 and after.groupBy("v").count().where("count > 1").limit(1).count() == 0:
            break
        now = after
    own = after.select(F.col("u").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return after.select(F.col("v").alias("node"), F.col("u").alias("component")).unionByName(own)
