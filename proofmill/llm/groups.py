"""Connected groups of a graph given by its edges."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from proofmill.llm.tables import written


def connected(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root): the smallest node of each node's group, for all nodes that
    have an edge.

    Large-star and small-star steps in turn: every node links its larger
    neighbours to its smallest one, then its smaller ones. Each round is two
    groupings whose sums combine before the shuffle, and its result is written
    to the shared folder, so lost executors cost one round at most.
    """
    links = edges.select(F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo")).filter("hi <> lo").distinct()
    links = written(links, "links")
    while True:
        both = links.select(F.col("hi").alias("node"), F.col("lo").alias("other")).unionByName(links.select(F.col("lo").alias("node"), F.col("hi").alias("other")))
        least = both.groupBy("node").agg(F.least(F.min("other"), F.first("node")).alias("root"))
        large = both.filter("other > node").join(least, "node").select(F.col("other").alias("hi"), F.col("root").alias("lo")).distinct()
        lowest = large.groupBy("hi").agg(F.min("lo").alias("root"))
        small = large.join(lowest, "hi").select(F.when(F.col("lo") == F.col("root"), F.col("hi")).otherwise(F.col("lo")).alias("hi"), F.col("root").alias("lo"))
        now = written(small.filter("hi <> lo").distinct(), "links")
        if now.join(links, ["hi", "lo"], "left_anti").isEmpty() and links.join(now, ["hi", "lo"], "left_anti").isEmpty():
            break
        links = now
    return now.select(F.col("hi").alias("node"), F.col("lo").alias("root")).unionByName(now.select(F.col("lo").alias("node"), F.col("lo").alias("root")).distinct())
