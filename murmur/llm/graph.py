"""Connected components of a graph given as a table of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from murmur.llm.common import written


def components(edges: DataFrame, most_rounds: int = 100) -> DataFrame:
    """(node, root): the smallest node reachable, for every node that an edge (a, b) touches.

    Alternates "large star" (each node ties its larger neighbours to its smallest neighbour) and "small star" (each node
    ties its smaller neighbours and itself to the smallest), until the edges stay the same; rounds grow with the logarithm
    of the component size, and running out of them is an error. Every step is an aggregate (min per node, combined before
    its shuffle, written) and a join with it, which adaptive execution can split at a node of many edges; each round is
    written to the shared folder, so lineage stays short. No neighbour list is ever gathered.
    """
    now = written(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "cc")
    rows = now.count()
    for _ in range(most_rounds):
        both = now.union(now.select("v", "u"))
        least = written(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")), "cc-least")
        large = written(both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct(), "cc-large")
        least = written(large.groupBy("u").agg(F.min("v").alias("m")), "cc-least")
        small = large.join(least, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        after = written(small, "cc")
        count = after.count()
        if count == rows and not after.join(now, ["u", "v"], "left_anti").limit(1).count():
            return after.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("root")).union(after.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        now, rows = after, count
    raise RuntimeError(f"components have not settled after {most_rounds} rounds")
