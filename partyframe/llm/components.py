"""Connected components of an edge table, without collecting it anywhere."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import forget, written


def connected_components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of edges (a, b): root is the smallest node of its component.

    Alternates two steps until nothing changes. Large star: a node's larger neighbours move to its smallest one. Small
    star: a node and its smaller neighbours move to the smallest of them. The table always has as many edges as nodes
    have links at most, its diameter falls fast, and it ends with every node linked to its root. Each round is written
    to the shared folder, so that lineage stays short and lost executors cost one round.
    Loops and repeated edges are harmless; an empty table gives no rows.
    """
    now = written(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    if now.isEmpty():
        return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
    state = None
    for _ in range(most_rounds):
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("least")).select("a", F.least("a", "least").alias("least"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("least").alias("b"))
        large = large.distinct()
        low = large.groupBy("a").agg(F.min("b").alias("least"))
        small = large.join(low, "a").select(F.col("b").alias("a"), F.col("least").alias("b")).where("a <> b").unionByName(low.select("a", F.col("least").alias("b")))
        last, now = now, written(small.distinct(), "links")
        forget(last)
        seen = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if seen == state:
            break
        state = seen
    else:
        raise RuntimeError(f"components have not settled after {most_rounds} rounds")
    roots = now.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())
