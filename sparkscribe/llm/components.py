"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, spread


#: Edges of one checkpointed partition.
EDGES = 200_000


def components(links: DataFrame, a: str = "a", b: str = "b", most: int = 60) -> DataFrame:
    """(node, root) for every node of links: root is the smallest node reachable.

    Each step is a minimum by key, combined before it is shuffled, and a merge join that AQE can split at a hub; nothing
    is collected or broadcast, and each round's edges are checkpointed. Self links and repeats do no harm; no links, no rows.
    """
    edges = cut(links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct())
    state = None
    for _ in range(most):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = spread(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(edges.join(least, "u").select("u", F.col("m").alias("v"))).distinct()
        small = spread(large.groupBy("u").agg(F.min("v").alias("m")))
        nxt = large.join(small, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v").where("u <> v").distinct()
        edges = cut(nxt.coalesce(max(8, state.n // EDGES)) if state else nxt)  # few edges, few files
        now = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if now == state:
            break
        state = now
    else:
        raise RuntimeError(f"components did not settle in {most} rounds")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
