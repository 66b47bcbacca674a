"""Connected components of a graph given as links, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed


def _star(links: DataFrame, large: bool) -> DataFrame:
    """One step over (u, v) rows with u > v: every node's neighbours (large: the greater ones, small: the lesser ones and itself) link to its least neighbour."""
    if large:
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        out = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        least = links.groupBy("u").agg(F.min("v").alias("m"))
        out = links.join(least, "u").filter("v > m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return out.filter("u <> v").distinct()


def components(links: DataFrame, nodes: int | None = None) -> DataFrame:
    """(node, root): the least node of each linked node's component, for links (u, v) of longs among ``nodes`` nodes.

    Each round is checkpointed in as many files as its links need, so no lineage grows; rounds
    grow with the logarithm of the longest path. Nodes without links are not returned.
    """
    state = checkpointed(links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v").distinct(), nodes)

    def digest(df: DataFrame) -> tuple:
        r = df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).head()
        return r[0], r[1]

    seen = digest(state)
    while seen[0]:
        state = checkpointed(_star(_star(state, True), False), seen[0])
        now = digest(state)
        if now == seen:
            break
        seen = now
    roots = state.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())
