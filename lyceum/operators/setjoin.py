"""Pairs of members whose key sets are similar, without making every pair of a key.

Keys are ordered by how many members have them, the rarest first. Two sets that share ``o`` keys or more can't both have all shared keys
among their last o - 1, so they meet in their first |x| - o + 1 keys: only these prefixes are joined, which leaves the most frequent keys out. The
least overlap follows from the threshold and the size of the set; sizes too different for the threshold are left out as they meet. What
has met is verified on the whole sets. A key that is frequent even in prefixes is split into blocks of members, and every two
blocks meet in a task of their own.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .sizes import checkpointed

#: Members of a key that meet in one task.
SPLIT = 1000


@dataclass(frozen=True)
class Threshold:
    """Which pairs count: at least ``shared`` keys in common and a ``measure`` (ochiai, jaccard or none) of ``least`` or more."""

    shared: int = 1
    measure: str | None = None
    least: float = 0.0

    def overlap(self, n: Column) -> Column:
        """The fewest keys that a set of n keys shares with any set that is similar to it."""
        # A hair less than the bound: rounding must not lose a pair, verification decides.
        share = {"ochiai": self.least * self.least, "jaccard": self.least}.get(self.measure, 0.0)
        return F.greatest(F.lit(max(self.shared, 1)), F.ceil(n * F.lit(share) - F.lit(1e-9)).cast("int"))

    def sizes(self, a: Column, b: Column) -> Column:
        """Whether sets of these sizes can be similar."""
        share = {"ochiai": self.least * self.least, "jaccard": self.least}.get(self.measure, 0.0)
        return F.least(a, b) >= F.greatest(F.greatest(a, b) * F.lit(share) - F.lit(1e-9), F.lit(float(self.shared)))

    def holds(self, both: Column, a: Column, b: Column) -> Column:
        enough = both >= self.shared
        if self.measure == "ochiai":
            enough &= both / F.sqrt(a.cast("double") * b) >= self.least
        elif self.measure == "jaccard":
            enough &= both / F.greatest(a + b - both, F.lit(1)) >= self.least
        return enough


def prefixes(rows: DataFrame, key: str, member: str, threshold: Threshold) -> DataFrame:
    """(key, member, n): of distinct rows, those whose key is in its member's prefix; n is the size of the member's set."""
    frequency = rows.groupBy(key).agg(F.count("*").alias("_f"))
    sizes = rows.groupBy(member).agg(F.count("*").alias("n"))
    # A member too small to share enough keys has no prefix.
    ranked = rows.join(frequency, key).withColumn("_rank", F.row_number().over(Window.partitionBy(member).orderBy("_f", key)))
    return ranked.join(sizes, member).filter(F.col("_rank") <= F.col("n") - threshold.overlap(F.col("n")) + 1).select(key, member, "n")


def candidates(rows: DataFrame, key: str, member: str, threshold: Threshold, split: int = SPLIT) -> DataFrame:
    """(l, r, n_l, n_r), l < r: pairs whose prefixes share a key and whose sizes fit."""
    own = checkpointed(prefixes(rows, key, member, threshold))
    parts = own.groupBy(key).agg(F.ceil(F.count("*") / split).cast("int").alias("_parts"))
    dealt = own.join(parts, key).withColumn("_block", F.pmod(F.xxhash64(member), F.col("_parts")).cast("int"))
    # Blocks i <= j of a key meet under (key, i, j); within one block the lesser member is the left one.
    low = dealt.select(key, F.col("_block").alias("_i"), F.explode(F.sequence(F.col("_block"), F.col("_parts") - 1)).alias("_j"), F.col(member).alias("_a"), F.col("n").alias("_na"))
    high = dealt.select(key, F.explode(F.sequence(F.lit(0), F.col("_block"))).alias("_i"), F.col("_block").alias("_j"), F.col(member).alias("_b"), F.col("n").alias("_nb"))
    met = low.join(high, [key, "_i", "_j"]).filter(((F.col("_i") < F.col("_j")) & (F.col("_a") != F.col("_b"))) | (F.col("_a") < F.col("_b"))).filter(threshold.sizes(F.col("_na"), F.col("_nb")))
    swap = F.col("_a") > F.col("_b")
    pick = lambda x, y: F.when(swap, F.col(y)).otherwise(F.col(x))
    return met.select(pick("_a", "_b").alias("l"), pick("_b", "_a").alias("r"), pick("_na", "_nb").alias("n_l"), pick("_nb", "_na").alias("n_r")).distinct()


def verified(pairs: DataFrame, rows: DataFrame, key: str, member: str) -> DataFrame:
    """``pairs`` (l, r, ...) with ``n_shared``, the keys that both have among ``rows``; pairs without any are left out."""
    left = rows.select(F.col(member).alias("l"), F.col(key).alias("_key"))
    right = rows.select(F.col(member).alias("r"), F.col(key).alias("_key"))
    counts = pairs.select("l", "r").join(left, "l").join(right, ["r", "_key"]).groupBy("l", "r").agg(F.count("*").alias("n_shared"))
    return pairs.join(counts, ["l", "r"])


def similar(rows: DataFrame, key: str, member: str, threshold: Threshold, split: int = SPLIT) -> DataFrame:
    """(l, r, n_shared, n_l, n_r), l < r: all pairs of members whose sets of keys the threshold finds similar.

    Null keys and members have no part; repeated rows count once.
    """
    own = checkpointed(rows.select(key, member).dropna().distinct())
    found = verified(candidates(own, key, member, threshold, split), own, key, member)
    return found.filter(threshold.holds(F.col("n_shared"), F.col("n_l"), F.col("n_r"))).select("l", "r", "n_shared", "n_l", "n_r")


def meeting(pairs: DataFrame, rows: DataFrame, key: str, member: str) -> DataFrame:
    """Those of ``pairs`` (l, r, ...) that have a common key among ``rows``."""
    own = rows.select(key, member).distinct()
    left = own.select(F.col(member).alias("l"), F.col(key).alias("_key"))
    right = own.select(F.col(member).alias("r"), F.col(key).alias("_key"))
    both = pairs.select("l", "r").join(left, "l").join(right, ["r", "_key"], "left_semi").select("l", "r").distinct()
    return pairs.join(both, ["l", "r"], "left_semi")
