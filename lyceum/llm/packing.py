"""Packing into optimal length buckets (operator 8).

The lengths of all rows make one histogram; dynamic programming over it chooses at most
BUCKETS upper bounds for which padding every row to its bucket's bound costs least. Inside a
bucket, rows form batches of as many as the token budget allows at the bound's length.

The histogram has one bin for each length that occurs: lengths are counts, so texts of T tokens in all have
sqrt(2 T) different ones at most, and some thousands in practice. It alone reaches the driver.
A row longer than the budget is a batch of its own. Null texts count as empty; the empty text has
length 1 (its end mark). Rows are never cut or dropped; rows of equal id and length are alike and are moved as one with a
count until they are packed, as often as they occur; a null id is an id like others; an empty table gives an empty result. The new
columns ``n_tokens``, ``bucket``, ``padded_to``, ``batch_id``, ``place`` replace any of those names.
"""

from __future__ import annotations

import json

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import add_columns, checkpointed, in_tasks, raw, shuffle_partitions, without

BUDGET = 65536
BUCKETS = 16
#: Rows of a bucket that one task orders.
GROUP = 8_192


def counted(df: DataFrame, text_col: str, out: str = "n_tokens") -> DataFrame:
    """``df`` with the tokens of its texts: runs of characters other than ASCII blanks, and an end mark."""

    def start():
        def compute(column: pa.Array) -> list[pa.Array]:
            return [pa.array([len(x.split()) + 1 for x in raw(column)], pa.int64())]

        return compute

    return add_columns(df, [text_col], [T.StructField(out, T.LongType())], start)


def boundaries(lengths: np.ndarray, counts: np.ndarray, k: int = BUCKETS) -> tuple[list[int], int]:
    """Upper bounds (members of ``lengths``, ascending) of at most ``k`` buckets with least padding, and that padding.

    cost[j] = min over i of cost[i] + lengths[j] (N_j - N_i) - (T_j - T_i): lines in lengths[j] whose
    slopes fall, so each layer takes one pass over a lower hull.
    """
    lengths, counts = np.asarray(lengths, dtype=object), np.asarray(counts, dtype=object)
    m = len(lengths)
    if m == 0:
        return [], 0
    below = [0, *np.cumsum(counts).tolist()]
    total = [0, *np.cumsum(lengths * counts).tolist()]
    cost: list[int | None] = [0] + [None] * m
    back: list[list[int]] = []
    best, best_layer = None, 0
    for layer in range(min(k, m)):
        new: list[int | None] = [None] * (m + 1)
        came = [0] * (m + 1)
        hull: list[tuple[int, int, int]] = []  # slope, intercept, index
        at = 0
        for j in range(1, m + 1):
            if cost[j - 1] is not None:
                line = (-below[j - 1], cost[j - 1] + total[j - 1], j - 1)
                while len(hull) >= 2 and (line[1] - hull[-2][1]) * (hull[-2][0] - hull[-1][0]) <= (hull[-1][1] - hull[-2][1]) * (hull[-2][0] - line[0]):
                    hull.pop()
                hull.append(line)
                at = min(at, len(hull) - 1)
            if hull:
                x = lengths[j - 1]
                while at + 1 < len(hull) and hull[at + 1][0] * x + hull[at + 1][1] <= hull[at][0] * x + hull[at][1]:
                    at += 1
                new[j] = hull[at][0] * x + hull[at][1] + x * below[j] - total[j]
                came[j] = hull[at][2]
        back.append(came)
        cost = new
        if best is None or cost[m] is not None and cost[m] < best:
            best, best_layer = cost[m], layer
    ends, j = [], m
    for layer in range(best_layer, -1, -1):
        ends.append(int(lengths[j - 1]))
        j = back[layer][j]
    return ends[::-1], int(best)


def histogram(df: DataFrame, length_col: str, count: Column | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The lengths that occur and how many rows have each (``count``: of a row), ascending."""
    rows = df.groupBy(F.col(length_col).alias("b")).agg(F.sum(F.lit(1) if count is None else count).alias("n")).collect()
    rows.sort()
    return np.array([r[0] for r in rows], dtype=np.int64), np.array([r[1] for r in rows], dtype=np.int64)


def pack(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", budget: int = BUDGET, k: int = BUCKETS, group: int = GROUP, length_col: str | None = None) -> DataFrame:
    """(id, n_tokens, bucket, padded_to, batch_id, place): the batch of every row and its place in it.

    Lengths are those of ``length_col`` (as a tokenizer has counted them; null as 1) or else counted from the texts.
    Batches follow a bucket's order by a hash of id and length. The order is taken in groups of about ``group`` rows
    and carried on from group to group by their counts, so no task holds a whole bucket.
    """
    n = df.count()
    own = F.col(f"`{id_col}`").alias(id_col)
    if length_col is None:
        pair = counted(df.select(own, F.col(f"`{text_col}`").alias("_text")), "_text")
    else:
        pair = df.select(own, F.coalesce(F.col(f"`{length_col}`").cast("long"), F.lit(1)).alias("n_tokens"))
    # Lengths are counted once; what follows moves three numbers a row.
    rows = checkpointed(pair.groupBy(id_col, "n_tokens").agg(F.count("*").alias("_c")), n)
    lengths, counts = histogram(rows, "n_tokens", F.col("_c"))
    ends, _ = boundaries(lengths, counts, k)
    ends = ends or [1]
    sizes = np.bincount(np.searchsorted(ends, lengths), weights=counts, minlength=len(ends)).astype(int) if len(lengths) else [0]
    bounds = F.from_json(F.lit(json.dumps(ends)), "array<bigint>")
    parts = F.from_json(F.lit(json.dumps([int(-(-s // group) or 1) for s in sizes])), "array<bigint>")
    rows = rows.withColumn("bucket", F.size(F.filter(bounds, lambda b: b < F.col("n_tokens")))).withColumn("padded_to", F.get(bounds, F.col("bucket")))
    rows = rows.withColumn("_h", F.xxhash64(id_col, "n_tokens")).withColumn("_g", F.pmod(F.shiftright("_h", 8), F.get(parts, F.col("bucket"))))
    before = Window.partitionBy("bucket").orderBy("_g").rowsBetween(Window.unboundedPreceding, -1)
    # One row for each group: the rows of all groups before it in its bucket.
    offsets = rows.groupBy("bucket", "_g").agg(F.sum("_c").alias("_n")).withColumn("_off", F.coalesce(F.sum("_n").over(before), F.lit(0))).select("bucket", "_g", "_off")
    order = Window.partitionBy("bucket", "_g").orderBy("_h", id_col, "n_tokens").rowsBetween(Window.unboundedPreceding, -1)
    ranked = rows.withColumn("_r", F.coalesce(F.sum("_c").over(order), F.lit(0))).join(offsets, ["bucket", "_g"])
    ranked = ranked.select(id_col, "n_tokens", "bucket", "padded_to", "_c", (F.col("_off") + F.col("_r")).alias("_first"))
    single = ranked.filter(F.col("_c") <= group).withColumn("_i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_c") - 1)))
    if not rows.filter(F.col("_c") > group).isEmpty():
        # An id that repeats very often is dealt out in pieces before its rows come into being.
        pieces = ranked.filter(F.col("_c") > group).withColumn("_s", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_c") - 1, F.lit(group).cast("long"))))
        pieces = pieces.repartition(shuffle_partitions(df.sparkSession), id_col, "_s")
        single = single.unionByName(pieces.withColumn("_i", F.explode(F.sequence("_s", F.least(F.col("_s") + group, F.col("_c")) - 1))).drop("_s"))
    room = F.greatest(F.lit(1), F.floor(F.lit(budget) / F.col("padded_to"))).cast("long")
    rank = F.col("_first") + F.col("_i")
    out = single.withColumn("_batch", F.floor(rank / room).cast("long")).withColumn("place", F.pmod(rank, room).cast("long"))
    return in_tasks(out.select(id_col, "n_tokens", "bucket", "padded_to", F.concat_ws("-", F.col("bucket"), F.col("_batch")).alias("batch_id"), "place"), n)


def joined(df: DataFrame, packed: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """``df`` with the columns of its packing, where ids are distinct."""
    new = ["n_tokens", "bucket", "padded_to", "batch_id", "place"]
    keep = without(df, new)
    return df.select(*[F.col(f"`{c}`") for c in keep]).join(packed, id_col).select(*keep, *new)
