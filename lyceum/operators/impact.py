"""BM25's best k without scoring every chunk that a question touches.

A posting's impact is its BM25 part without the term's weight. Postings of a term lie in blocks of about BLOCK, each with postings of one
impact level and the greatest impact of the block, so a block says what it can add at most. A question first scores the strongest block of
each of its terms; the k-th best of these sums is a threshold that the k best chunks reach (parts are positive). Its terms
in order of their greatest parts: those whose greatest parts together stay below the threshold make no candidate (MaxScore), nor
does a block that stays below it with the greatest parts of all other terms. What is left is summed, candidates that can't reach the threshold
with the terms left aside go, and only for the rest are those terms' postings looked up.

The results are those of scoring everything: ``bm25`` and ``topk`` of ``search.py``.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import constants as C
from .search import Index, topk
from .sizes import LIMIT, broadcast_if_small, checkpointed, stored

#: Postings of a block, and levels of impact from 0 to k1 + 1.
BLOCK, LEVELS = 128, 32
#: Scores are ranked by six digits: what is nearer to the threshold than this may tie with it.
NEAR = 2e-6


@dataclass
class Blocks:
    """blocks(term, level, part, top, entries: id and impact), tops(term, idf, top)."""

    blocks: DataFrame
    tops: DataFrame


def impact(avgdl: Column) -> Column:
    k1, b = C.BM25_K1, C.BM25_B
    return F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("len") / F.greatest(avgdl, F.lit(1.0))))


def blocked(index: Index, keep: bool = True) -> Blocks:
    """The postings in blocks. Levels are dealt into as many parts as they need by the ids' hashes, so no task sorts or holds a whole term."""
    rows = index.postings.join(F.broadcast(index.stats.select("avgdl")), F.lit(True)).withColumn("impact", impact(F.col("avgdl")))
    rows = rows.select("term", "id", "impact", F.floor(F.col("impact") / (C.BM25_K1 + 1) * LEVELS).cast("int").alias("level"))
    parts = rows.groupBy("term", "level").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("parts"))
    dealt = rows.join(parts, ["term", "level"]).withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))
    blocks = dealt.groupBy("term", "level", "part").agg(F.max("impact").alias("top"), F.collect_list(F.struct("id", "impact")).alias("entries"))
    blocks = stored(blocks) if keep else blocks
    tops = blocks.groupBy("term").agg(F.max("top").alias("top")).join(index.terms.select("term", "idf"), "term")
    return Blocks(blocks, stored(tops) if keep else tops)


def plan(blocks: Blocks, qterms: DataFrame, k: int) -> DataFrame:
    """(qid, term, w, most, total, theta, makes): each asked term with its weight, its greatest part, the question's sum of these, its threshold, and whether the term makes candidates."""
    small = qterms.limit(LIMIT + 1).count() <= LIMIT
    hint = F.broadcast if small else lambda df: df
    asked = checkpointed(blocks.tops.join(hint(qterms), "term").select("qid", "term", (F.col("qtf") * F.col("idf")).alias("w"), (F.col("qtf") * F.col("idf") * F.col("top")).alias("most")))
    # The strongest block of every asked term.
    terms = broadcast_if_small(asked.select("term").distinct())
    first = blocks.blocks.join(terms, "term", "left_semi").groupBy("term").agg(F.max_by(F.struct("level", "part"), "top").alias("b"))
    seeds = blocks.blocks.join(broadcast_if_small(first.select("term", "b.level", "b.part")), ["term", "level", "part"], "left_semi")
    sums = parts_of(seeds, asked).groupBy("qid", "id").agg(F.sum("s").alias("s"))
    kth = Window.partitionBy("qid").orderBy(F.desc("s"))
    theta = sums.withColumn("_n", F.row_number().over(kth)).filter(F.col("_n") == k).select("qid", F.col("s").alias("theta"))
    up = Window.partitionBy("qid").orderBy("most", "term")
    rows = asked.join(theta, "qid", "left").withColumn("theta", F.coalesce("theta", F.lit(0.0)) - NEAR)
    below = F.sum("most").over(up.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return rows.withColumn("total", F.sum("most").over(Window.partitionBy("qid"))).withColumn("makes", below >= F.col("theta"))


def parts_of(blocks: DataFrame, asked: DataFrame) -> DataFrame:
    """(qid, id, s): the parts that blocks add to the questions of their terms."""
    met = blocks.join(broadcast_if_small(asked), "term")
    return met.select("qid", "w", F.explode("entries").alias("e")).select("qid", "e.id", (F.col("w") * F.col("e.impact")).alias("s"))


def used(blocks: Blocks, planned: DataFrame) -> DataFrame:
    """The blocks that make candidates, once for each question that uses them, with the question's columns."""
    makes = planned.filter("makes")
    met = blocks.blocks.join(broadcast_if_small(makes), "term")
    return met.filter(F.col("w") * F.col("top") + F.col("total") - F.col("most") >= F.col("theta"))


def best(blocks: Blocks, qterms: DataFrame, k: int = C.TOP_K) -> DataFrame:
    """(qid, id, score, rank): the k best chunks of each question."""
    planned = checkpointed(plan(blocks, qterms, k))
    # Of a skipped block of a term that makes candidates a chunk's part is not known: it is looked up as well.
    found = used(blocks, planned).select("qid", "theta", "total", "term", "most", "w", F.explode("entries").alias("e"))
    sums = found.groupBy("qid", F.col("e.id").alias("id")).agg(F.sum(F.col("w") * F.col("e.impact")).alias("s"), F.sum("most").alias("_seen"), F.first("total").alias("_total"), F.first("theta").alias("_theta"))
    able = checkpointed(sums.filter(F.col("s") + F.col("_total") - F.col("_seen") >= F.col("_theta")).select("qid", "id", "s"))
    # What was left aside: whole terms, and blocks of the others that were skipped.
    skipped = ~F.col("makes") | (F.col("w") * F.col("top") + F.col("total") - F.col("most") < F.col("theta"))
    aside = blocks.blocks.join(broadcast_if_small(planned), "term").filter(skipped).select("qid", "w", F.explode("entries").alias("e")).select("qid", "e.id", (F.col("w") * F.col("e.impact")).alias("s"))
    aside = aside.join(broadcast_if_small(able.select("qid", "id")), ["qid", "id"], "left_semi")
    scores = able.unionByName(aside).groupBy("qid", "id").agg(F.sum("s").alias("score"))
    return topk(scores, k)
