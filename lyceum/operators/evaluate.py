"""Evaluation of retrieval and gate over a table of labelled questions; all questions run in one plan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T


def _empty(c: str) -> Column:
    return F.size(F.coalesce(c, F.array().cast("array<string>"))) == 0


def checks(questions: DataFrame, results: DataFrame, decisions: DataFrame) -> DataFrame:
    """(id, file_hit, term_hit, status_ok, temporal_ok, multi_ok, passed); what a question doesn't expect holds."""
    hay = T.normalized(F.concat_ws(" ", T.text("file_path"), T.text("title"), T.text("preview")))
    found = results.groupBy(F.col("qid").alias("id")).agg(F.collect_set("file_path").alias("_files"), F.concat_ws(" ", F.collect_list(hay)).alias("_hay"))
    rows = questions.join(found, "id", "left").join(decisions.withColumnRenamed("qid", "id"), "id", "left")
    out = rows.select(
        "id",
        (_empty("expected_files") | F.coalesce(F.arrays_overlap("expected_files", "_files"), F.lit(False))).alias("file_hit"),
        (_empty("expected_terms") | F.coalesce(F.exists("expected_terms", lambda t: F.contains("_hay", T.normalized(t))), F.lit(False))).alias("term_hit"),
        F.coalesce(F.col("expected_status") == F.col("status"), F.col("expected_status").isNull()).alias("status_ok"),
        F.coalesce(F.col("expected_temporal_context") == F.col("temporal_year"), F.col("expected_temporal_context").isNull()).alias("temporal_ok"),
        F.coalesce(F.col("expected_multi_source") == F.col("multi_source"), F.col("expected_multi_source").isNull()).alias("multi_ok"),
    )
    return out.withColumn("passed", F.col("file_hit") & F.col("term_hit") & F.col("status_ok") & F.col("temporal_ok") & F.col("multi_ok"))


def summary(checked: DataFrame) -> DataFrame:
    return checked.agg(F.count("*").alias("n"), F.count_if("passed").alias("passed"), F.bool_and("passed").alias("all_passed"))


def displayed(results: DataFrame, expected: DataFrame, limit: int = 3) -> DataFrame:
    """Rows to show: the best, one for each expected file, one timed, then by rank up to ``limit``; a chunk once.

    ``expected``: (qid, file_path).
    """
    per_file = Window.partitionBy("qid", "file_path").orderBy("rank")
    marked = results.join(expected.withColumn("_want", F.lit(True)), ["qid", "file_path"], "left")
    marked = marked.withColumn("_nf", F.row_number().over(per_file)).withColumn("_nt", F.row_number().over(Window.partitionBy("qid", "timed").orderBy("rank")))
    priority = F.when(F.col("rank") == 1, 0).when(F.coalesce("_want", F.lit(False)) & (F.col("_nf") == 1), 1).when(F.col("timed") & (F.col("_nt") == 1), 2).otherwise(3)
    order = Window.partitionBy("qid").orderBy("_p", "rank")
    rows = marked.withColumn("_p", priority).withColumn("place", F.row_number().over(order))
    return rows.filter((F.col("place") <= limit) | (F.col("_p") < 3)).select("qid", "id", "rank", "place")


def retrieval(ranked: DataFrame, relevant: DataFrame, k: int = 5) -> DataFrame:
    """One row: questions with a relevant chunk, hit rate in the first k and mean reciprocal rank over them."""
    best = relevant.select("qid").distinct().join(ranked.join(relevant, ["qid", "id"], "left_semi").groupBy("qid").agg(F.min("rank").alias("r")), "qid", "left")
    return best.agg(F.count("*").alias("n"), F.round(F.avg(F.when(F.col("r") <= k, 1.0).otherwise(0.0)), 6).alias("hit_rate"), F.round(F.avg(F.coalesce(1.0 / F.col("r"), F.lit(0.0))), 6).alias("mrr"))
