"""The registry, and the driver tables in the shape that the operators take."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query under its function's name, with the SQL that states it independently."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as chunks: language as module, source as section, every 50th time-sensitive."""
    d = table(spark, sf_dir, "documents")
    path = F.concat(F.col("lang"), F.lit("/"), F.col("source"), F.lit("/"), F.col("doc_id"), F.lit(".md"))
    return d.select(F.col("doc_id").alias("id"), F.col("doc_id").alias("pos"), F.col("text").alias("content"), F.col("lang").alias("module"), F.col("source").alias("section"), F.col("source").alias("title"), path.alias("file_path"), (F.pmod("doc_id", F.lit(50)) == 0).alias("time_sensitive"), path.alias("chunk_id"))


CHUNKS_SQL = """chunks AS (SELECT doc_id AS id, doc_id AS pos, text AS content, lang AS module, source AS section, source AS title,
  lang || '/' || source || '/' || CAST(doc_id AS VARCHAR) || '.md' AS file_path, doc_id % 50 = 0 AS time_sensitive FROM documents)"""

def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole benchmark texts as questions; every third asks for a date, every seventh compares."""
    b = table(spark, sf_dir, "benchmark")
    lead = F.when(F.pmod("item_id", F.lit(3)) == 0, F.lit("when is ")).when(F.pmod("item_id", F.lit(7)) == 1, F.lit("compare ")).otherwise(F.lit(""))
    return b.select(F.col("item_id").alias("qid"), F.concat(lead, "text").alias("query"))


QUESTIONS_SQL = """questions AS (SELECT item_id AS qid, CASE WHEN item_id % 3 = 0 THEN 'when is ' WHEN item_id % 7 = 1 THEN 'compare ' ELSE '' END
  || text AS query FROM benchmark)"""
