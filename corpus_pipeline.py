"""A training-corpus pipeline of five operators.

Each stage takes (spark, docs, sf_dir) and works on all rows of its predecessor's output, which
``run`` writes as Parquet to the shared checkpoint folder and reads again; it removes a stage's table once the next
one is written. All but the last stage return the columns of ``documents`` and no others; an empty table stays empty.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lyceum.llm import packing, quality, similar, suffixdedup, toxicity
from lyceum.llm.common import remove, shared_folder, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Leaves out documents whose severity is at least 1 likelier than not.

    Null and empty texts have no feature, so they stay; repeated rows and null ids are judged like others.
    """
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs.select(*COLUMNS), model).filter("toxic = 0").select(*COLUMNS)


def drop_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Leaves out documents that the quality classifier scores below its threshold.

    Null counts as the empty text, whose score decides like any other; repeated rows and null ids are judged like others.
    """
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    return quality.score(docs.select(*COLUMNS), model).filter("predicted = 1").select(*COLUMNS)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document, that of the least id, of every group of linked fingerprints, and of these
    none whose five-word shingles are 0.8 or more similar to those of a document of smaller id.

    Fingerprints are of five-word shingles, too. Texts that are null or without words are one group; of rows of equal
    id and text one stays; null ids come last.
    """
    return similar.without_copies(docs.select(*COLUMNS), fingerprints=True)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts passages of 50 bytes or more that a document of smaller id holds; a character cut in part goes with them.

    Every document stays, with what is left of its text; a null text becomes empty. Rows of equal id don't repeat each
    other, and a null id counts as the least.
    """
    return suffixdedup.cut_texts(docs.select(*COLUMNS)).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The batch of every document and its place in it; null and empty texts have one token, repeated rows are packed as often as they occur."""
    return packing.pack(docs)


STAGES = [("toxicity", drop_toxic), ("quality", drop_low_quality), ("near_copies", drop_near_copies), ("repeats", cut_repeats), ("packing", pack)]

#: The classifiers and the indices have no SQL form; tests/llm checks the stages by brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(*COLUMNS)
    folder, before = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}", None
    for name, stage in STAGES:
        at = f"{folder}/{name}"
        stage(spark, docs, sf_dir).write.parquet(at)
        docs = spark.read.parquet(at)
        if before:
            remove(spark, before)
        before = at
    return docs
