"""Reports over event tables: outcomes, top lists, quotas, rosters and feedback."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import constants as C
from ..functions import text as T
from .sizes import numbered


def recent(rows: DataFrame, today: Column, days: int, day: str = "day") -> DataFrame:
    """Rows of the last ``days`` days (one at least), today included."""
    return rows.filter(F.col(day) >= F.date_sub(today, max(days, 1) - 1))


def outcomes(asks: DataFrame) -> DataFrame:
    """(status, label, n, percent)."""
    counts = asks.groupBy("status").agg(F.count("*").alias("n"))
    share = F.round(100.0 * F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(1))), 6)
    return counts.select("status", T.mapped(C.OUTCOMES, F.col("status"), "other").alias("label"), "n", share.alias("percent"))


def grouped(asks: DataFrame, columns: list[str]) -> DataFrame:
    """Counts by each column alone, in one pass: (kind, value, n)."""
    pairs = F.array(*[F.struct(F.lit(c).alias("kind"), F.col(c).cast("string").alias("value")) for c in columns])
    return asks.select(F.explode(pairs).alias("p")).groupBy("p.kind", "p.value").agg(F.count("*").alias("n"))


def most_common(rows: DataFrame, value: str, order: str, k: int) -> DataFrame:
    """(value, n): the k most frequent values; of equally frequent ones those seen first."""
    counts = rows.groupBy(value).agg(F.count("*").alias("n"), F.min(order).alias("_first"))
    return counts.orderBy(F.desc("n"), "_first", value).limit(k).drop("_first")


def top_concepts(asks: DataFrame, k: int) -> DataFrame:
    return most_common(asks.select("id", F.explode("concepts").alias("concept")), "concept", "id", k)


def first_files(asks: DataFrame, status: str, k: int) -> DataFrame:
    """The most frequent first files of asks with a status."""
    rows = asks.filter(F.col("status") == status).select("id", F.try_element_at("files", F.lit(1)).alias("file")).filter("file is not null")
    return most_common(rows, "file", "id", k)


def gaps(asks: DataFrame, k: int) -> DataFrame:
    """The last k questions that the notes didn't answer, oldest first."""
    last = asks.filter("status = 'weak_evidence' and question is not null").orderBy(F.desc("id")).limit(k)
    return last.orderBy("id")


def limited(log: DataFrame, key: str, day: str, order: list[str], limit: Column) -> DataFrame:
    """Requests with their number within a key's day, whether the quota accepts them, and what remains; a null limit is none."""
    w = Window.partitionBy(key, day).orderBy(*order)
    n = F.row_number().over(w)
    rows = log.withColumn("nth", n).withColumn("_limit", limit)
    accepted = F.col("_limit").isNull() | (F.col("nth") <= F.col("_limit"))
    return rows.withColumn("accepted", accepted).withColumn("remaining", F.when(F.col("_limit").isNull(), F.lit(-1)).otherwise(F.greatest(F.col("_limit") - F.col("nth"), F.lit(0))).cast("int")).drop("_limit")


def students(roster: DataFrame, usage: DataFrame) -> DataFrame:
    """The roster with each student's questions, most first; students without any have zero."""
    total = usage.groupBy("email").agg(F.sum("questions").alias("questions"))
    return roster.join(total, "email", "left").withColumn("questions", F.coalesce("questions", F.lit(0)).cast("long")).orderBy(F.desc("questions"), "email")


def unknown_users(roster: DataFrame, usage: DataFrame) -> DataFrame:
    """Users with questions that the roster doesn't list; anonymous ones (address:...) don't count."""
    named = usage.filter(~F.col("email").like("address:%")).groupBy("email").agg(F.sum("questions").cast("long").alias("questions"))
    return named.join(roster, "email", "left_anti")


def feedback_report(feedback: DataFrame) -> DataFrame:
    return feedback.groupBy("page").agg(F.count_if(F.col("rating") == "up").alias("up"), F.count_if(F.col("rating") == "down").alias("down"))


def newest(feedback: DataFrame, today: Column, days: int = 7) -> DataFrame:
    """Feedback (id, day, ...) of the last ``days`` days (one at least) with its ``place``, from 0 for the newest, the greatest id.

    Places come from sorted ranges, not from one task. Rows without a day are left out, those without an id stand last.
    """
    rows = recent(feedback, today, days).withColumn("_age", F.coalesce(-F.col("id").cast("long"), F.lit((1 << 63) - 1)))
    return numbered(rows, "_age", "place").drop("_age")


def chapter_of_files(files: DataFrame, topics: DataFrame) -> DataFrame:
    """(file, topic, chapter): the first topic that holds a file, and its chapter; null where none does."""
    first = Window.partitionBy("file").orderBy("pos")
    own = topics.withColumn("_n", F.row_number().over(first)).filter("_n = 1").select("file", "topic", "chapter")
    return files.join(own, "file", "left")
