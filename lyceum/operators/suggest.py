"""Checks of proposed concepts and questions before they join the taxonomy or the question set."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from . import concepts as K
from .sizes import numbered

MIN_TERM, MAX_TERMS, QUESTION_CHARS = 3, 3, (10, 200)


def as_list(text: Column) -> Column:
    """A JSON string as a list of one, a JSON list's scalars as strings, anything else as an empty list."""
    kind = F.substring(F.trim(text), 1, 1)
    one = F.from_json(F.concat(F.lit("["), text, F.lit("]")), "array<string>")
    many = F.filter(F.from_json(text, "array<string>"), lambda x: x.isNotNull() & ~x.rlike(r"^\s*[\[{]"))
    return F.coalesce(F.when(kind == '"', one).when(kind == "[", many), F.array().cast("array<string>"))


def evenly_spaced(rows: DataFrame, k: int, order: str) -> DataFrame:
    """k of n rows at even distance, both ends included; halves round to even."""
    numbered_ = numbered(rows, order, "_i")
    n = rows.agg(F.count("*").alias("_n"))
    places = n.select("_n", F.explode(F.sequence(F.lit(0), F.greatest(F.least(F.lit(k), F.col("_n").cast("int")) - 1, F.lit(0)))).alias("_j"))
    step = F.when(F.least(F.lit(k), F.col("_n")) > 1, (F.col("_n") - 1) / (F.least(F.lit(k), F.col("_n")) - 1)).otherwise(F.lit(0.0))
    wanted = places.select(F.bround(F.col("_j") * step).cast("long").alias("_i")).distinct()
    return numbered_.join(F.broadcast(wanted), "_i", "left_semi").drop("_i")


def excerpts(chunks: DataFrame, budget: int, least: int = 200) -> DataFrame:
    """(module, excerpt): an even sample of a chapter's chunks, each with an equal share of the budget."""
    most = max(1, budget // least)
    n = F.count("*").over(Window.partitionBy("module"))
    i = F.row_number().over(Window.partitionBy("module").orderBy("pos")) - 1
    rows = chunks.withColumn("_n", n).withColumn("_i", i)
    k = F.least(F.lit(most), F.col("_n"))
    step = F.when(k > 1, (F.col("_n") - 1) / (k - 1)).otherwise(F.lit(1.0))
    near = F.exists(F.sequence(F.greatest(F.floor(F.col("_i") / step) - 1, F.lit(0)).cast("int"), F.least(F.ceil(F.col("_i") / step) + 1, k - 1).cast("int")), lambda j: F.bround(j * step).cast("int") == F.col("_i"))
    kept = rows.filter(near).withColumn("_t", F.substring("content", F.lit(1), T.excerpt_share(k, budget, least)))
    return kept.groupBy("module").agg(F.substring(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "_t"))), lambda x: x["_t"]), "\n"), 1, budget).alias("excerpt"))


def longest_pages(chunks: DataFrame, k: int = 3) -> DataFrame:
    """(module, file_path, chars): the k longest pages of each chapter."""
    total = chunks.groupBy("module", "file_path").agg(F.sum(F.length("content")).alias("chars"))
    order = Window.partitionBy("module").orderBy(F.desc("chars"), "file_path")
    return total.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def concepts(proposed: DataFrame, existing: DataFrame, chunks: DataFrame, most: int = 12) -> DataFrame:
    """New concepts with ids and how often the notes mention them: used aliases occur in the notes, and no alias or label is known already.

    ``proposed``: (pos, label, category, aliases).
    """
    known = existing.select(F.explode(F.array_union("aliases", F.array("label"))).alias("a")).select(T.normalized("a").alias("alias")).distinct()
    named = proposed.withColumn("_a", F.explode(F.array_union(F.coalesce("aliases", F.array().cast("array<string>")), F.array("label")))).withColumn("alias", T.normalized("_a")).filter("alias <> ''")
    fresh = named.join(named.join(known, "alias").select("pos").distinct(), "pos", "left_anti")
    used = K.alias_counts(chunks.select(F.monotonically_increasing_id().alias("_row"), T.normalized("content").alias("_t")), fresh, ["_row"])
    mentions = used.groupBy("alias").agg(F.sum("n").alias("n"))
    kept = fresh.join(mentions, "alias").groupBy("pos", "label", "category").agg(F.array_sort(F.collect_set("alias")).alias("aliases"), F.sum("n").alias("mentions")).orderBy("pos").limit(most)
    base = T.slug("label")
    rows = kept.withColumn("_id", base).withColumn("_n", F.row_number().over(Window.partitionBy("_id").orderBy("pos")))
    taken = existing.select(F.col("id").alias("_id"), F.lit(1).alias("_taken"))
    rows = rows.join(taken, "_id", "left").withColumn("_n", F.col("_n") + F.coalesce("_taken", F.lit(0)))
    return rows.select(F.when(F.col("_n") > 1, F.concat_ws("-", "_id", "_n")).otherwise(F.col("_id")).alias("id"), "label", "category", "aliases", "mentions")


def with_search(questions_: DataFrame, checked: DataFrame) -> DataFrame:
    """Drafted questions (id, ...) with ``search_finds_it``: what the evaluation's ``checked`` (id, passed) says of them."""
    return questions_.join(checked.select("id", F.col("passed").alias("search_finds_it")), "id", "left").withColumn("search_finds_it", F.coalesce("search_finds_it", F.lit(False)))


def load_chapters(chunks: DataFrame, settings: DataFrame | None = None) -> DataFrame:
    """(pos, module, name, chunks) of the chapters that are shown: configured ones in their order, then the others by folder; root and hidden ones are left out.

    ``settings``: (module, pos, name, show).
    """
    seen = chunks.groupBy("module").agg(F.count("*").alias("chunks"))
    if settings is None:
        rows = seen.withColumn("_pos", F.lit(None).cast("int")).withColumn("_name", F.lit(None).cast("string")).withColumn("show", F.lit(None).cast("string"))
    else:
        rows = seen.join(settings.select("module", F.col("pos").alias("_pos"), F.col("name").alias("_name"), "show"), "module", "left")
    shown = rows.filter("module <> 'root' and coalesce(show, '') <> 'hidden'")
    order = Window.partitionBy(F.lit(1)).orderBy(F.col("_pos").asc_nulls_last(), "module")  # one row a folder
    return shown.select((F.row_number().over(order) - 1).alias("pos"), "module", F.coalesce("_name", T.folder_title("module")).alias("name"), "chunks")


def questions(proposed: DataFrame, existing: DataFrame, chunks: DataFrame) -> DataFrame:
    """Proposed questions that are fair: new, of fair length, on an existing page, with at most three terms that stand on it as words.

    ``proposed``: (query, file_path, terms).
    """
    pages = chunks.groupBy("file_path").agg(F.array_distinct(F.flatten(F.collect_list(F.regexp_extract_all(T.normalized("content"), F.lit(T.WORD), F.lit(0))))).alias("_w"))
    rows = proposed.filter(F.length(F.trim("query")).between(*QUESTION_CHARS)).join(pages, "file_path")
    common = T.strings(["the", "and", "for"])
    fair = F.filter("terms", lambda t: (F.length(t) >= MIN_TERM) & ~F.array_contains(common, F.lower(t)) & F.forall(F.split(T.normalized(t), r"\s+"), lambda w: F.array_contains(F.col("_w"), w)))
    rows = rows.withColumn("terms", F.slice(fair, 1, MAX_TERMS)).filter(F.size("terms") > 0).drop("_w")
    known = existing.select(T.normalized("query").alias("_q")).distinct()
    return rows.withColumn("_q", T.normalized("query")).join(known, "_q", "left_anti").dropDuplicates(["_q"]).drop("_q")
