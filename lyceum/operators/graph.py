"""The course graph: nodes, edges of all kinds, bridges, the learning path and its checks.

Input: chunks (id, pos, module, section, title, file_path, content), concepts
(id, label, category, aliases) and optional chapters (module, pos, name, show). Pairs come from
prefixes of what they share (``setjoin.py``), so neither all pairs nor all pairs of a common concept are made; concepts in ``stop``
don't bridge. Topic ids: one topic for each (module, section), titled by its first chunk.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import constants as C
from ..functions import text as T
from . import setjoin, summaries
from .concepts import mentions
from .sizes import broadcast_if_small, checkpointed


def chapters(chunks: DataFrame, settings: DataFrame | None = None) -> DataFrame:
    """(module, chapter_id, pos, name, visibility) in order of the notes; root is hidden unless it is configured."""
    seen = chunks.groupBy("module").agg(F.min("pos").alias("first"))
    own = seen if settings is None else seen.join(broadcast_if_small(settings.select("module", "show", F.col("name").alias("_name"), F.col("pos").alias("_pos"))), "module", "left")
    show = F.lit(None).cast("string") if settings is None else F.col("show")
    name = F.lit(None).cast("string") if settings is None else F.col("_name")
    order = [F.col("_pos").asc_nulls_last()] if settings is not None else []
    ranked = own.withColumn("pos", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(*order, "first")).cast("long"))
    return ranked.select("module", T.chapter_id(F.col("module")).alias("chapter_id"), "pos", F.coalesce(name, T.folder_title("module")).alias("name"), F.coalesce(show, F.when(F.col("module") == "root", "hidden").otherwise("primary")).alias("visibility"))


def topics(chunks: DataFrame) -> DataFrame:
    """(module, section, topic_id, title, ord, visibility): pages of a chapter, its index last."""
    first = chunks.groupBy("module", "section").agg(F.min_by("title", "pos").alias("title"), F.min("pos").alias("pos"), F.count("*").alias("chunks"))
    order = Window.partitionBy("module").orderBy(F.col("section") == "index", "section")
    return first.select("module", "section", T.topic_id(F.col("module"), F.col("section")).alias("topic_id"), "title", (F.row_number().over(order) - 1).alias("ord"), F.when(F.col("section") == "index", "secondary").otherwise("primary").alias("visibility"), "chunks")


def mentions_weight(n: Column) -> Column:
    return F.bround(F.least(F.lit(1.0), 0.45 + F.log1p(n) / 4), 4)


def covers_weight(topics_: Column, n: Column) -> Column:
    return F.bround(F.least(F.lit(1.0), 0.4 + 0.12 * topics_ + F.log1p(n) / 10), 4)


#: Chunk ids that an edge keeps as evidence.
EVIDENCE = 8
EDGE = ["source", "target", "type", "basis", "weight", "mention_count", "evidence"]


def _edge(source: Column, target: Column, kind: str, weight: Column, count: Column | None = None, basis: str = "", evidence: Column | None = None) -> list[Column]:
    none = F.array().cast("array<string>")
    return [source.alias("source"), target.alias("target"), F.lit(kind).alias("type"), F.lit(basis).alias("basis"), weight.cast("double").alias("weight"), (count if count is not None else F.lit(None)).cast("long").alias("mention_count"), (evidence if evidence is not None else none).alias("evidence")]


def mentions_edges(mentioned: DataFrame, also: tuple[Column, ...] = ()) -> DataFrame:
    """Topic to concept; ``also``: further columns from (module, section, concept)."""
    topic = ["module", "section", "concept"]
    chunk = mentioned.groupBy(*topic, F.col("id").cast("string").alias("id")).agg(F.sum("n").alias("n"))
    # Only the first eight ids of a topic are gathered; its ranks are cut before the rows move.
    first = chunk.withColumn("_n", F.row_number().over(Window.partitionBy(*topic).orderBy("id"))).filter(F.col("_n") <= EVIDENCE)
    ids = first.groupBy(*topic).agg(F.array_sort(F.collect_list("id")).alias("ids"))
    per = chunk.groupBy(*topic).agg(F.sum("n").alias("n")).join(ids, topic)
    return per.select(*also, *_edge(T.topic_id(F.col("module"), F.col("section")), T.keyword_id(F.col("concept")), "mentions", mentions_weight(F.col("n")), F.col("n"), evidence=F.col("ids")))


def covers_edges(mentioned: DataFrame) -> DataFrame:
    """Chapter to concept, by its topics that mention it."""
    per = mentioned.groupBy("module", "concept").agg(F.sum("n").alias("n"), F.countDistinct("section").alias("k"), F.array_sort(F.collect_set(T.topic_id(F.col("module"), F.col("section")))).alias("ids"))
    return per.select(*_edge(T.chapter_id(F.col("module")), T.keyword_id(F.col("concept")), "covers", covers_weight(F.col("k"), F.col("n")), F.col("n"), evidence=F.col("ids")))


def contains_edges(chunks: DataFrame) -> DataFrame:
    return topics(chunks).select(*_edge(T.chapter_id(F.col("module")), F.col("topic_id"), "contains", F.lit(1.0)))


def sequence_edges(chapters_: DataFrame) -> DataFrame:
    """Each shown chapter to the next. Chapters are few: one row a folder."""
    following = F.lead("chapter_id").over(Window.partitionBy(F.lit(1)).orderBy("pos"))
    return chapters_.filter("visibility <> 'hidden'").withColumn("_next", following).filter("_next is not null").select(*_edge(F.col("chapter_id"), F.col("_next"), "sequence", F.lit(0.5)))


def shared(rows: DataFrame, key: str, member: str) -> DataFrame:
    """(l, r, n_shared, n_l, n_r) of members that occur with a common key, l < r."""
    own = rows.select(key, member).distinct()
    sizes = own.groupBy(member).agg(F.count("*").alias("n"))
    pairs = own.withColumnRenamed(member, "l").join(own.withColumnRenamed(member, "r"), key).filter("l < r").groupBy("l", "r").agg(F.count("*").alias("n_shared"))
    return pairs.join(sizes.select(F.col(member).alias("l"), F.col("n").alias("n_l")), "l").join(sizes.select(F.col(member).alias("r"), F.col("n").alias("n_r")), "r")


def ochiai() -> Column:
    return F.col("n_shared") / F.sqrt(F.col("n_l").cast("double") * F.col("n_r"))


def jaccard() -> Column:
    return F.col("n_shared") / F.greatest(F.col("n_l") + F.col("n_r") - F.col("n_shared"), F.lit(1))


def related_concepts(mentioned: DataFrame, least: float = C.CONCEPT_SIMILARITY) -> DataFrame:
    """(l, r, score, n_shared): concepts that share topics, and chunks as well."""
    by_topic = mentioned.select(F.concat_ws("\x1f", "module", "section").alias("topic"), "concept")
    pairs = setjoin.similar(by_topic, "topic", "concept", setjoin.Threshold(1, "ochiai", least))
    # Only pairs that are similar look for a chunk that has both.
    return setjoin.meeting(pairs, mentioned, "id", "concept").withColumn("score", ochiai()).select("l", "r", "score", "n_shared")


def topic_bridges(mentioned: DataFrame, stop: DataFrame, shown: DataFrame | None = None, least: float = C.TOPIC_SIMILARITY, least_shared: int = C.TOPIC_SHARED) -> DataFrame:
    """(l, r, score, n_shared): pages of different chapters that share concepts outside ``stop``."""
    rows = mentioned.join(broadcast_if_small(stop), "concept", "left_anti").select("module", "section", "concept")
    if shown is not None:
        rows = rows.join(shown, ["module", "section"], "left_semi")
    own = rows.select(F.concat_ws("\x1f", "module", "section").alias("topic"), "concept")
    pairs = setjoin.similar(own, "concept", "topic", setjoin.Threshold(least_shared, "jaccard", least)).withColumn("score", jaccard())
    module = lambda c: F.split_part(F.col(c), F.lit("\x1f"), F.lit(1))
    return pairs.filter(module("l") != module("r")).select("l", "r", "score", "n_shared")


def chapter_bridges(mentioned: DataFrame, stop: DataFrame, least_shared: int = C.CHAPTER_SHARED) -> DataFrame:
    rows = mentioned.join(broadcast_if_small(stop), "concept", "left_anti")
    return setjoin.similar(rows, "concept", "module", setjoin.Threshold(least_shared)).withColumn("score", jaccard()).select("l", "r", "score", "n_shared")


def capped_pairs(pairs: DataFrame, cap: int = C.DEGREE_CAP, limit: int = 200_000) -> DataFrame:
    """Greedy choice of (l, r, score, ...) in order (score, l, r) descending with at most ``cap`` pairs a node.

    Up to ``limit`` candidates one task goes through them in order. Beyond that, rounds take every pair that is within
    the remaining quota of both ends among the undecided pairs; for a strict total order the result is the same.
    """
    if pairs.limit(limit + 1).count() <= limit:
        return _in_order(pairs, cap)
    return _in_rounds(pairs, cap)


def _in_order(pairs: DataFrame, cap: int) -> DataFrame:
    def choose(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["score", "l", "r"], ascending=False, kind="stable")
        degree: dict = {}
        keep = []
        for a, b in zip(pdf["l"], pdf["r"], strict=True):
            ok = degree.get(a, 0) < cap and degree.get(b, 0) < cap
            keep.append(ok)
            if ok:
                degree[a], degree[b] = degree.get(a, 0) + 1, degree.get(b, 0) + 1
        return pdf[keep]

    return pairs.groupBy().applyInPandas(choose, pairs.schema)


def _in_rounds(pairs: DataFrame, cap: int) -> DataFrame:
    chosen = None
    left = checkpointed(pairs)
    used = None
    while not left.isEmpty():
        ends = left.select(F.col("l").alias("node"), "l", "r", "score").unionByName(left.select(F.col("r").alias("node"), "l", "r", "score"))
        ends = ends.withColumn("_n", F.row_number().over(Window.partitionBy("node").orderBy(F.desc("score"), F.desc("l"), F.desc("r"))))
        if used is not None:
            ends = ends.join(used, "node", "left")
        quota = F.lit(cap) if used is None else F.lit(cap) - F.coalesce("used", F.lit(0))
        taken = ends.groupBy("l", "r", "score").agg(F.min((F.col("_n") <= quota).cast("int")).alias("ok")).filter("ok = 1").select("l", "r", "score").checkpoint()
        now = left.join(taken, ["l", "r", "score"], "left_semi").select(*pairs.columns)
        chosen = (now if chosen is None else chosen.unionByName(now)).checkpoint()
        used = chosen.select(F.explode(F.array("l", "r")).alias("node")).groupBy("node").agg(F.count("*").alias("used"))
        full = used.filter(F.col("used") >= cap).select("node")
        left = left.join(taken, ["l", "r", "score"], "left_anti").join(full.withColumnRenamed("node", "l"), "l", "left_anti").join(full.withColumnRenamed("node", "r"), "r", "left_anti").select(*pairs.columns).checkpoint()
    return chosen if chosen is not None else pairs.limit(0)


def with_evidence(pairs: DataFrame, rows: DataFrame, key: str, member: str, k: int | None = None) -> DataFrame:
    """``pairs`` (l, r, ...) with ``evidence``: the keys of ``rows`` that both members have, as sorted strings, the first ``k`` or all. Pairs without any have an empty one.

    A pair asks for the keys of its rarer member whether the other has them too; with ``k``, ranks are cut before the rows move.
    """
    own = rows.select(F.col(key).cast("string").alias("_key"), member).distinct()
    often = own.groupBy(member).agg(F.count("*").alias("n"))
    of = lambda end: often.select(F.col(member).alias(end), F.col("n").alias(f"_n{end}"))
    asked = pairs.select("l", "r").distinct().join(of("l"), "l").join(of("r"), "r")
    first = F.col("_nl") <= F.col("_nr")
    asked = asked.select("l", "r", F.when(first, F.col("l")).otherwise(F.col("r")).alias("_from"), F.when(first, F.col("r")).otherwise(F.col("l")).alias("_to"))
    both = asked.join(own.withColumnRenamed(member, "_from"), "_from").join(own.withColumnRenamed(member, "_to"), ["_to", "_key"], "left_semi")
    if k is not None:
        both = both.withColumn("_n", F.row_number().over(Window.partitionBy("l", "r").orderBy("_key"))).filter(F.col("_n") <= k)
    lists = both.groupBy("l", "r").agg(F.array_sort(F.collect_list("_key")).alias("evidence"))
    none = F.array().cast("array<string>")
    return pairs.join(lists, ["l", "r"], "left").withColumn("evidence", F.coalesce("evidence", none))


def related_edges(pairs: DataFrame, basis: str, left: Column, right: Column) -> DataFrame:
    """An edge for each pair, with its ``evidence`` if it has some."""
    return pairs.select(*_edge(left, right, "related", F.bround("score", 4), basis=basis, evidence=F.col("evidence") if "evidence" in pairs.columns else None))


def distinct_edges(edges: DataFrame, order: str = "emitted") -> DataFrame:
    """The first edge of each (source, target, type); ``related`` has no direction."""
    swap = (F.col("type") == "related") & (F.col("source") > F.col("target"))
    rows = edges.withColumn("_a", F.when(swap, F.col("target")).otherwise(F.col("source"))).withColumn("_b", F.when(swap, F.col("source")).otherwise(F.col("target")))
    first = Window.partitionBy("_a", "_b", "type").orderBy(order)
    return rows.withColumn("_n", F.row_number().over(first)).filter("_n = 1").drop("_a", "_b", "_n")


def main_chapter(mentioned: DataFrame, chapters_: DataFrame) -> DataFrame:
    """(concept, module, pos, n): the shown chapter that mentions a concept most, the earlier one on a tie."""
    shown = chapters_.filter("visibility = 'primary'").select("module", "pos", "chapter_id")
    per = mentioned.groupBy("concept", "module").agg(F.sum("n").alias("n")).join(broadcast_if_small(shown), "module")
    best = Window.partitionBy("concept").orderBy(F.desc("n"), "pos")
    return per.withColumn("_n", F.row_number().over(best)).filter("_n = 1").drop("_n")


def learning_path(mentioned: DataFrame, chapters_: DataFrame, stop: DataFrame, k: int = C.PATH_CONCEPTS) -> DataFrame:
    """(step, node, chapter, also_in): each shown chapter, then its k main concepts; the up to four other chapters in order."""
    shown = chapters_.filter("visibility = 'primary'").select("module", "pos", "chapter_id")
    own = main_chapter(mentioned, chapters_).join(broadcast_if_small(stop), "concept", "left_anti")
    best = Window.partitionBy("module").orderBy(F.desc("n"), "concept")
    picked = own.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
    per = mentioned.select("concept", F.col("module").alias("other")).distinct().join(broadcast_if_small(shown.select(F.col("module").alias("other"), F.col("pos").alias("other_pos"), F.col("chapter_id").alias("other_id"))), "other")
    others = picked.join(per, "concept").filter("other <> module").groupBy("concept").agg(F.array_sort(F.collect_list(F.struct("other_pos", "other_id"))).alias("_o"))
    also = F.coalesce(F.slice(F.transform("_o", lambda o: o["other_id"]), 1, 4), F.array().cast("array<string>"))
    concepts_ = picked.join(others, "concept", "left").select("pos", "rank", T.keyword_id(F.col("concept")).alias("node"), F.col("chapter_id").alias("chapter"), also.alias("also_in"))
    heads = shown.select("pos", F.lit(0).alias("rank"), F.col("chapter_id").alias("node"), F.col("chapter_id").alias("chapter"), F.array().cast("array<string>").alias("also_in"))
    # A few rows for each chapter.
    order = Window.partitionBy(F.lit(1)).orderBy("pos", "rank")
    return heads.unionByName(concepts_).select(F.row_number().over(order).alias("step"), "node", "chapter", "also_in")


def degrees(edges: DataFrame) -> DataFrame:
    return edges.select(F.explode(F.array("source", "target")).alias("id")).groupBy("id").agg(F.count("*").alias("degree"))


def validate(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(problem, subject): duplicate ids, missing ends, self edges, lone concepts, pages without chunks, mentions without evidence, edges that assign a meaning."""
    ids = nodes.select("id")
    dup = nodes.groupBy("id").agg(F.count("*").alias("n")).filter("n > 1").select(F.lit("duplicate node").alias("problem"), F.col("id").alias("subject"))
    ends = lambda side: edges.join(ids.distinct().withColumnRenamed("id", side), side, "left_anti").select(F.lit(f"missing {side}").alias("problem"), F.col(side).alias("subject"))
    loop = edges.filter("source = target").select(F.lit("self edge").alias("problem"), F.col("source").alias("subject"))
    lone = nodes.filter("type = 'keyword'").join(degrees(edges), "id", "left_anti").select(F.lit("orphan keyword").alias("problem"), F.col("id").alias("subject"))
    empty = nodes.filter("type = 'topic' and coalesce(chunks, 0) = 0").select(F.lit("topic without chunks").alias("problem"), F.col("id").alias("subject"))
    twice = edges.groupBy("source", "target", "type").agg(F.count("*").alias("n")).filter("n > 1").select(F.lit("duplicate edge").alias("problem"), F.concat_ws(" ", "source", "target", "type").alias("subject"))
    bare = edges.filter(F.size(F.coalesce("evidence", F.array().cast("array<string>"))) == 0).filter("type in ('mentions', 'covers')") if "evidence" in edges.columns else edges.limit(0)
    lack = bare.select(F.lit("edge without evidence").alias("problem"), F.concat_ws(" ", "source", "target", "type").alias("subject"))
    meaning = [c for c in ("predicate", "review_status") if c in edges.columns]
    judged = edges.filter(F.coalesce(*meaning).isNotNull() if meaning else F.lit(False)).select(F.lit("edge says what it means").alias("problem"), F.concat_ws(" ", "source", "target", "type").alias("subject"))
    out = dup
    for part in (ends("source"), ends("target"), loop, lone, empty, twice, lack, judged):
        out = out.unionByName(part)
    return out


def nodes(chunks: DataFrame, concepts: DataFrame, mentioned: DataFrame, chapters_: DataFrame) -> DataFrame:
    """(id, type, label, module, visibility, category, mention_count, chunks, chapter_id, source_file)."""
    null = lambda t: F.lit(None).cast(t)
    total = mentioned.groupBy("concept").agg(F.sum("n").alias("n"))
    a = chapters_.select(F.col("chapter_id").alias("id"), F.lit("chapter").alias("type"), F.col("name").alias("label"), "module", "visibility", null("string").alias("category"), null("long").alias("mention_count"), null("long").alias("chunks"), null("string").alias("chapter_id"), null("string").alias("source_file"))
    files = chunks.groupBy("module", "section").agg(F.min_by("file_path", "pos").alias("source_file"))
    b = topics(chunks).join(files, ["module", "section"]).select(F.col("topic_id").alias("id"), F.lit("topic").alias("type"), F.col("title").alias("label"), "module", "visibility", null("string").alias("category"), null("long").alias("mention_count"), "chunks", T.chapter_id(F.col("module")).alias("chapter_id"), "source_file")
    c = concepts.join(total, concepts["id"] == total["concept"]).select(T.keyword_id(F.col("id")).alias("id"), F.lit("keyword").alias("type"), "label", null("string").alias("module"), F.lit("primary").alias("visibility"), "category", F.col("n").alias("mention_count"), null("long").alias("chunks"), null("string").alias("chapter_id"), null("string").alias("source_file"))
    return a.unionByName(b).unionByName(c)


def build(chunks: DataFrame, concepts: DataFrame, stop: DataFrame, settings: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Nodes with concepts' summaries and chapters' outlines, edges in canonical order (type, source, target), and the learning path."""
    mentioned = checkpointed(mentions(chunks, concepts, ["module", "section", "id"]))
    order = chapters(chunks, settings)
    split = lambda c, i: F.split_part(F.col(c), F.lit("\x1f"), F.lit(i))
    topic = lambda c: T.topic_id(split(c, 1), split(c, 2))
    shown = topics(chunks).filter("visibility = 'primary'").select("module", "section")
    # Concepts are related by chunks, pages and chapters by concepts.
    spoken = mentioned.join(broadcast_if_small(stop), "concept", "left_anti").select("module", F.concat_ws("\x1f", "module", "section").alias("topic"), T.keyword_id(F.col("concept")).alias("keyword"))
    alike = with_evidence(related_concepts(mentioned), mentioned, "id", "concept", EVIDENCE)
    pages = with_evidence(capped_pairs(topic_bridges(mentioned, stop, shown)), spoken, "keyword", "topic")
    chapters_alike = with_evidence(capped_pairs(chapter_bridges(mentioned, stop)), spoken, "keyword", "module")
    parts = [
        contains_edges(chunks),
        mentions_edges(mentioned),
        covers_edges(mentioned),
        sequence_edges(order),
        related_edges(alike, "evidence", T.keyword_id(F.col("l")), T.keyword_id(F.col("r"))),
        related_edges(pages, "keywords", topic("l"), topic("r")),
        related_edges(chapters_alike, "keywords", T.chapter_id(F.col("l")), T.chapter_id(F.col("r"))),
    ]
    edges = None
    for i, part in enumerate(parts):
        part = part.withColumn("emitted", F.lit(i))
        edges = part if edges is None else edges.unionByName(part)
    described = with_texts(nodes(chunks, concepts, mentioned, order), chunks, concepts)
    return described.orderBy("type", "id"), distinct_edges(edges).drop("emitted").orderBy("type", "source", "target"), learning_path(mentioned, order, stop)


def with_texts(nodes_: DataFrame, chunks: DataFrame, concepts: DataFrame) -> DataFrame:
    """Nodes with ``summary``, ``summary_file`` (concepts: the sentence that introduces them; chapters: the overview's first sentences), ``overview`` and ``objectives``."""
    said = summaries.concept_summaries(chunks, concepts).select(T.keyword_id(F.col("concept")).alias("id"), "summary", "summary_file")
    outlines = summaries.outlines(chunks).select(T.chapter_id(F.col("module")).alias("id"), F.nullif("overview", F.lit("")).alias("overview"), "objectives")
    rows = nodes_.join(said, "id", "left").join(outlines, "id", "left")
    return rows.withColumn("summary", F.coalesce("summary", F.nullif(summaries.intro(T.text("overview")), F.lit(""))))
