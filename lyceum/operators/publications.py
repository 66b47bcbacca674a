"""BibTeX entries to a graph of papers, authors and themes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as C
from ..functions import text as T

def clean(c: Column) -> Column:
    """Escaped signs, dashes and ties replaced, braces dropped, blanks collapsed; accents are composed when entries are read."""
    out = F.replace(F.replace(F.regexp_replace(c, r"\\([&%#_$])", "$1"), F.lit("--"), F.lit("–")), F.lit("~"), F.lit(" "))
    return T.collapse(F.regexp_replace(out, "[{}]", ""))


def title_html(c: Column) -> Column:
    """A title that keeps sub- and superscript tags and no others."""
    return clean(F.regexp_replace(c, r"(?i)<(?!/?(?:sub|sup)>)[^>]*>", ""))


def plain(c: Column) -> Column:
    return F.regexp_replace(c, "<[^>]*>", "")


def person(c: Column) -> Column:
    """A name with the surname last and without marks."""
    name = T.collapse(F.regexp_replace(clean(c), "[*#]", ""))
    last, first = F.split_part(name, F.lit(","), F.lit(1)), F.trim(F.split_part(name, F.lit(","), F.lit(2)))
    return F.when(F.contains(name, F.lit(",")), F.trim(F.concat_ws(" ", first, F.trim(last)))).otherwise(name)


def people(c: Column) -> Column:
    return F.filter(F.transform(F.split(T.text(c), r"\s+and\s+"), person), lambda p: p != "")


def doi_link(c: Column) -> Column:
    return F.when(c.isNull() | (c == ""), F.lit(None)).when(c.startswith("http"), c).otherwise(F.concat(F.lit("https://doi.org/"), c))


def author_line(names: Column, most: int = C.MAX_AUTHORS) -> Column:
    return F.when(F.size(names) > most, F.concat(F.array_join(F.slice(names, 1, most), ", "), F.lit(" et al."))).otherwise(F.array_join(names, ", "))


def theme_label(c: Column, labels: dict[str, str | None]) -> Column:
    """A keyword's theme: as mapped (null leaves it out), else with each word's first letter raised."""
    raised = F.array_join(F.transform(F.split(F.trim(c), r"\s+"), lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, F.lit(2), F.length(w)))), " ")
    out, key = None, F.lower(F.trim(c))
    for k, v in labels.items():
        out = F.when(key == k.lower(), F.lit(v).cast("string")) if out is None else out.when(key == k.lower(), F.lit(v).cast("string"))
    return raised if out is None else out.otherwise(raised)


def collaborators(authorship: DataFrame, least: int = C.MIN_SHARED_PAPERS) -> DataFrame:
    """(author, papers) of authors with at least ``least`` distinct papers."""
    return authorship.groupBy("author").agg(F.countDistinct("paper").alias("papers")).filter(F.col("papers") >= least)


def qualified(authorship: DataFrame, least: int = C.MIN_SHARED_PAPERS) -> DataFrame:
    return authorship.select("paper", "author").distinct().join(collaborators(authorship, least).select("author"), "author", "left_semi")


def connected(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes that an edge touches."""
    ends = edges.select(F.col("source").alias("id")).unionByName(edges.select(F.col("target").alias("id")))
    return nodes.join(ends, "id", "left_semi")


def graph(entries: DataFrame, themes: dict[str, str | None] | None = None, me: str = "", least: int = C.MIN_SHARED_PAPERS, most: int = C.MAX_AUTHORS) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of papers, their themes and co-authors other than ``me``; isolated nodes are left out."""
    f = lambda k: F.try_element_at(F.col("fields"), F.lit(k))
    year = F.trim(T.text(f("year")))
    papers = entries.select(
        F.concat(F.lit("paper:"), T.dashed(F.col("key"))).alias("id"), plain(title_html(T.text(f("title")))).alias("label"), title_html(T.text(f("title"))).alias("title"),
        clean(F.coalesce(f("journal"), f("booktitle"), F.lit(""))).alias("venue"), people(f("author")).alias("names"), F.filter(F.split(T.text(f("keywords")), "[,;]"), lambda k: F.trim(k) != "").alias("keywords"),
        F.when(year.rlike("^[0-9]+$"), year.cast("int")).alias("year_int"), year.alias("year_raw"), F.coalesce(f("url"), doi_link(f("doi"))).alias("url"), "pos",
    )
    authorship = papers.select(F.col("id").alias("paper"), F.explode("names").alias("author")).filter(F.lower("author") != F.lower(person(F.lit(me)))).distinct()
    kept = qualified(authorship, least)
    themed = papers.select(F.col("id").alias("paper"), F.explode("keywords").alias("k")).select("paper", theme_label(F.col("k"), themes or {}).alias("theme")).filter("theme is not null").distinct()
    edges = kept.select(F.col("paper").alias("source"), F.concat(F.lit("person:"), T.dashed(F.col("author"))).alias("target"), F.lit("author").alias("type")).unionByName(
        themed.select(F.col("paper").alias("source"), F.concat(F.lit("theme:"), T.dashed(F.col("theme"))).alias("target"), F.lit("theme").alias("type"))
    )
    n = lambda t: F.lit(None).cast(t)
    a = papers.select("id", F.lit("paper").alias("type"), "label", "title", "venue", author_line(F.col("names"), most).alias("authors"), "url", "year_int", n("int").alias("papers"))
    b = kept.groupBy("author").agg(F.count("*").cast("int").alias("papers")).select(F.concat(F.lit("person:"), T.dashed(F.col("author"))).alias("id"), F.lit("person").alias("type"), F.col("author").alias("label"), n("string").alias("title"), n("string").alias("venue"), n("string").alias("authors"), n("string").alias("url"), n("int").alias("year_int"), "papers")
    c = themed.groupBy("theme").agg(F.count("*").cast("int").alias("papers")).select(F.concat(F.lit("theme:"), T.dashed(F.col("theme"))).alias("id"), F.lit("theme").alias("type"), F.col("theme").alias("label"), n("string").alias("title"), n("string").alias("venue"), n("string").alias("authors"), n("string").alias("url"), n("int").alias("year_int"), "papers")
    return connected(a.unionByName(b).unionByName(c), edges), edges
