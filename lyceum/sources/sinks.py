"""Writers: tables, single documents, event logs and rewritten pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import constants as C
from ..functions import text as T


def write_chunks(chunks: DataFrame, path: str, fmt: str = "json") -> None:
    chunks.write.mode("overwrite").format(fmt).save(path)


def ask_rows(asks: DataFrame, keep_question: bool) -> DataFrame:
    """Event rows ready to append: at most 8 concepts and 3 files; the question collapsed to 500 characters, or null."""
    question = F.substring(T.collapse("question"), 1, 500) if keep_question else F.lit(None).cast("string")
    return asks.select("time", F.to_date("time").alias("day"), "app", "status", F.slice("concepts", 1, 8).alias("concepts"), F.slice("files", 1, 3).alias("files"), question.alias("question"))


def append_events(rows: DataFrame, path: str) -> None:
    """Appends to a log partitioned by day, so look-backs read only their days."""
    rows.write.mode("append").partitionBy("day").parquet(path)


def accepted_feedback(rows: DataFrame, cap: int = C.FEEDBACK_PER_DAY) -> DataFrame:
    """Valid ratings of a question, at most ``cap`` for a sender and day, in order of arrival."""
    order = Window.partitionBy("sender", "day").orderBy("time", "id")
    valid = rows.filter(F.col("rating").isin("up", "down") & (F.trim(T.text("question")) != ""))
    for name, n in C.FEEDBACK_CHARS.items():
        if name in rows.columns:
            # An answer keeps its line breaks; the rest is one line.
            valid = valid.withColumn(name, F.substring(T.text(name) if name == "answer" else T.collapse(name), 1, n))
    return valid.withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= cap).drop("_n")


def usage(log: DataFrame) -> DataFrame:
    """The usage table that increments would give, from the append-only log."""
    return log.groupBy("email", "day").agg(F.count("*").cast("int").alias("questions"))


def backed_up(df: DataFrame, path: str) -> None:
    """Overwrites the table at ``path``; what stood there is kept beside it under ``.bak``."""
    spark = df.sparkSession
    at, bak = (spark.sparkContext._jvm.org.apache.hadoop.fs.Path(p) for p in (path, path + ".bak"))
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    df.write.mode("overwrite").parquet(path + ".new")
    if fs.exists(at):
        fs.delete(bak, True)
        fs.rename(at, bak)
    fs.rename(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path + ".new"), at)


def merged(existing: DataFrame, new: DataFrame, key: str = "id", working: tuple[str, ...] = ()) -> DataFrame:
    """``existing`` and the rows of ``new`` under ids it lacks; its own rows never change."""
    fresh = new.drop(*working).join(existing.select(key), key, "left_anti")
    return existing.unionByName(fresh, allowMissingColumns=True)


def graph_document(nodes: DataFrame, edges: DataFrame, version: str = "1.3") -> DataFrame:
    """The graph as one JSON document (a product of the taxonomy's size), nodes and edges in canonical order."""
    n = nodes.agg(F.array_sort(F.collect_list(F.struct("type", "id", *[c for c in nodes.columns if c not in ("type", "id")]))).alias("nodes"))
    e = edges.agg(F.array_sort(F.collect_list(F.struct("type", "source", "target", *[c for c in edges.columns if c not in ("type", "source", "target")]))).alias("edges"))
    return n.join(e, F.lit(True)).select(F.to_json(F.struct(F.lit(version).alias("schema_version"), "nodes", "edges")).alias("value"))


def tagged(document: Column) -> Column:
    """The entity tag of a document."""
    return F.concat(F.lit('"'), F.substring(F.sha2(document, 256), 1, 16), F.lit('"'))


def squeezed(document: bytes) -> bytes:
    """A document for browsers that take gzip; equal documents give equal bytes."""
    import gzip

    return gzip.compress(document, 6, mtime=0)


def escaped_markdown(c: Column) -> Column:
    """Text that a Markdown report shows as it is."""
    return F.regexp_replace(c, r"([\\`*_{}\[\]()#+!|<>-])", r"\\$1")


def single_page(document: Column, title: Column, script: str) -> Column:
    """One HTML page that holds the graph document and the script that draws it."""
    shown = F.replace(F.replace(title, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    return F.concat(F.lit("<!doctype html><meta charset=utf-8><title>"), shown, F.lit("</title><main id=graph></main><script type=application/json id=data>"), embedded(document), F.lit("</script><script>"), embedded(F.lit(script)), F.lit("</script>"))


BEGIN, END = "<!-- assistant:begin -->", "<!-- assistant:end -->"


def without_widget(html: Column) -> Column:
    return F.regexp_replace(html, f"(?s){BEGIN}.*?{END}\\n?", "")


def with_widget(html: Column, prefix: Column, script: str = "assistant.js") -> Column:
    """A page with the widget's script before the end of its body; installing twice changes nothing."""
    block = F.concat(F.lit(f'{BEGIN}<script src="'), prefix, F.lit(f'{script}" defer></script>{END}\n'))
    bare = without_widget(html)
    return F.when(bare.contains("</body>"), F.replace(bare, F.lit("</body>"), F.concat(block, F.lit("</body>")))).otherwise(bare)


def embedded(document: Column) -> Column:
    """JSON that is safe inside a script element."""
    return F.replace(document, F.lit("</"), F.lit("<\\/"))


def rejected_feedback(rows: DataFrame) -> DataFrame:
    """Rows that ``accepted_feedback`` refuses for what they say, with the reason."""
    reason = F.when(~F.coalesce(F.col("rating").isin("up", "down"), F.lit(False)), "rating must be up or down").when(F.trim(T.text("question")) == "", "no question")
    return rows.withColumn("reason", reason).filter("reason is not null")


def report(lines: DataFrame, path: str, history: str | None = None) -> None:
    """A Markdown report, sorted by ``n``, to one file and, under a time stamp, to a history folder. Lines are written as they arrive."""
    import shutil
    from datetime import datetime, timezone
    from pathlib import Path

    with Path(path).open("w", encoding="utf-8") as f:
        for r in lines.orderBy("n").toLocalIterator():
            f.write(r["line"] + "\n")
    if history:
        Path(history).mkdir(parents=True, exist_ok=True)
        stamp = datetime.now(timezone.utc).strftime("%Y%m%d_%H%M%S")
        shutil.copyfile(path, Path(history) / f"{Path(path).stem}_{stamp}.md")
