"""Splitting texts into chunks of 100 to 400 estimated tokens.

Sections begin at headings and hold paragraphs; a paragraph above the maximum is cut into sentences. Units are
packed greedily: the chunk is closed when the next unit would pass the maximum and the chunk has reached the
minimum. Sentences are joined by a blank, paragraphs by an empty line.

``split`` does that with an aggregate inside the plan, ``split_arrow`` in an Arrow task for very long texts, where
growing a string in an aggregate would cost quadratic time. Both give the same chunks.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

from .. import constants as C
from ..functions import text as T


def units(text: Column) -> Column:
    """array<struct<text, tokens, glue, first>> of paragraphs and, for long ones, sentences; ``first`` starts a section."""
    glue = lambda t, g: F.struct(t.alias("text"), T.token_estimate(t).alias("tokens"), F.lit(g).alias("glue"))

    def of_paragraph(p: Column) -> Column:
        return F.when(T.token_estimate(p) > C.CHUNK_MAX, F.transform(T.sentences(p), lambda s: glue(s, " "))).otherwise(F.array(glue(p, "\n\n")))

    def of_section(s: Column) -> Column:
        body = F.filter(T.paragraphs(s), lambda p: F.trim(p) != "")
        return F.transform(F.flatten(F.transform(body, of_paragraph)), lambda u, i: F.struct(u["text"].alias("text"), u["tokens"].alias("tokens"), u["glue"].alias("glue"), (i == 0).alias("first")))

    return F.flatten(F.transform(T.sections(text), of_section))


def packed(units_: Column) -> Column:
    """array<string> of chunk texts."""
    zero = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("cur"), F.lit(0.0).alias("size"))

    def step(acc: Column, u: Column) -> Column:
        close = (acc["size"] + u["tokens"] > C.CHUNK_MAX) & (acc["size"] > C.CHUNK_MIN)
        cur = F.when(close | (acc["cur"] == ""), u["text"]).otherwise(F.concat(acc["cur"], u["glue"], u["text"]))
        size = F.when(close, u["tokens"]).otherwise(acc["size"] + u["tokens"])
        done = F.when(close, F.concat(acc["done"], F.array(acc["cur"]))).otherwise(acc["done"])
        return F.struct(done.alias("done"), cur.alias("cur"), size.alias("size"))

    def finish(acc: Column) -> Column:
        everything = F.concat(acc["done"], F.array(acc["cur"]))
        return F.filter(F.transform(everything, lambda t: F.regexp_replace(t, r"^\s+|\s+$", "")), lambda t: t != "")

    return F.aggregate(units_, zero, step, finish)


def split(docs: DataFrame, key: str, text_col: str = "text") -> DataFrame:
    """(key, ordinal, content, token_estimate)."""
    rows = docs.select(key, F.posexplode(packed(units(T.text(text_col)))).alias("ordinal", "content"))
    return rows.select(key, "ordinal", "content", T.token_estimate("content").cast("int").alias("token_estimate"))


def chunk_text(text: str) -> list[str]:
    """The chunks of one text, by plain lists."""
    done: list[str] = []
    cur: list[str] = []
    size = 0.0

    def estimate(t: str) -> float:
        return len(re.findall(r"[^ \t\n\x0b\f\r]+", t)) * C.TOKENS_PER_WORD

    for section in re.split(r"\n(?=#{1,6}[ \t\n\x0b\f\r]+)", text):
        for paragraph in re.split(r"\n[ \t\n\x0b\f\r]*\n", section):
            if not paragraph.strip(" "):
                continue
            long = estimate(paragraph) > C.CHUNK_MAX
            for unit in re.split(r"(?<=[.!?])[ \t\n\x0b\f\r]+", paragraph) if long else [paragraph]:
                n = estimate(unit)
                if size + n > C.CHUNK_MAX and size > C.CHUNK_MIN:
                    done.append("".join(cur))
                    cur, size = [unit], n
                else:
                    cur += ([" " if long else "\n\n"] if any(cur) else []) + [unit]
                    size += n
    done.append("".join(cur))
    return [t for t in (re.sub(r"^[ \t\n\x0b\f\r]+|[ \t\n\x0b\f\r]+$", "", t) for t in done) if t]


def split_arrow(docs: DataFrame, key: str, text_col: str = "text") -> DataFrame:
    schema = StructType([docs.schema[key], StructField("ordinal", IntegerType()), StructField("content", StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(i, n, c) for i, t in zip(range(b.num_rows), b.column(1).to_pylist(), strict=True) for n, c in enumerate(chunk_text(t or ""))]
            at = pa.array([r[0] for r in rows], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0).take(at), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.string())], names=schema.names)

    rows = docs.select(key, text_col).mapInArrow(run, schema)
    return rows.withColumn("token_estimate", T.token_estimate("content").cast("int"))


def located(path: Column) -> tuple[Column, Column]:
    """Module and section of a file: its first folder (root without one) and its second (else its stem)."""
    parts = F.split(path, "/")
    stem = F.regexp_replace(F.element_at(parts, -1), r"\.[^.]*$", "")
    return F.when(F.size(parts) > 1, F.element_at(parts, 1)).otherwise(F.lit("root")), F.when(F.size(parts) > 2, F.try_element_at(parts, F.lit(2))).otherwise(stem)


def term_of(text: Column) -> Column:
    """struct<year, academic_year, semester> of a page that states its term."""
    found = lambda p, g: F.nullif(F.regexp_extract(text, p, g), F.lit(""))
    return F.struct(F.trim(found(r"(?mi)^-\s*Year:\s*(.+)$", 1)).alias("year"), found(r"(AY\d{4}/\d{4})", 1).alias("academic_year"), found(r"(?i)(Semester\s+\d+)", 1).alias("semester"))


def timed(chunks: DataFrame, files: list[str], source: str, year: str | None, academic_year: str | None, semester: str | None) -> DataFrame:
    """Chunks of time-sensitive files get the term, a flag, and a note in front of the content unless it is there."""
    note = "Temporal context: " + ", ".join(x for x in (academic_year, semester, year) if x)
    is_timed = F.col("file_path").isin(*files) if files else F.lit(False)
    context = F.struct(F.lit(source).alias("source"), F.lit(year).cast("string").alias("year"), F.lit(academic_year).cast("string").alias("academic_year"), F.lit(semester).cast("string").alias("semester"), F.lit(True).alias("requires_time_disambiguation"))
    led = F.when(is_timed & ~F.contains("content", F.lit(note)), F.concat(F.lit(note + "\n\n"), F.col("content"))).otherwise(F.col("content"))
    return chunks.withColumn("temporal_context", F.when(is_timed, context)).withColumn("temporal_context_note", F.when(is_timed, F.lit(note))).withColumn("time_sensitive", is_timed).withColumn("content", led)


def quality(chunks: DataFrame, short: int = 80, long: int = 450) -> DataFrame:
    """One row: count, min, median, mean and max of the token estimate, short, long and duplicate chunks."""
    t = F.col("token_estimate")
    dup = chunks.groupBy("chunk_id").agg(F.count("*").alias("n")).agg(F.count_if(F.col("n") > 1).alias("duplicate_ids"))
    own = chunks.agg(F.count("*").alias("n"), F.min(t).alias("least"), F.percentile(t, 0.5).alias("median"), F.round(F.avg(t), 6).alias("mean"), F.max(t).alias("greatest"), F.count_if(t < short).alias("short"), F.count_if(t > long).alias("long"))
    return own.join(dup, F.lit(True))
