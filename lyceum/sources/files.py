"""Scans of folders and of structured files into DataFrames."""

from __future__ import annotations

import re
import tomllib
from collections.abc import Iterator
from pathlib import Path
from urllib.parse import unquote, urlparse

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import constants as C
from ..functions import privacy
from . import readers

PARTS = "file_path string, file_type string, title string, part int, text string, location string, warning string"
CHUNKS = (
    "chunk_id string, content string, token_estimate int, file_path string, file_type string, module string, section string, title string, "
    "headings array<struct<level:int,title:string,position:int>>, location string, time_sensitive boolean, temporal_context_note string, pos long, "
    "temporal_context struct<source:string,year:string,academic_year:string,semester:string,requires_time_disambiguation:boolean>"
)
CONCEPTS = "id string, label string, category string, aliases array<string>"
QUESTIONS = (
    "id string, query string, expected_status string, expected_action string, expected_temporal_context string, category string, notes string, "
    "expected_files array<string>, expected_terms array<string>, expected_citation_terms array<string>, expected_multi_source boolean, "
    "short_memory array<struct<role:string,content:string>>"
)


def relative_to(root: str) -> Column:
    """The path below ``root`` of a file's full address."""
    base = re.escape(unquote(urlparse(root).path).rstrip("/") + "/")
    return F.regexp_replace(F.coalesce(F.try_url_decode(F.replace("path", F.lit("+"), F.lit("%2B"))), "path"), f"^.*?{base}", "")


def discover(spark: SparkSession, root: str, exclude: list[str] | None = None, ignore: list[str] | None = None, suffixes: list[str] | None = None, only: list[str] | None = None) -> DataFrame:
    """Files below ``root`` with a known suffix (with or without its dot, in any case), outside ignored folders: path, length, content, sorted by path.

    ``only``: paths below the root; no other file is opened.
    """
    kept = _found(spark, root, exclude, ignore, suffixes, only)
    return kept.select("file_path", "file_type", "length", "content").orderBy("file_path")


def listing(spark: SparkSession, root: str, exclude: list[str] | None = None, ignore: list[str] | None = None, suffixes: list[str] | None = None) -> DataFrame:
    """(file_path, length, modified) of the files that ``discover`` finds; none is opened."""
    return _found(spark, root, exclude, ignore, suffixes).select("file_path", "length", F.col("modificationTime").alias("modified"))


def _found(spark: SparkSession, root: str, exclude: list[str] | None, ignore: list[str] | None, suffixes: list[str] | None, only: list[str] | None = None) -> DataFrame:
    ignored = F.array(*[F.lit(x) for x in (C.IGNORED_FOLDERS if ignore is None else ignore)]).cast("array<string>")
    paths = root if only is None else [f"{root.rstrip('/')}/{p}" for p in only]
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(paths).withColumn("file_path", relative_to(root))
    parts = F.split("file_path", "/")
    folders = F.slice(parts, F.lit(1), F.size(parts) - 1)
    suffix = F.lower(F.regexp_extract("file_path", r"(\.[^./]+)$", 1))
    kept = rows.filter(suffix.isin(*["." + s.lstrip(".").lower() for s in (suffixes or readers.READERS)]))
    kept = kept.filter(~F.exists(folders, lambda p: F.array_contains(ignored, p) | p.endswith(".egg-info")))
    if exclude:
        kept = kept.filter(~F.col("file_path").isin(*exclude))
    return kept.withColumn("file_type", suffix)


def parse(files: DataFrame) -> DataFrame:
    """Parts of files, one row each; a file that can't be read or has no text gives one row with a warning."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for path, kind, data in zip(b["file_path"], b["file_type"], b["content"], strict=True):
                title, parts, warning = readers.read(path, bytes(data))
                rows += [(path, kind, title, i, t, where, None) for i, (t, where) in enumerate(parts)] or [(path, kind, title, None, None, None, warning)]
            yield pd.DataFrame(rows, columns=[x.split()[0] for x in PARTS.split(", ")]).astype({"part": "Int32"})

    return files.select("file_path", "file_type", "content").mapInPandas(run, PARTS)


def contents(spark: SparkSession, toc: str) -> DataFrame:
    """Ordered file list (pos, file_path) of a table of contents (YAML, nested ``children``)."""
    import yaml  # optional

    found: list[str] = []

    def walk(items) -> None:
        for item in items or []:
            if isinstance(item, dict):
                if item.get("file"):
                    found.append(item["file"])
                walk(item.get("children"))

    walk((yaml.safe_load(Path(toc).read_text(encoding="utf-8")) or {}).get("project", {}).get("toc"))
    return spark.createDataFrame(list(enumerate(found)), "pos int, file_path string")


def listed(toc: DataFrame, files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Files in the order of the contents, and warnings for listed files that aren't there."""
    missing = toc.join(files.select("file_path"), "file_path", "left_anti")
    return toc.join(files, "file_path").orderBy("pos"), missing.select(F.concat(F.lit("Missing file: "), "file_path").alias("warning"))


def chunks(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(CHUNKS).json(path)


def concepts(spark: SparkSession, path: str) -> DataFrame:
    """Concepts from a list or an object with a list; items without a label are dropped."""
    raw = spark.read.text(path, wholetext=True)
    kind = f"array<struct<{_colons(CONCEPTS)}>>"
    listed_ = F.from_json("value", kind)
    inner = F.from_json("value", f"struct<concepts:{kind}>")["concepts"]
    rows = raw.select(F.explode(F.when(F.trim("value").startswith("["), listed_).otherwise(inner)).alias("c")).select("c.*")
    return rows.filter("label is not null").withColumn("aliases", F.coalesce("aliases", F.array().cast("array<string>")))


def _colons(schema: str) -> str:
    return re.sub(r"(^|, )(\w+) ", r"\1\2:", schema)


def questions(spark: SparkSession, path: str) -> DataFrame:
    """Labelled questions; ``query`` is required and ids default to q and the place in the file."""
    raw = spark.read.text(path, wholetext=True).select(F.posexplode(F.from_json("value", f"array<struct<{_colons(QUESTIONS)}>>")).alias("n", "q"))
    return raw.filter("q.query is not null").select("n", "q.*").withColumn("id", F.coalesce("id", F.concat(F.lit("q"), F.col("n") + 1))).drop("n")


#: Header words, letters only, that name a roster's columns.
ROSTER_HEADERS = {"email": ["email", "emailaddress", "mail"], "name": ["name", "fullname", "student"], "limit": ["limit", "dailylimit", "questions"]}


def roster(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(email, name, limit), the last row of an address counting, and rows whose address is invalid (line, email)."""
    # Read as one piece, so that ids count its lines.
    lines = spark.read.option("header", True).option("encoding", "UTF-8").option("multiLine", True).csv(path)
    plain = {re.sub("[^a-z]", "", c.lower().replace("\ufeff", "")): c for c in lines.columns}
    named = {k: next((plain[s] for s in synonyms if s in plain), None) for k, synonyms in ROSTER_HEADERS.items()}
    if named["email"] is None:
        raise ValueError("the roster needs an email column")
    pick = lambda k: F.trim(F.col(f"`{named[k]}`")) if named[k] else F.lit(None).cast("string")
    rows = lines.select((F.monotonically_increasing_id() + 2).alias("line"), privacy.email(pick("email")).alias("email"), pick("name").alias("name"), pick("limit").try_cast("int").alias("limit"))
    bad = rows.filter(F.col("email").isNotNull() & (F.col("email") != "") & ~privacy.is_email(F.col("email"))).select("line", "email")
    last = Window.partitionBy("email").orderBy(F.desc("line"))
    good = rows.filter(privacy.is_email(F.col("email"))).withColumn("_n", F.row_number().over(last)).filter("_n = 1")
    return good.select("email", "name", "limit"), bad


def server_events(lines: DataFrame) -> DataFrame:
    """Payloads of ``data:`` lines of an event stream (column ``value``), without the end mark."""
    body = F.trim(F.substring("value", 6, 1 << 30))
    return lines.filter(F.col("value").startswith("data:")).select(body.alias("data")).filter("data not in ('', '[DONE]')")


def reply_objects(c: Column, schema: str) -> Column:
    """Objects of the outermost JSON list in a model's reply; anything else gives an empty list."""
    body = F.regexp_extract(c, r"(?s)\[.*\]", 0)
    return F.coalesce(F.filter(F.from_json(body, f"array<{schema}>"), lambda x: x.isNotNull()), F.array().cast(f"array<{schema}>"))


def settings(path: str) -> dict:
    """A workspace's TOML settings, checked: types, chapters' ``show`` and suffixes."""
    with open(path, "rb") as f:
        s = tomllib.load(f)
    for chapter in s.get("chapters", []):
        if chapter.get("show", "primary") not in ("primary", "secondary", "hidden"):
            raise ValueError(f"unknown show of chapter {chapter.get('folder')}")
    kinds = s.get("files", {}).get("types", [])
    unknown = [t for t in kinds if "." + t.lstrip(".").lower() not in readers.READERS]
    if unknown:
        raise ValueError(f"unknown file types {unknown}")
    return s
