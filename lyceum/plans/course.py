"""The two life cycles: build (files to chunks, graph and index) and ask (questions to decisions and answers)."""

from __future__ import annotations

import warnings as warnings_
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import constants as C
from ..functions import text as T
from ..operators import chunker, evaluate, gate, graph, incremental, search
from ..operators.sizes import LIMIT, checkpointed, numbered
from ..sources import files, versions


def chunks(spark: SparkSession, root: str, exclude: list[str] | None = None, timed: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(chunks, warnings) of all readable files below ``root``, in order of their paths."""
    parts = checkpointed(files.parse(files.discover(spark, root, exclude)))
    warnings = parts.filter("warning is not null").select("file_path", "warning")
    return placed(cut(parts, timed)), warnings


def cut(parts: DataFrame, timed: list[str] | None = None) -> DataFrame:
    """Chunks of files' parts, with their number ``n`` in the file; the time-sensitive ones among the files say what the term is."""
    rows = parts.filter("warning is null").withColumn("key", F.concat_ws("\x1f", "file_path", "part"))
    pieces = chunker.split(rows, "key", "text").join(rows.drop("text"), "key")
    order = Window.partitionBy("file_path").orderBy("part", "ordinal")
    pieces = pieces.withColumn("n", F.row_number().over(order) - 1)
    module, section = chunker.located(F.col("file_path"))
    out = pieces.select(
        F.concat_ws("_", "file_path", "n").alias("chunk_id"), "content", "token_estimate", "file_path", "file_type", module.alias("module"), section.alias("section"), "title", T.headings("content").alias("headings"), "location", "n",
    )
    timed = C.TIME_SENSITIVE_FILES if timed is None else timed
    term = _term(parts.filter(F.col("file_path").isin(*timed)))
    return chunker.timed(out, timed, *term).withColumn("id", F.col("chunk_id"))


def placed(cut_: DataFrame) -> DataFrame:
    """Chunks with ``pos``, their place in the order of the notes: each file starts where those before it end, so places have no gaps."""
    sizes = numbered(cut_.groupBy("file_path").agg(F.count("*").alias("_c")), "file_path", "_f")
    before = Window.partitionBy(F.lit(1)).orderBy("_f").rowsBetween(Window.unboundedPreceding, -1)  # one row a file
    starts = sizes.withColumn("_start", F.coalesce(F.sum("_c").over(before), F.lit(0))).select("file_path", "_start")
    return cut_.join(starts, "file_path").withColumn("pos", (F.col("_start") + F.col("n")).cast("long")).drop("_start", "n")


def _term(pages: DataFrame) -> tuple[str, str | None, str | None, str | None]:
    """Where the term stands and what it is, from the first time-sensitive page that states one."""
    row = pages.select("file_path", chunker.term_of(F.col("text")).alias("t")).filter("t.year is not null or t.academic_year is not null or t.semester is not null").orderBy("file_path").limit(1).collect()
    return (row[0].file_path, row[0].t.year, row[0].t.academic_year, row[0].t.semester) if row else ("", None, None, None)


@dataclass
class Build:
    chunks: DataFrame
    nodes: DataFrame
    edges: DataFrame
    path: DataFrame
    warnings: DataFrame
    version: versions.Version | None = None


#: The tables of a build. Those of the graph, which have the taxonomy's size, also stand in plain folders for readers that know no manifest.
TABLES, PLAIN = ("chunks", "nodes", "edges", "path", "warnings"), ("nodes", "edges", "path")


def build(spark: SparkSession, root: str, concepts: DataFrame, stop: list[str] | None = None, settings: DataFrame | None = None, out: str | None = None) -> Build:
    """Everything a course needs; with ``out`` its tables are published there together (``sources/versions.py``).

    A graph with problems is refused. After a build that is refused or dies, all tables that stood there stand there still, and what
    an earlier build returned can be read until its version expires (``versions.expire``).
    """
    rows, warnings = chunks(spark, root)
    store = versions.Store(spark, out) if out else None
    base = versions.current(store) if store else None
    staged: dict[str, str] = {}

    def put(name: str, df: DataFrame) -> DataFrame:
        if store is None:
            return checkpointed(df)
        staged[name] = versions.staged(store, df, name)
        return spark.read.parquet(f"{store.root}/{staged[name]}")

    try:
        tables = {"chunks": put("chunks", rows)}
        stops = spark.createDataFrame([(s,) for s in stop or []], "concept string")
        for name, df in zip(PLAIN, graph.build(tables["chunks"], concepts, stops, settings), strict=True):
            tables[name] = put(name, df)
        tables["warnings"] = put("warnings", warnings)
        problems = graph.validate(tables["nodes"], tables["edges"]).limit(5).collect()
        if problems:
            raise ValueError(f"the graph has problems: {[tuple(p) for p in problems]}")
        version = versions.commit(store, {name: [at] for name, at in staged.items()}, base=base) if store else None
    except BaseException:
        if store:
            versions.discard(store, list(staged.values()))
        raise
    for name in PLAIN if store else ():
        tables[name].write.mode("overwrite").parquet(f"{store.root}/{name}")
    return Build(**tables, version=version)


def opened(spark: SparkSession, out: str, number: int | None = None) -> Build:
    """The build published at ``out``, all tables of one version (None: the latest)."""
    store = versions.Store(spark, out)
    version = versions.current(store) if number is None else versions.opened(store, number)
    if version is None:
        raise FileNotFoundError(f"no build is published at {out}")
    return Build(**{name: versions.table(store, version, name) for name in TABLES}, version=version)


def refresh(spark: SparkSession, root: str, out: str, concepts: DataFrame, exclude: list[str] | None = None, timed: list[str] | None = None, aliases: dict[str, str] | None = None, trust_times: bool = True) -> tuple[incremental.State, DataFrame]:
    """Brings the stored chunks, term index, mentions and topics' edges at ``out`` up to date with the files below ``root``; gives them and what had changed (file, change).

    Files whose length and time of change are the recorded ones are not opened (``trust_times``); of the others only those with
    another hash are parsed. A time-sensitive file that changes takes all time-sensitive files along, since they state the term.
    """
    store = versions.Store(spark, out)
    state = incremental.opened(store)
    now = files.listing(spark, root, exclude)
    recorded = versions.table(store, state.version, "files") if state.version else spark.createDataFrame([], "file string, hash string, length long, modified timestamp")
    met = now.withColumnRenamed("file_path", "file").join(recorded.withColumnRenamed("length", "_l").withColumnRenamed("modified", "_m"), "file", "left")
    same = F.col("hash").isNotNull() & (F.col("length") == F.col("_l")) & (F.col("modified") == F.col("_m")) if trust_times else F.lit(False)
    met = checkpointed(met.withColumn("_same", F.coalesce(same, F.lit(False))))
    hashed = _contents(spark, root, exclude, met.filter("not _same").select("file")).select(F.col("file_path").alias("file"), incremental.file_hash(F.col("content")).alias("_hash"))
    fresh = checkpointed(met.drop("hash").filter("not _same").join(hashed, "file").select("file", F.col("_hash").alias("hash"), "length", "modified").unionByName(met.filter("_same").select("file", "hash", "length", "modified")))
    changed = checkpointed(incremental.changed(recorded, fresh))
    timed = C.TIME_SENSITIVE_FILES if timed is None else timed
    read = changed.filter("change <> 'removed'").select("file")
    if timed and not changed.filter(F.col("file").isin(*timed)).isEmpty():
        read = read.unionByName(fresh.filter(F.col("file").isin(*timed)).select("file")).distinct()
    read = checkpointed(read)
    parts = checkpointed(files.parse(_contents(spark, root, exclude, read)))
    gone = changed.filter("change <> 'added'").select(F.col("file").alias("file_path")).unionByName(read.select(F.col("file").alias("file_path")))
    tables = {"files": [versions.staged(store, fresh, "files")]}
    return incremental.advance(state, cut(parts, timed), gone, concepts, tables, aliases), changed


def _contents(spark: SparkSession, root: str, exclude: list[str] | None, wanted: DataFrame) -> DataFrame:
    """The ``wanted`` files (file) with their contents; up to LIMIT of them are opened by name, more by a scan of all."""
    names = [r["file"] for r in wanted.limit(LIMIT + 1).collect()]
    if not names:
        return files.discover(spark, root, exclude).limit(0)
    if len(names) <= LIMIT:
        return files.discover(spark, root, exclude, only=names)
    return files.discover(spark, root, exclude).join(wanted.withColumnRenamed("file", "file_path"), "file_path", "left_semi")


def extract_summary(chunks_: DataFrame, warnings: DataFrame) -> DataFrame:
    """One row: files, chunks, the term, the file types in order and the number of warnings."""
    term = F.max("temporal_context.year").alias("term") if "temporal_context" in chunks_.columns else F.lit(None).cast("string").alias("term")
    own = chunks_.agg(F.countDistinct("file_path").alias("files"), F.count("*").alias("chunks"), term, F.array_sort(F.collect_set("file_type")).alias("types"))
    return own.join(warnings.agg(F.count("*").alias("warnings")), F.lit(True))


def doctor(b: Build, recorded: DataFrame | None = None, now: DataFrame | None = None, concepts: DataFrame | None = None, questions: DataFrame | None = None) -> DataFrame:
    """(place, problem, subject): what a course lacks: unreadable files, graph problems, notes changed since the build (fingerprints
    (file, hash) ``recorded`` and ``now``), no concepts, no test questions, a term that no page states."""
    found = b.warnings.select(F.lit("notes").alias("place"), F.col("warning").alias("problem"), F.col("file_path").alias("subject"))
    found = found.unionByName(graph.validate(b.nodes, b.edges).select(F.lit("graph").alias("place"), "problem", "subject"))
    if recorded is not None and now is not None:
        found = found.unionByName(incremental.changed(recorded, now).select(F.lit("build").alias("place"), F.concat(F.lit("changed since the build: "), "change").alias("problem"), F.col("file").alias("subject")))

    def empty(df: DataFrame, place: str, problem: str) -> DataFrame:
        return df.agg(F.count("*").alias("n")).filter("n = 0").select(F.lit(place).alias("place"), F.lit(problem).alias("problem"), F.lit("").alias("subject"))

    found = found.unionByName(empty(b.chunks, "notes", "no text to read")).unionByName(empty(b.nodes.filter("type = 'keyword'") if concepts is None else concepts, "concepts", "none yet"))
    if questions is not None:
        found = found.unionByName(empty(questions, "questions", "no test questions"))
    return found


def search_queries(questions: DataFrame) -> DataFrame:
    """Questions with ``search``, what is searched for, and ``focused``: columns ``memory`` (turns before), ``context`` (terms) and ``selection``
    (a highlighted passage) count where there are such."""
    has = set(questions.columns)
    said = F.col("memory") if "memory" in has else F.array().cast("array<struct<role:string,content:string>>")
    query = gate.contextual_query(F.col("query"), said, F.col("context") if "context" in has else None)
    passage = T.text("selection") if "selection" in has else F.lit("")
    return questions.withColumn("search", gate.selected_query(query, passage)).withColumn("focused", F.trim(passage) != "")


def ask(course: DataFrame, questions: DataFrame, aliases: dict[str, str] | None = None, floor: float | None = None, index: search.Index | None = None, vectors: search.VectorIndex | None = None, on_decision=None) -> tuple[DataFrame, DataFrame]:
    """(results, decisions) of a batch of questions (qid, query; see ``search_queries``) over chunks; the text fallback needs no meaning floor.

    ``index`` and ``vectors``: as stored by a build. ``on_decision`` gets the decisions, for example to append them to a log; its errors don't stop an answer.
    """
    led = search_queries(questions)
    ranked = search.hybrid(course, led.select("qid", F.col("search").alias("query")), aliases=aliases, index=index, vectors=vectors)
    year = F.coalesce(F.col("temporal_context.academic_year"), F.col("temporal_context.year")) if "temporal_context" in course.columns else F.lit(None).cast("string")
    info = course.select("id", "title", "file_path", "module", "content", F.coalesce("location", F.lit("")).alias("location"), year.alias("year"))
    results = ranked.join(info, "id").withColumn("preview", T.preview("content"))
    vocabulary = (index or search.lexical_index(course, aliases)).terms if floor is not None else None
    decisions = gate.decide(led, results, vocabulary, floor, focused="focused")
    if on_decision is not None:
        try:
            on_decision(decisions)
        except Exception as e:  # noqa: BLE001 - noting a question must never stop its answer
            warnings_.warn(f"the decision hook failed: {e}", stacklevel=2)
    return results, decisions


def answers(course: DataFrame, questions: DataFrame) -> DataFrame:
    """The dry-run event stream of each question."""
    results, decisions = ask(course, questions)
    return gate.answer_events(gate.prompts(questions, decisions, gate.evidence(results)))


def check_drafts(course: DataFrame, drafts: DataFrame, aliases: dict[str, str] | None = None, floor: float | None = None, index: search.Index | None = None, vectors: search.VectorIndex | None = None) -> DataFrame:
    """Drafted questions (query, file_path, terms, as of ``suggest.questions``) with ``search_finds_it``: whether search finds the page and a term of it, and the gate lets it be answered.

    All drafts are one batch of ``ask``; repeated and null queries are asked once, each of their rows is judged by its own page and terms.
    """
    asked = drafts.select(T.text("query").alias("query")).distinct().withColumn("qid", F.sha2("query", 256))
    results, decisions = ask(course, asked, aliases, floor, index, vectors)
    results, decisions = checkpointed(results.select("qid", "file_path", "title", "preview")), checkpointed(decisions)
    rows = checkpointed(drafts.withColumn("_id", F.monotonically_increasing_id()).withColumn("_q", F.sha2(T.text("query"), 256)))
    # Results are a few a question: each draft gets its own copy of its query's.
    own = rows.select(F.col("_id").alias("id"), "_q", F.array(T.text("file_path")).alias("expected_files"), F.col("terms").alias("expected_terms"))
    labelled = own.select("id", "expected_files", "expected_terms", F.lit("answerable").alias("expected_status"), F.lit(None).cast("string").alias("expected_temporal_context"), F.lit(None).cast("boolean").alias("expected_multi_source"))
    of = lambda found: own.select("id", "_q").join(found.withColumnRenamed("qid", "_q"), "_q").drop("_q").withColumnRenamed("id", "qid")
    checked = evaluate.checks(labelled, of(results), of(decisions.select("qid", "status", "temporal_year", "multi_source")))
    return rows.join(checked.select(F.col("id").alias("_id"), F.col("passed").alias("search_finds_it")), "_id").drop("_id", "_q")


def changed_files(spark: SparkSession, root: str, recorded: DataFrame) -> DataFrame:
    """(file, change) against the recorded fingerprints (file, hash)."""
    now = files.discover(spark, root).select(F.col("file_path").alias("file"), incremental.file_hash(F.col("content")).alias("hash"))
    return incremental.changed(recorded, now)
