"""What has changed since the last build, by content hashes, and indices that take in only that.

``advance`` keeps chunks, lengths, postings, mentions and the topics' mentions edges as logs of segments by file (``segments.py``).
An update reads the changed files' new chunks and, of what is stored, their old rows and the mentions of the topics they touch; it
writes these files' rows and these topics' edges. Document frequencies are a log of differences, sizes are two numbers in the manifest.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources import sinks, versions
from . import chunker, counts, graph, search
from .concepts import mentions
from .segments import Log
from .sizes import checkpointed


def file_hash(content: Column) -> Column:
    return F.substring(F.sha2(content.cast("binary"), 256), 1, 16)


def chunk_hash(chunk_id: Column, content: Column) -> Column:
    return T.content_hash([chunk_id.cast("string"), content], 24)


def digest(rows: DataFrame, value: str, length: int = 20) -> DataFrame:
    """One hash of all values whatever their order: a hash of 1,024 bucket hashes, so no task gathers all of them."""
    bucket = rows.select(F.pmod(F.xxhash64(value), F.lit(1024)).alias("b"), F.sha2(F.col(value).cast("string"), 256).alias("h"))
    # Sums of hash parts don't depend on order and keep partial aggregation.
    part = lambda i: F.sum(F.conv(F.substring("h", 1 + 15 * i, 15), 16, 10).cast("decimal(38,0)")).cast("string")
    sums = bucket.groupBy("b").agg(F.concat_ws("-", F.count("*").cast("string"), part(0), part(1), part(2), part(3)).alias("s"))
    return sums.agg(F.substring(F.sha2(F.concat_ws("|", F.transform(F.array_sort(F.collect_list(F.struct("b", "s"))), lambda x: F.concat_ws(":", x["b"], x["s"]))), 256), 1, length).alias("digest"))


def changed(old: DataFrame, new: DataFrame, key: str = "file", value: str = "hash") -> DataFrame:
    """(file, change): added, removed or edited, by a null-safe comparison of hashes."""
    rows = old.select(key, F.col(value).alias("_o"), F.lit(True).alias("_in_old")).join(new.select(key, F.col(value).alias("_n"), F.lit(True).alias("_in_new")), key, "full_outer")
    kind = F.when(F.col("_in_old").isNull(), "added").when(F.col("_in_new").isNull(), "removed").when(~F.col("_o").eqNullSafe(F.col("_n")), "edited")
    return rows.select(key, kind.alias("change")).filter("change is not null")


def reuse(chunks: DataFrame, cache: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Chunks whose hash the cache holds, with their vectors, and chunks that must be encoded."""
    cached = cache.dropDuplicates(["hash"])
    return chunks.join(cached, "hash"), chunks.join(cached, "hash", "left_anti")


def stages(notes_changed: bool, taxonomy_changed: bool, settings_changed: bool, force: bool = False) -> list[str]:
    """Which stages of a build must run again."""
    if force or settings_changed or notes_changed:
        return ["chunks", "graph", "index"]
    return ["graph"] if taxonomy_changed else []


def refreshed(chunks: DataFrame, path: str, encode=None) -> DataFrame:
    """(id, hash, vector) of chunks (id, hash, content), only those whose hash the cache at ``path`` lacks encoded anew; the cache then holds these vectors.

    ``encode`` maps (id, hash, content) to (id, hash, vector): an encoder of the user's, by default the offline stand-in.
    """
    spark = chunks.sparkSession
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    there = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)
    have, need = reuse(chunks, spark.read.parquet(path).select("hash", "vector")) if there else (None, chunks)
    new = (encode or encoded)(need.select("id", "hash", "content"))
    rows = new if have is None else have.select("id", "hash", "vector").unionByName(new)
    sinks.backed_up(rows, path)
    return spark.read.parquet(path)


def encoded(chunks: DataFrame, dims: int = 64) -> DataFrame:
    """Hashed term vectors of unit length, the offline stand-in for an encoder: (id, hash, vector)."""
    terms = chunks.select("id", "hash", F.explode(T.terms("content")).alias("t"))
    sums = terms.groupBy("id", "hash", F.pmod(F.xxhash64("t"), F.lit(dims)).alias("d")).agg(F.count("*").alias("n"))
    packed = sums.groupBy("id", "hash").agg(F.map_from_entries(F.collect_list(F.struct("d", F.sqrt(F.col("n").cast("double"))))).alias("m"))
    vector = F.transform(F.sequence(F.lit(0), F.lit(dims - 1)), lambda i: F.coalesce(F.element_at("m", i.cast("bigint")), F.lit(0.0)))
    return packed.select("id", "hash", search.unit(vector).alias("vector"))


def _topic(path: Column) -> Column:
    """What chooses the bucket of a file: its topic, so that a topic's rows lie in one bucket of every log."""
    return F.concat_ws("\x1f", *chunker.located(path))


def _summed(terms: DataFrame) -> DataFrame:
    return terms.groupBy("term").agg(F.sum("df").alias("df")).filter("df <> 0")


#: Logs: owner of a row, what chooses its bucket, and how rows add up where they do.
LOGS = {name: ("file_path", _topic, None) for name in ("chunks", "lengths", "postings", "mentions")} | {"topic_edges": ("topic", lambda t: t, None), "terms": ("term", lambda t: t, _summed)}
EMPTY = {"postings": "id string, len int, terms array<string>, tfs array<long>", "lengths": "id string, len int", "terms": "term string, df long"}


@dataclass
class State:
    """The logs of one published version."""

    store: versions.Store
    version: versions.Version | None

    def log(self, name: str, anew: bool = False) -> Log:
        owner, place, joined = LOGS[name]
        return Log(self.store, name, owner, place, None if anew or self.version is None else self.version.facts["logs"].get(name), joined=joined)

    def table(self, name: str) -> DataFrame | None:
        """The living rows of a log; None if it never had any."""
        return self.log(name).read()

    def index(self) -> search.Index:
        """The term index that a full build over the same files would give."""
        facts = self.version.facts
        n, total = facts["n"], facts["total"]
        stats = self.store.spark.range(1).select(F.lit(n).cast("long").alias("n"), F.lit(total / n if n else 0.0).cast("double").alias("avgdl"))
        postings, lengths, terms = (self.table(name) if self.table(name) is not None else self.store.spark.createDataFrame([], of) for name, of in EMPTY.items())
        terms = _summed(terms).select("term", "df", F.log(1 + (n - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf"))
        return search.Index(_exploded(postings), lengths.select("id", "len"), stats, terms)


def opened(store: versions.Store) -> State:
    return State(store, versions.current(store))


def _lexical(rows: DataFrame, aliases: dict[str, str] | None) -> DataFrame:
    """(file_path, id, len, terms, tfs) of chunks: the distinct terms of each and how often it has them, counted where the text is read."""
    return counts.term_lists(rows.select("file_path", "id", T.tokens("content", aliases).alias("words")))


def _exploded(kept: DataFrame) -> DataFrame:
    """(id, len, term, tf) of a log of postings, which has a row for each chunk."""
    return kept.select("id", "len", F.explode(F.arrays_zip("terms", "tfs")).alias("_t")).select("id", "len", F.col("_t.terms").alias("term"), F.col("_t.tfs").alias("tf"))


def _mentions_of(rows: DataFrame, concepts: DataFrame) -> DataFrame:
    return mentions(rows, concepts, ["file_path", "module", "section", "id"])


def advance(state: State, rows: DataFrame, gone: DataFrame, concepts: DataFrame, tables: dict[str, list[str]] | None = None, aliases: dict[str, str] | None = None) -> State:
    """The version after ``state`` in which the files ``gone`` (file_path) have the chunks ``rows`` (file_path, module, section, id, title, content, ...), or none.

    Of stored rows it reads those of ``gone`` and, for the edges, of the touched topics' buckets. A change of ``concepts`` makes all mentions anew from the
    stored chunks, and no posting. Everything is staged first and published in one step, with further ``tables`` that the caller has staged; a failure takes it back.
    """
    store, version = state.store, state.version
    logs = {name: state.log(name) for name in LOGS}
    before = set() if version is None else {f for log in logs.values() for f in log.folders()}
    gone = checkpointed(gone.select("file_path").distinct())
    taxonomy = digest(concepts.select(F.to_json(F.struct("id", "label", F.array_sort("aliases"))).alias("v")), "v").head()[0]
    same = version is not None and version.facts["taxonomy"] == taxonomy
    passing: list[str] = []

    def held(df: DataFrame) -> DataFrame:
        """``df`` as a folder of the store until the end of the update: computed once and read by column."""
        passing.append(versions.staged(store, df, "passing"))
        return store.spark.read.schema(df.schema).parquet(f"{store.root}/{passing[-1]}")

    try:
        rows = held(rows)
        old = {name: logs[name].read(owners=gone) for name in ("lengths", "postings", "mentions")}
        postings = held(_lexical(rows, aliases))
        lengths = postings.select("file_path", "id", "len")
        count = lambda df, sign: df.select(F.explode("terms").alias("term")).groupBy("term").agg((sign * F.count("*")).alias("df"))
        change = count(postings, 1) if old["postings"] is None else count(postings, 1).unionByName(count(old["postings"], -1))
        change = checkpointed(_summed(change))
        size = lambda df: (0, 0) if df is None else tuple(df.agg(F.count("*"), F.coalesce(F.sum("len"), F.lit(0))).head())
        (n, total), (less, shorter) = size(lengths), size(old["lengths"])
        topic = F.concat_ws("\x1f", "module", "section")
        found = held(_mentions_of(rows, concepts))
        if same:
            touched = found.select(topic.alias("topic")) if old["mentions"] is None else found.select(topic.alias("topic")).unionByName(old["mentions"].select(topic.alias("topic")))
            touched = checkpointed(touched.distinct())
        for name, new in (("chunks", rows), ("lengths", lengths), ("postings", postings)):
            logs[name].append(new, gone)
        logs["terms"].append(change)
        if same:
            logs["mentions"].append(found, gone)
            # The buckets of a topic's edges and of its files' mentions have the same numbers.
            near = logs["mentions"].read(logs["topic_edges"].buckets_of(touched))
            again = near.join(touched, topic == F.col("topic"), "left_semi") if near is not None else found
            logs["topic_edges"].append(_topic_edges(again), touched)
        else:
            for name in ("mentions", "topic_edges"):
                logs[name] = state.log(name, anew=True)
            chunks = logs["chunks"].read()
            logs["mentions"].append(_mentions_of(chunks, concepts) if chunks is not None else found)
            all_of = logs["mentions"].read()
            logs["topic_edges"].append(_topic_edges(all_of if all_of is not None else found))
        was = version.facts if version else {"n": 0, "total": 0}
        facts = {"taxonomy": taxonomy, "n": was["n"] + n - less, "total": was["total"] + total - shorter, "logs": {name: log.state for name, log in logs.items()}}
        kept = {name: of for name, of in (version.tables if version else {}).items() if name not in LOGS}
        published = versions.commit(store, {**kept, **{name: log.folders() for name, log in logs.items()}, **(tables or {})}, facts, version)
    except BaseException:
        versions.discard(store, [f for log in logs.values() for f in log.folders() if f not in before] + [f for of in (tables or {}).values() for f in of])
        raise
    finally:
        versions.discard(store, passing)
    return State(store, published)


def _topic_edges(mentioned: DataFrame) -> DataFrame:
    """The mentions edges of topics, each with its topic's key."""
    return graph.mentions_edges(mentioned, (F.concat_ws("\x1f", "module", "section").alias("topic"),))
