"""Term index, BM25, TF-IDF, dense cosine and their fusion, for batches of questions.

Chunks have ``id``, ``content`` and, for the boosts, ``title``, ``file_path``, ``module``,
``time_sensitive``; questions have ``qid`` and ``query``. All questions are scored in one plan:
their terms meet the postings in an equi-join, so only chunks that share a term are touched.
Scores of chunks that no question term touches are zero and enter minima as such.
Ties in a ranking go to the greater id.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T_

from .. import constants as C
from ..functions import text as T
from . import counts, phrases, positions
from .positions import Places
from .sizes import LIMIT, broadcast_if_small, checkpointed, numbered, spread, stored


@dataclass
class Index:
    """postings(id, len, term, tf), each with the length of its chunk, lengths(id, len), stats(n, avgdl), terms(term, df, idf)."""

    postings: DataFrame
    lengths: DataFrame
    stats: DataFrame
    terms: DataFrame

    def persist(self, path: str) -> Index:
        """The index written as tables, postings clustered by term so that question terms prune files."""
        out = {}
        for name in ("postings", "lengths", "stats", "terms"):
            df = getattr(self, name)
            (df.repartitionByRange("term").sortWithinPartitions("term") if name == "postings" else df).write.mode("overwrite").parquet(f"{path}/{name}")
            out[name] = df.sparkSession.read.parquet(f"{path}/{name}")
        return Index(**out)


def lexical_index(chunks: DataFrame, aliases: dict[str, str] | None = None, keep: bool = False, asked: DataFrame | None = None) -> Index:
    """``keep``: the postings are written once as a table in the shared folder, for a plan that reads them several times.
    ``asked``: the index serves these terms (term) alone, for a single batch of questions; lengths and statistics are those of all chunks."""
    rows = spread(chunks.select("id", "content"), "id").select("id", T.tokens("content", aliases).alias("words"))
    lengths = rows.select("id", F.size("words").alias("len"))
    postings = counts.postings(rows)
    if asked is not None:
        # Where the texts are read, so no posting of another term moves.
        postings = postings.join(broadcast_if_small(asked.select("term").distinct()), "term", "left_semi").select(*postings.columns)
    postings = stored(postings) if keep else postings
    stats = lengths.agg(F.count("*").alias("n"), F.coalesce(F.avg("len"), F.lit(0.0)).alias("avgdl"))
    df = postings.groupBy("term").agg(F.count("*").alias("df"))
    terms = df.join(F.broadcast(stats), F.lit(True)).select("term", "df", F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf"))
    return Index(postings, lengths, stats, terms)


def question_terms(questions: DataFrame, aliases: dict[str, str] | None = None) -> DataFrame:
    """(qid, term, qtf) without stop terms."""
    rows = questions.select("qid", F.explode(T.content_tokens(T.tokens("query", aliases))).alias("term"))
    return rows.groupBy("qid", "term").agg(F.count("*").alias("qtf"))


def bm25(index: Index, qterms: DataFrame) -> DataFrame:
    """(qid, id, bm25) of chunks with a question term."""
    k1, b = C.BM25_K1, C.BM25_B
    # The questions' terms meet the terms first, then the postings; each has one term row at most, so one check of size serves both.
    small = qterms.limit(LIMIT + 1).count() <= LIMIT
    hint = F.broadcast if small else lambda df: df
    weighted = hint(qterms).join(index.terms, "term")
    hits = index.postings.join(hint(weighted), "term").join(F.broadcast(index.stats), F.lit(True))
    part = F.col("qtf") * F.col("idf") * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("len") / F.greatest("avgdl", F.lit(1.0))))
    return hits.groupBy("qid", "id").agg(F.sum(part).alias("bm25"))


@dataclass
class VectorIndex:
    """counts(id, term, tf), norms(id, norm), vocabulary(term, idf). Weights tf * idf / norm are made for asked terms only."""

    counts: DataFrame
    norms: DataFrame
    vocabulary: DataFrame

    def persist(self, path: str) -> VectorIndex:
        """The index written as tables, counts clustered by term so that question terms prune files."""
        out = {}
        for name in ("counts", "norms", "vocabulary"):
            df = getattr(self, name)
            (df if name == "norms" else df.repartitionByRange("term").sortWithinPartitions("term")).write.mode("overwrite").parquet(f"{path}/{name}")
            out[name] = df.sparkSession.read.parquet(f"{path}/{name}")
        return VectorIndex(**out)


def tfidf_index(chunks: DataFrame, keep: bool = False) -> VectorIndex:
    """``keep``: the counts are written once as a table in the shared folder, for a plan that reads them several times."""
    tf = counts.word_and_pair_counts(spread(chunks.select("id", "content"), "id").select("id", T.words_of("content").alias("words")))
    tf = stored(tf) if keep else tf
    n = chunks.agg(F.count("*").alias("n"))
    vocabulary = tf.groupBy("term").agg(F.count("*").alias("df")).join(F.broadcast(n), F.lit(True)).select("term", (F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1).alias("idf"))
    w = F.col("tf") * F.col("idf")
    norms = tf.join(vocabulary, "term").groupBy("id").agg(F.sqrt(F.sum(w * w)).alias("norm"))
    return VectorIndex(tf, norms, vocabulary)


def tfidf(index: VectorIndex, questions: DataFrame) -> DataFrame:
    """(qid, id, meaning): cosine of the TF-IDF vectors; terms outside the vocabulary don't count."""
    tf = questions.select("qid", F.explode(T.terms("query")).alias("term")).groupBy("qid", "term").agg(F.count("*").alias("qtf"))
    small = tf.limit(LIMIT + 1).count() <= LIMIT
    hint = F.broadcast if small else lambda df: df
    wq = hint(tf).join(index.vocabulary, "term").select("qid", "term", "idf", (F.col("qtf") * F.col("idf")).alias("wq"))
    wq = wq.withColumn("wq", F.col("wq") / F.sqrt(F.sum(F.col("wq") * F.col("wq")).over(Window.partitionBy("qid"))))
    # One factor per question and term: the term's idf in the chunk times its weight in the question.
    dots = index.counts.join(hint(wq.select("qid", "term", (F.col("idf") * F.col("wq")).alias("f"))), "term").groupBy("qid", "id").agg(F.sum(F.col("tf") * F.col("f")).alias("dot"))
    return dots.join(index.norms, "id").select("qid", "id", (F.col("dot") / F.col("norm")).alias("meaning"))


def unit(vector: Column) -> Column:
    norm = F.sqrt(F.aggregate(vector, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    return F.transform(vector, lambda x: x.cast("double") / F.when(norm > 0, norm).otherwise(F.lit(1.0)))


#: Questions that a task holds at once, and vectors that it scores against them at a time.
ASKED, SCORED = 2048, 1024


def units(column: pa.Array) -> tuple[np.ndarray, dict[int, np.ndarray]]:
    """The lengths of the vectors (-1 for one that is null or holds a null or NaN), and for each length its vectors scaled to norm 1 (zero stays zero)."""
    rows = [None if v is None else np.array(v, dtype=np.float64) for v in column.to_pylist()]
    lengths = np.array([-1 if r is None or np.isnan(r).any() else len(r) for r in rows], dtype=np.int64)
    out = {}
    for n in set(lengths.tolist()) - {-1}:
        m = np.stack([rows[i] for i in np.flatnonzero(lengths == n)])
        norms = np.sqrt((m * m).sum(axis=1, keepdims=True))
        out[n] = m / np.where(norms > 0, norms, 1.0)
    return lengths, out


def nearest(asked: dict[int, tuple[np.ndarray, np.ndarray]], k: int, digits: int, names: list[str]):
    """A mapper over rows (id, vector) to a task's best k of each question; ``asked`` has the numbers and vectors of the questions of each length."""

    def best(q: np.ndarray, score: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, ...]:
        place = np.unique(ids, return_inverse=True)[1]
        order = np.lexsort((-place, -score, q))
        q, score, ids = q[order], score[order], ids[order]
        heads = np.flatnonzero(np.concatenate([[True], q[1:] != q[:-1]]))
        nth = np.arange(len(q)) - np.repeat(heads, np.diff(np.append(heads, len(q))))
        return q[nth < k], score[nth < k], ids[nth < k]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, floor = None, np.full(max(int(q.max()) for q, _ in asked.values()) + 1, -np.inf)
        for whole in batches:
            for at in range(0, whole.num_rows, SCORED):
                b = whole.slice(at, SCORED)
                lengths, own = units(b.column(1))
                ids = b.column(0).to_numpy(zero_copy_only=False)
                for n, m in own.items():
                    if n not in asked:
                        continue
                    numbers, vectors = asked[n]
                    raw = vectors @ m.T * 10.0**digits
                    score = np.copysign(np.floor(np.abs(raw) + 0.5), raw) / 10.0**digits + 0.0
                    least = floor[numbers]
                    if len(m) > k:
                        least = np.maximum(least, np.partition(score, len(m) - k, axis=1)[:, len(m) - k])
                    i, j = np.nonzero(score >= least[:, None])
                    found = numbers[i], score[i, j], ids[lengths == n][j]
                    held = best(*(found if held is None else (np.concatenate(x) for x in zip(held, found, strict=True))))
                    # A question with k rows takes none below its last.
                    full = np.bincount(held[0], minlength=len(floor)) == k
                    last = np.full(len(floor), np.inf)
                    np.minimum.at(last, held[0], held[1])
                    floor = np.where(full, last, -np.inf)
        if held is not None:
            yield pa.RecordBatch.from_arrays([pa.array(held[0], pa.int64()), pa.array(held[2]), pa.array(held[1], pa.float64())], names=names)

    return run


def dense(vectors: DataFrame, asked: DataFrame, k: int, digits: int = 6) -> DataFrame:
    """(qid, id, score, rank): the k vectors (id, vector) of the greatest cosine, rounded, to each asked one (qid, vector).

    A stated set of questions against all rows, ASKED questions at a time: a block of them goes to every task, which multiplies
    it with its rows and gives its own best k of each; the best of these follow from one window. Vectors that are null, hold
    a null or NaN or have another length than the asked one have no score; the zero vector's is 0. Repeated ids stay apart; a row without an id is no answer.
    """
    spark = vectors.sparkSession
    own = vectors.select("id", "vector").filter("id IS NOT NULL")
    schema = T_.StructType([T_.StructField("_n", T_.LongType()), own.schema["id"], T_.StructField("score", T_.DoubleType())])
    questions = checkpointed(numbered(asked.select("qid", "vector"), "qid", "_n"))
    found = None
    for low in range(0, questions.count(), ASKED):
        block = questions.filter(F.col("_n").between(low, low + ASKED - 1)).select("_n", "vector").toArrow().combine_chunks()
        numbers = np.asarray(block.column("_n").combine_chunks()) - low
        lengths, of = units(block.column("vector").combine_chunks())
        if not of:
            continue
        mapper = nearest({n: (numbers[lengths == n], m) for n, m in of.items()}, k, digits, schema.names)
        part = checkpointed(topk(own.mapInArrow(mapper, schema), k, key="_n", digits=digits).withColumn("_n", F.col("_n") + low))
        found = part if found is None else found.unionByName(part)
    if found is None:
        found = spark.createDataFrame([], T_.StructType([*schema.fields, T_.StructField("rank", T_.IntegerType())]))
    return found.join(questions.select("_n", "qid"), "_n").select("qid", "id", "score", "rank")


def topk(scores: DataFrame, k: int, score: str = "score", key: str = "qid", tie: str = "id", digits: int = 6) -> DataFrame:
    """The best k rows of each key with ``rank``; scores are rounded before they are ranked."""
    order = Window.partitionBy(key).orderBy(F.desc(score), F.desc(tie))
    return scores.withColumn(score, F.round(score, digits)).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def minmax(scores: DataFrame, column: str, n: DataFrame, out: str) -> DataFrame:
    """``column`` scaled to 0..1 over all n chunks of each question; chunks without a row have zero. A constant column gives zeros."""
    per = scores.groupBy("qid").agg(F.count("*").alias("_k"), F.min(column).alias("_low"), F.max(column).alias("_high")).join(F.broadcast(n), F.lit(True))
    some = F.col("_k") < F.col("n")
    per = per.select("qid", F.when(some, F.least("_low", F.lit(0.0))).otherwise(F.col("_low")).alias("_low"), F.when(some, F.greatest("_high", F.lit(0.0))).otherwise(F.col("_high")).alias("_high"))
    close = F.abs(F.col("_high") - F.col("_low")) <= 1e-9 * F.greatest(F.abs("_high"), F.abs("_low"))
    # A row for each question; the scores are many more.
    rows = scores.join(per, "qid")
    return rows.withColumn(out, F.when(close, F.lit(0.0)).otherwise((F.col(column) - F.col("_low")) / (F.col("_high") - F.col("_low")))).drop("_low", "_high")


def question_features(questions: DataFrame, aliases: dict[str, str] | None = None) -> DataFrame:
    """Questions with their phrases and what they ask for."""
    words = T.tokens("query", aliases)
    has = lambda terms: F.arrays_overlap(words, T.strings(terms))
    return questions.select("qid", "query", T.query_phrases("query", aliases).alias("phrases"), has(C.LOGISTICS_TERMS).alias("logistics"), has(C.FIGURE_TERMS).alias("figures"), has(C.COMPARISON_TERMS).alias("compares"))


def searchable(chunks: DataFrame, aliases: dict[str, str] | None = None) -> DataFrame:
    """Chunks with their normalised texts, computed once for all questions."""
    head = T.normalize(F.concat_ws(" ", T.text("title"), T.text("file_path")), aliases)
    return chunks.withColumn("_head", head).withColumn("_all", T.normalize(F.concat_ws(" ", T.text("title"), T.text("file_path"), T.text("content")), aliases))


def text_places(chunks: DataFrame, aliases: dict[str, str] | None = None, keep: bool = True) -> tuple[Places, Places]:
    """Where the pieces of whole chunks and of their heads (title and path) stand, for phrases; ``keep`` as in ``placed``."""
    rows = searchable(chunks, aliases)
    return positions.placed(rows, "id", "_all", keep), positions.placed(rows, "id", "_head", keep)


def boosts(chunks: DataFrame, features: DataFrame, aliases: dict[str, str] | None = None, places: tuple[Places, Places] | None = None) -> DataFrame:
    """(qid, id, boost) of chunks that a question's boosts touch.

    With ``places`` (``text_places``) phrases are found from an index and no text is read again; without, in one pass over all texts,
    which costs less than an index for one batch.
    """
    asked = features.select("qid", F.explode("phrases").alias("pattern"))
    if places is not None:
        asked = checkpointed(asked)
        (whole, head), look = places, positions.occurrences
        compared = positions.containing(whole, "comparison")
    else:
        rows = searchable(spread(chunks, "id"), aliases)
        whole, head, look = "_all", "_head", lambda column, asked: phrases.occurrences(rows, "id", column, asked)
        compared = rows.filter(F.contains("_all", F.lit("comparison"))).select("id")
    found = [look(place, asked).withColumn("boost", F.lit(weight)) for place, weight in ((whole, C.BOOST_PHRASE), (head, C.BOOST_TITLE_PHRASE))]
    parts = [f.join(broadcast_if_small(asked), "pattern").groupBy("qid", "id").agg(F.sum("boost").alias("boost")) for f in found]
    # What holds for every question of a kind and every chunk of a kind is an equality of two flags.
    timed = chunks.filter(F.coalesce("time_sensitive", F.lit(False))).select("id")
    kinds = [("logistics", timed, C.BOOST_TEMPORAL), ("compares", compared, C.BOOST_COMPARISON)]
    for flag, rows, weight in kinds:
        own = rows.select("id", F.lit(True).alias("_kind"))
        parts.append(own.join(broadcast_if_small(features.filter(flag).select("qid", F.lit(True).alias("_kind"))), "_kind").select("qid", "id", F.lit(weight).alias("boost")))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.groupBy("qid", "id").agg(F.sum("boost").alias("boost"))


def fused(chunks: DataFrame, questions: DataFrame, lexical: DataFrame, meaning: DataFrame, aliases: dict[str, str] | None = None, places: tuple[Places, Places] | None = None) -> DataFrame:
    """(qid, id, bm25, meaning, score) of every chunk whose score can differ from that of an untouched one."""
    n = chunks.agg(F.count("*").alias("n"))
    features = question_features(questions, aliases)
    none = F.lit(0.0)
    a = minmax(lexical, "bm25", n, "part").select("qid", "id", "bm25", none.alias("meaning"), (C.FUSION_LEXICAL * F.col("part")).alias("score"))
    b = minmax(meaning, "meaning", n, "part").select("qid", "id", none.alias("bm25"), "meaning", (C.FUSION_MEANING * F.col("part")).alias("score"))
    c = boosts(chunks, features, aliases, places).select("qid", "id", none.alias("bm25"), none.alias("meaning"), F.col("boost").alias("score"))
    # The three parts add up, so a sum takes the place of outer joins.
    rows = a.unionByName(b).unionByName(c).groupBy("qid", "id").agg(F.sum("bm25").alias("bm25"), F.sum("meaning").alias("meaning"), F.sum("score").alias("score"))
    figures = chunks.filter("module = 'figures'").select("id", F.lit(C.FIGURE_FACTOR).alias("_factor"))
    rows = rows.join(figures, "id", "left").join(broadcast_if_small(features.select("qid", "figures")), "qid", "left")
    factor = F.when(F.coalesce("figures", F.lit(False)), F.lit(1.0)).otherwise(F.coalesce("_factor", F.lit(1.0)))
    return rows.select("qid", "id", "bm25", "meaning", (F.col("score") * factor).alias("score"))


def with_temporal_slot(ranked: DataFrame, k: int = C.TOP_K) -> DataFrame:
    """The top k of ranked candidates (qid, rank, logistics, timed); a logistics question without a timed row in its top k gets its best timed candidate in the last place."""
    of = Window.partitionBy("qid")
    first_timed = F.min(F.when(F.col("timed"), F.col("rank"))).over(of)
    swap = F.col("logistics") & (first_timed > k)
    rows = ranked.withColumn("_first", first_timed).withColumn("_swap", F.coalesce(swap, F.lit(False)))
    kept = rows.filter(((F.col("rank") <= k) & ~(F.col("_swap") & (F.col("rank") == k))) | (F.col("_swap") & (F.col("rank") == F.col("_first"))))
    return kept.withColumn("rank", F.least("rank", F.lit(k))).drop("_first", "_swap")


def hybrid(chunks: DataFrame, questions: DataFrame, k: int = C.TOP_K, candidates: int = C.CANDIDATES, aliases: dict[str, str] | None = None, index: Index | None = None, vectors: VectorIndex | None = None, places: tuple[Places, Places] | None = None) -> DataFrame:
    """The best k chunks of each question: (qid, rank, id, score, bm25, meaning, timed, logistics).

    From what is stored of ``index``, ``vectors`` and ``places``, the rest of them built; with none of them from passes over the chunks (``scan.py``).
    """
    if index is None and vectors is None and places is None:
        from . import scan  # it takes its rules from here

        rows = with_temporal_slot(scan.hybrid_candidates(chunks, questions, candidates, aliases), k)
        return rows.select("qid", "rank", "id", "score", F.round("bm25", 6).alias("bm25"), F.round("meaning", 6).alias("meaning"), "timed", "logistics")
    lexical = bm25(index or lexical_index(chunks, aliases, keep=True), question_terms(questions, aliases))
    meaning = tfidf(vectors or tfidf_index(chunks, keep=True), questions)
    rows = topk(fused(chunks, questions, lexical, meaning, aliases, places), candidates)
    asked = question_features(questions, aliases).select("qid", "logistics")
    timed = chunks.select("id", F.coalesce("time_sensitive", F.lit(False)).alias("timed"))
    rows = rows.join(broadcast_if_small(asked), "qid").join(timed, "id")
    return with_temporal_slot(rows, k).select("qid", "rank", "id", "score", F.round("bm25", 6).alias("bm25"), F.round("meaning", 6).alias("meaning"), "timed", "logistics")
