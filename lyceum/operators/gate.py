"""Rules that decide whether retrieved rows can support an answer, and what goes into a prompt."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import constants as C
from ..functions import text as T


def close_to_leader(results: DataFrame, top: int = 5) -> DataFrame:
    """Rows among the first ``top`` whose score reaches the leader's share."""
    leader = F.first("score").over(Window.partitionBy("qid").orderBy("rank"))
    return results.filter(F.col("rank") <= top).withColumn("_lead", leader).filter(F.col("score") >= C.LEADER_RATIO * F.col("_lead")).drop("_lead")


def multi_source(results: DataFrame) -> DataFrame:
    """(qid, multi_source): at least two modules or three files among the rows close to the leader."""
    return close_to_leader(results).groupBy("qid").agg(((F.countDistinct("module") >= 2) | (F.countDistinct("file_path") >= 3)).alias("multi_source"))


def off_topic(top_meaning: Column, known: Column, floor: float | None = C.MEANING_FLOOR) -> Column:
    """Too little likeness of meaning, or little and most words unknown; without a floor never."""
    if floor is None:
        return F.lit(False)
    return (top_meaning < floor) | ((top_meaning < floor + C.MEANING_MARGIN) & (known < C.KNOWN_SHARE))


def content_words(query: Column) -> Column:
    """A question's distinct words of more than two letters that aren't numbers or common."""
    common = T.strings(C.COMMON_WORDS)
    return F.array_distinct(F.filter(T.tokens(query), lambda w: (F.length(w) > 2) & ~w.rlike("^[0-9]+$") & ~F.array_contains(common, w)))


def known_share(questions: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """(qid, known): the share of a question's content words that the notes hold; 1 without any."""
    words = questions.select("qid", F.explode_outer(content_words(F.col("query"))).alias("term"))
    marked = words.join(vocabulary.select("term").distinct().withColumn("_known", F.lit(1)), "term", "left")
    share = F.sum(F.when(F.col("_known") == 1, 1).otherwise(0)) / F.nullif(F.count("term"), F.lit(0))
    return marked.groupBy("qid").agg(F.coalesce(share, F.lit(1.0)).alias("known"))


def decide(questions: DataFrame, results: DataFrame, vocabulary: DataFrame | None = None, floor: float | None = None, focused: bool | str = False) -> DataFrame:
    """(qid, status, confidence, needs_temporal, temporal_year, multi_source) by the first rule that holds.

    ``focused`` (a flag, or a column of the questions): a highlighted passage says what is meant, so a question is neither too broad nor off topic.
    ``results`` are ranked rows (qid, rank, score, bm25, meaning, module, file_path, timed, year).
    """
    words = T.tokens("query")
    q = questions.select(
        "qid",
        F.arrays_overlap(words, T.strings(C.OUT_OF_SCOPE_TERMS)).alias("foreign"),
        F.arrays_overlap(words, T.strings(C.LOGISTICS_TERMS)).alias("logistics"),
        F.arrays_overlap(words, T.strings(C.BROAD_TERMS)).alias("broad"),
        F.size(F.array_distinct(words)).alias("n_words"),
        (F.coalesce(F.col(focused), F.lit(False)) if isinstance(focused, str) else F.lit(focused)).alias("focused"),
    )
    best = results.groupBy("qid").agg(
        F.min_by("score", "rank").alias("score"),
        F.min_by("bm25", "rank").alias("bm25"),
        F.min_by("meaning", "rank").alias("meaning"),
        F.max(F.when(F.col("rank") <= 5, F.col("meaning"))).alias("meaning5"),
        F.min_by("year", F.when(F.col("timed") & F.col("year").isNotNull(), F.col("rank"))).alias("temporal_year"),
    )
    rows = q.join(best, "qid", "left").join(multi_source(results), "qid", "left")
    off = F.lit(False)
    if vocabulary is not None and floor is not None:
        rows = rows.join(known_share(questions, vocabulary), "qid", "left")
        off = off_topic(F.col("meaning5"), F.col("known"), floor)
    weak = (F.col("score") < C.WEAK_SCORE) | ((F.col("bm25") <= C.MIN_LEXICAL) & (F.col("meaning") < C.MIN_MEANING))
    status = (
        F.when(F.col("score").isNull(), "weak_evidence")
        .when(F.col("foreign"), "out_of_scope")
        .when(weak, "weak_evidence")
        .when(F.col("logistics") & F.col("temporal_year").isNull(), "needs_time_context")
        .when(~F.col("focused") & F.col("broad") & (F.col("n_words") <= C.BROAD_TOKENS), "needs_clarification")
        .when(~F.col("focused") & off, "out_of_scope")
        .when(F.col("logistics"), "needs_time_context")
        .otherwise("answerable")
    )
    return rows.select("qid", status.alias("status"), F.coalesce("score", F.lit(0.0)).alias("confidence"), F.col("logistics").alias("needs_temporal"), F.when(F.col("logistics"), F.col("temporal_year")).alias("temporal_year"), F.coalesce("multi_source", F.lit(False)).alias("multi_source"))


def next_action(status: Column) -> Column:
    return T.mapped(C.NEXT_ACTIONS, status, "inspect_manually")


def evidence(results: DataFrame, limit: int | None = None) -> DataFrame:
    """Rows with a sufficient score or a term; the first row where none has."""
    good = (F.col("score") >= C.EVIDENCE_SCORE) | F.col("timed")
    any_good = F.max(good).over(Window.partitionBy("qid"))
    rows = results.withColumn("_good", good).withColumn("_any", any_good).filter(F.col("_good") | (~F.col("_any") & (F.col("rank") == 1))).drop("_good", "_any")
    if limit is None:
        return rows
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy("qid").orderBy("rank"))).filter(F.col("_n") <= limit).drop("_n")


def distinct_sources(results: DataFrame) -> DataFrame:
    """The first row by rank of each (title, file, location)."""
    first = Window.partitionBy("qid", "title", "file_path", "location").orderBy("rank")
    return results.withColumn("_n", F.row_number().over(first)).filter("_n = 1").drop("_n")


def memory(turns: DataFrame, k: int = C.MEMORY_TURNS, chars: int = C.MEMORY_CHARS) -> DataFrame:
    """Each user turn with the k turns before it as array<struct<role, content>>; blank turns and other roles drop out after the slice."""
    before = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(-k, -1)
    seen = F.collect_list(F.struct("role", F.col("text").alias("content"))).over(before)
    valid = F.filter(seen, lambda m: m["role"].isin("user", "assistant") & (F.trim(T.text(m["content"])) != ""))
    cut = F.transform(valid, lambda m: F.struct(m["role"].alias("role"), F.substring(F.trim(m["content"]), 1, chars).alias("content")))
    return turns.withColumn("memory", cut).filter("role = 'user'")


def contextual_query(query: Column, memory_: Column, context: Column | None = None) -> Column:
    """A question led by the context terms, if there are any, and, where a word refers back, by what the last turns said."""
    none = F.array().cast("array<string>")
    terms = none if context is None else F.filter(F.transform(F.coalesce(context, none), lambda t: F.substring(F.trim(T.text(t)), 1, C.CONTEXT_TERM_CHARS)), lambda t: t != "")
    turns = F.slice(memory_, F.greatest(F.size(memory_) - C.MEMORY_TURNS + 1, F.lit(1)), C.MEMORY_TURNS)
    spoken = F.filter(turns, lambda m: m["role"].isin("user", "assistant") & (F.trim(T.text(m["content"])) != ""))
    said = F.transform(spoken, lambda m: F.substring(F.trim(m["content"]), 1, C.MEMORY_SEARCH_CHARS))
    refers = F.arrays_overlap(F.split(F.lower(query), r"\s+"), T.strings(C.REFERENTIAL_TERMS))
    return F.array_join(F.concat(terms, F.when(refers, F.coalesce(said, none)).otherwise(none), F.array(query)), " ")


def selected_query(query: Column, selection: Column) -> Column:
    """A question with the highlighted passage (collapsed, at most 600 of 1,500 characters) in front."""
    passage = F.substring(F.substring(T.collapse(selection), 1, C.SELECTION_CHARS), 1, C.SELECTION_SEARCH_CHARS)
    return F.when(passage == "", query).otherwise(F.concat_ws(" ", passage, query))


def source_block(number: Column, title: Column, path: Column, score: Column, content: Column) -> Column:
    return F.format_string("[Source %d] %s (%s), score %.3f\n%s", number, title, path, score, content)


def prompts(questions: DataFrame, decisions: DataFrame, evidence_: DataFrame, instructions: str = "") -> DataFrame:
    """One package for each question: messages (role, content) with its numbered sources and the action to take.

    A teacher's ``instructions`` end the system message. Where questions have ``memory`` (turns before), ``context`` (terms) or ``selection``
    (a highlighted passage), these stand between question and evidence.
    """
    blocks = evidence_.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("rank", "title", "file_path", "score", "content"))).alias("_e"))
    rows = questions.join(decisions, "qid").join(blocks, "qid", "left")
    sources = F.array_join(F.transform(F.coalesce("_e", F.array().cast("array<struct<rank:int,title:string,file_path:string,score:double,content:string>>")), lambda e, i: source_block(i + 1, e["title"], e["file_path"], e["score"], T.preview(e["content"], 1200))), "\n\n")
    has, null = set(questions.columns), F.lit(None).cast("string")
    titled = lambda title, body: F.when(F.trim(T.text(body)) != "", F.concat(F.lit(title + "\n"), body))
    turns = F.array_join(F.transform("memory", lambda m: F.concat(m["role"], F.lit(": "), m["content"])), "\n") if "memory" in has else null
    terms = F.array_join("context", ", ") if "context" in has else null
    passage = F.substring(T.collapse("selection"), 1, C.SELECTION_CHARS) if "selection" in has else null
    user = F.concat_ws("\n\n", F.col("query"), titled("Highlighted passage:", passage), titled("Selected in the course map:", terms), titled("Turns before:", turns), F.concat(F.lit("Evidence:\n"), sources))
    system = F.concat_ws(" ", F.lit("Answer only from the numbered sources and cite them."), F.when(F.col("status") == "needs_time_context", F.concat(F.lit("State that dates hold for "), F.coalesce("temporal_year", F.lit("an unknown term")), F.lit("."))), F.lit(instructions.strip() or None).cast("string"))
    return rows.select("qid", "status", next_action(F.col("status")).alias("action"), F.array(F.struct(F.lit("system").alias("role"), system.alias("content")), F.struct(F.lit("user").alias("role"), user.alias("content"))).alias("messages"))


#: What the offline provider says for each action.
DRY_RUN = {
    "answer_from_course_evidence": "Dry run: an answer from the sources would stand here.",
    "answer_with_time_context": "Dry run: an answer with the term it holds for would stand here.",
    "ask_clarifying_question": "Dry run: please narrow the question.",
    "return_insufficient_course_evidence": "Dry run: the notes don't cover this.",
    "refuse_or_consider_web_fallback": "Dry run: this lies outside the course.",
}


def answer_events(packages: DataFrame) -> DataFrame:
    """The event stream of each answer as rows (qid, seq, event, text): start, deltas, done."""
    words = F.split(T.mapped(DRY_RUN, F.col("action"), "Dry run."), "(?<= )")
    events = F.concat(F.array(F.struct(F.lit("start").alias("event"), F.col("status").alias("text"))), F.transform(words, lambda w: F.struct(F.lit("delta").alias("event"), w.alias("text"))), F.array(F.struct(F.lit("done").alias("event"), F.lit("").alias("text"))))
    return packages.select("qid", F.posexplode(events).alias("seq", "e")).select("qid", "seq", "e.event", "e.text")


def streamed(packages: DataFrame, replies: DataFrame) -> DataFrame:
    """The event stream (qid, seq, event, text) of a provider's replies (qid, n, text, error): start, deltas, done.

    An error ends a stream with an ``error`` event that says what to do; a stream without any text ends with one, too.
    """
    own = replies.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("n", "text"))).alias("_t"), F.min_by("error", F.when(F.col("error").isNotNull(), F.col("n"))).alias("_e"))
    rows = packages.select("qid", "status").join(own, "qid", "left")
    event = lambda kind, text: F.struct(F.lit(kind).alias("event"), text.alias("text"))
    said = F.filter(F.transform("_t", lambda t: t["text"]), lambda t: T.text(t) != "")
    said = F.coalesce(said, F.array().cast("array<string>"))
    last = F.when(F.col("_e").isNotNull(), event("error", F.concat_ws(" ", F.col("_e"), error_advice(F.col("_e"))))).when(F.size(said) == 0, event("error", F.lit("The model gave no answer. Try again later."))).otherwise(event("done", F.lit("")))
    events = F.concat(F.array(event("start", F.col("status"))), F.transform(said, lambda t: event("delta", t)), F.array(last))
    return rows.select("qid", F.posexplode(events).alias("seq", "e")).select("qid", "seq", "e.event", "e.text")


def named_sources(answer: Column, evidence_: Column) -> Column:
    """Chunk ids in an answer replaced by title and path of array<struct<chunk_id, title, file_path>>; no blank before a full stop or comma."""
    out = F.aggregate(evidence_, answer, lambda a, e: F.replace(a, e["chunk_id"], F.concat(e["title"], F.lit(" ("), e["file_path"], F.lit(")"))))
    return F.regexp_replace(out, r"\s+([.,;:!?])", "$1")


ERROR_ADVICE = [(r"(?i)401|403|api key|unauthori", "Check the key."), (r"(?i)429|rate|quota", "Wait, or raise the quota."), (r"(?i)timed? ?out|connection|network", "Check the network."), (r"(?i)404|model", "Check the model's name.")]


def error_advice(message: Column) -> Column:
    out = None
    for pattern, advice in ERROR_ADVICE:
        out = F.when(message.rlike(pattern), advice) if out is None else out.when(message.rlike(pattern), advice)
    return out.otherwise("Try again later.")
