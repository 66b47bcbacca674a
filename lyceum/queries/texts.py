"""Text, page, conversation, chunk and incremental queries."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import constants as C
from ..functions import text as T
from ..functions import urls
from ..operators import chunker, gate, incremental, suggest, summaries, views
from ..sources import readers, sinks
from .base import chunks, query, table
from .graph import BASE, taxonomy

WS = "regexp_replace({}, '\\s+', ' ', 'g')"


@query(f"SELECT doc_id, CASE WHEN length(p) <= 360 THEN p ELSE rtrim(left(p, 359)) || '...' END AS preview FROM (SELECT doc_id, trim({WS.format('text')}) AS p FROM documents)")
def preview(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", T.preview("text").alias("preview"))


@query(r"SELECT doc_id, md5(regexp_replace(regexp_replace(regexp_replace(regexp_replace(replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10)), '[ \t\x{a0}]+', ' ', 'g'), ' *\n *', chr(10), 'g'), '\n{3,}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g')) AS cleaned FROM documents")
def clean_text(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", F.md5(T.clean("text").cast("binary")).alias("cleaned"))


@query(f"SELECT doc_id, md5(trim({WS.format(chr(34) + 'x' + chr(34))})) AS normalized, len(regexp_extract_all(translate(lower(text), '-_/', '   '), '[a-z0-9]+(?:\\.[a-z0-9]+)?')) AS n_tokens FROM (SELECT doc_id, text, replace(lower(text), '_', ' ') AS x FROM documents)")
def normalize(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", F.md5(T.normalized("text").cast("binary")).alias("normalized"), F.size(T.tokens("text")).cast("long").alias("n_tokens"))


@query(r"SELECT doc_id, len(string_split(regexp_replace(text, '([.!?])\s+', '\1' || chr(30), 'g'), chr(30))) AS n, md5(string_split(regexp_replace(text, '([.!?])\s+', '\1' || chr(30), 'g'), chr(30))[1]) AS first FROM documents")
def sentences(spark: SparkSession, sf: str) -> DataFrame:
    s = T.sentences("text")
    return table(spark, sf, "documents").select("doc_id", F.size(s).cast("long").alias("n"), F.md5(F.element_at(s, 1).cast("binary")).alias("first"))


@query(r"SELECT doc_id, round(1.33::DOUBLE * len(list_filter(string_split_regex(text, '\s+'), lambda w: w <> '')), 6) AS tokens FROM documents")
def token_estimates(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", F.round(T.token_estimate("text"), 6).alias("tokens"))


MARKED = "'# ' || lang || chr(10) || 'x' || chr(10) || '## ' || source || ' two' || chr(10) || text"


@query(rf"""WITH m AS (SELECT doc_id, {MARKED} AS t FROM documents), h AS (SELECT doc_id, regexp_extract_all(t, '(?m)^(#{{1,6}})\s+(.+)$', 1) AS l, regexp_extract_all(t, '(?m)^(#{{1,6}})\s+(.+)$', 2) AS s,
  regexp_replace(t, '(?m)^(#{{1,6}}\s+.+)$', chr(30) || '\1', 'g') AS marked FROM m), p AS (SELECT doc_id, l, s, string_split(marked, chr(30)) AS parts FROM h)
SELECT doc_id, len(l) AS n, array_to_string(list_transform(l, lambda x: CAST(length(x) AS VARCHAR)), ',') AS levels, array_to_string(list_transform(s, lambda x: trim(x)), '|') AS titles,
  array_to_string(list_transform(range(1, len(l) + 1), lambda i: CAST(CAST(list_sum(list_transform(parts[1:i], lambda x: length(x))) AS BIGINT) AS VARCHAR)), ',') AS positions FROM p""")
def headings(spark: SparkSession, sf: str) -> DataFrame:
    """Headings, with positions, of whole documents under two more heading lines."""
    t = F.concat(F.lit("# "), F.col("lang"), F.lit("\nx\n## "), F.col("source"), F.lit(" two\n"), F.col("text"))
    h = table(spark, sf, "documents").select("doc_id", T.headings(t).alias("h"))
    texts = {"levels": ",", "titles": "|", "positions": ","}
    values = {"levels": lambda x: x["level"].cast("string"), "titles": lambda x: x["title"], "positions": lambda x: x["position"].cast("string")}
    return h.select("doc_id", F.size("h").cast("long").alias("n"), *[F.array_join(F.transform("h", values[c]), sep).alias(c) for c, sep in texts.items()])


@query(r"SELECT doc_id, 'topic:' || regexp_replace(regexp_replace(lower(lang || '-' || source), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS topic, coalesce(nullif(left(regexp_replace(regexp_replace(lower(text), '[^\p{L}\p{N}]+', '-', 'g'), '^-+|-+$', '', 'g'), 60), ''), 'item') AS slug FROM documents")
def slugs(spark: SparkSession, sf: str) -> DataFrame:
    """Topic ids, and slugs of whole texts; a text without letters and digits gets the fallback."""
    return table(spark, sf, "documents").select("doc_id", T.topic_id(F.col("lang"), F.col("source")).alias("topic"), T.slug("text").alias("slug"))


@query("SELECT doc_id, left(sha256(CAST(doc_id AS VARCHAR) || chr(0) || text), 24) AS hash FROM documents")
def chunk_hash(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", incremental.chunk_hash(F.col("doc_id"), F.col("text")).alias("hash"))


OLD_NEW = """old AS (SELECT doc_id AS file, left(sha256(text), 16) AS hash FROM documents WHERE doc_id % 10 <> 3),
new AS (SELECT doc_id AS file, left(sha256(CASE WHEN doc_id % 10 = 5 THEN text || '!' ELSE text END), 16) AS hash FROM documents WHERE doc_id % 10 <> 7)"""


@query(f"WITH {OLD_NEW} SELECT coalesce(old.file, new.file) AS file, CASE WHEN old.file IS NULL THEN 'added' WHEN new.file IS NULL THEN 'removed' ELSE 'edited' END AS change FROM old FULL JOIN new ON old.file = new.file WHERE old.hash IS DISTINCT FROM new.hash")
def changed_docs(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as notes: some added, some removed, some edited."""
    d = table(spark, sf, "documents")
    old = d.filter("doc_id % 10 <> 3").select(F.col("doc_id").alias("file"), incremental.file_hash(F.col("text")).alias("hash"))
    edited = F.when(F.col("doc_id") % 10 == 5, F.concat("text", F.lit("!"))).otherwise(F.col("text"))
    new = d.filter("doc_id % 10 <> 7").select(F.col("doc_id").alias("file"), incremental.file_hash(edited).alias("hash"))
    return incremental.changed(old, new)


@query("WITH c AS (SELECT doc_id, left(sha256(CAST(doc_id AS VARCHAR) || chr(0) || CASE WHEN doc_id % 10 = 5 THEN text || '!' ELSE text END), 24) AS hash FROM documents), k AS (SELECT left(sha256(CAST(doc_id AS VARCHAR) || chr(0) || text), 24) AS hash FROM documents WHERE doc_id % 10 <> 3) SELECT doc_id FROM c WHERE hash NOT IN (SELECT hash FROM k)")
def embedding_reuse(spark: SparkSession, sf: str) -> DataFrame:
    """Chunks whose vectors must be made anew."""
    d = table(spark, sf, "documents")
    edited = F.when(F.col("doc_id") % 10 == 5, F.concat("text", F.lit("!"))).otherwise(F.col("text"))
    rows = d.select("doc_id", incremental.chunk_hash(F.col("doc_id"), edited).alias("hash"))
    cache = d.filter("doc_id % 10 <> 3").select(incremental.chunk_hash(F.col("doc_id"), F.col("text")).alias("hash"), F.array(F.lit(1.0)).alias("vector"))
    return incremental.reuse(rows, cache)[1].select("doc_id")


@query()
def chunk_documents(spark: SparkSession, sf: str) -> DataFrame:
    """All chunks of all documents; tests check them against plain lists."""
    rows = chunker.split_arrow(table(spark, sf, "documents").select("doc_id", "text"), "doc_id")
    return rows.select("doc_id", "ordinal", "token_estimate", F.md5(F.col("content").cast("binary")).alias("content_md5"))


@query("""WITH t AS (SELECT doc_id % 900 AS chunk_id, CAST(floor(1.33::DOUBLE * len(list_filter(string_split_regex(text, '\\s+'), lambda w: w <> ''))) AS INTEGER) AS t FROM documents)
SELECT count(*) AS n, min(t) AS least, quantile_cont(t, 0.5) AS median, round(avg(t), 6) AS mean, max(t) AS greatest, count(*) FILTER (t < 80) AS short, count(*) FILTER (t > 450) AS long, (SELECT count(*) FROM (SELECT chunk_id FROM t GROUP BY 1 HAVING count(*) > 1)) AS duplicate_ids FROM t""")
def chunk_quality(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "documents").select((F.col("doc_id") % 900).alias("chunk_id"), T.token_estimate("text").cast("int").alias("token_estimate"))
    return chunker.quality(rows)


@query("SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN 'root' ELSE lang END AS module, CASE WHEN doc_id % 4 = 2 THEN source ELSE 'd' || CAST(doc_id AS VARCHAR) END AS section FROM documents")
def module_section(spark: SparkSession, sf: str) -> DataFrame:
    name = F.concat(F.lit("d"), F.col("doc_id"), F.lit(".md"))
    path = F.when(F.col("doc_id") % 4 == 0, name).when(F.col("doc_id") % 4 == 2, F.concat_ws("/", "lang", "source", name)).otherwise(F.concat_ws("/", "lang", name))
    module, section = chunker.located(path)
    return table(spark, sf, "documents").select("doc_id", module.alias("module"), section.alias("section"))


@query("SELECT doc_id AS id, doc_id % 50 = 0 AS time_sensitive, length(CASE WHEN doc_id % 50 = 0 THEN 'Temporal context: AY2026/2027, Semester 1' || chr(10) || chr(10) || text ELSE text END) AS n FROM documents")
def time_tags(spark: SparkSession, sf: str) -> DataFrame:
    rows = chunks(spark, sf).drop("time_sensitive").withColumn("file_path", F.when(F.col("id") % 50 == 0, "syllabus.md").otherwise(F.col("file_path")))
    out = chunker.timed(rows, C.TIME_SENSITIVE_FILES, "syllabus.md", None, "AY2026/2027", "Semester 1")
    return out.select("id", "time_sensitive", F.length("content").cast("long").alias("n"))


# ------------------------------------------------------------------ pages

BARE = "regexp_replace(regexp_replace(url, '^[a-z]+://[^/]*', ''), '[?#].*$', '')"
ADDRESS = f"lower(regexp_replace(regexp_replace(regexp_replace(regexp_replace(url_decode(replace({BARE}, '+', '%2B')), '^/+|/+$', '', 'g'), '(?i)(^|/)index\\.html?$', ''), '(?i)\\.html?$', ''), '^/+|/+$', '', 'g'))"


@query(f"SELECT page_id, {ADDRESS} AS address FROM pages")
def normalize_address(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "pages").select("page_id", urls.normalize_address(urls.site_path("url")).alias("address"))


@query("SELECT doc_id, CASE WHEN doc_id % 5 = 4 THEN NULL WHEN doc_id % 5 = 3 THEN '' WHEN doc_id % 5 = 2 THEN lower(lang) || '-notes' ELSE lower(lang) || '/' || source END AS slug FROM documents")
def page_slug(spark: SparkSession, sf: str) -> DataFrame:
    r = F.col("doc_id") % 5
    path = F.when(r == 4, F.concat_ws("/", "lang", F.lit("a.pdf"))).when(r == 3, "index.md").when(r == 2, F.concat("lang", F.lit("_notes/README.md"))).when(r == 1, F.concat(F.lit("./"), F.concat_ws("/", "lang", "source"), F.lit(".ipynb"))).otherwise(F.concat(F.concat_ws("/", "lang", "source"), F.lit(".md")))
    return table(spark, sf, "documents").select("doc_id", urls.page_slug(path).alias("slug"))


@query(f"""WITH a AS (SELECT page_id, {ADDRESS} AS a FROM pages), known AS (SELECT DISTINCT a AS slug FROM a WHERE page_id % 3 = 0 UNION SELECT DISTINCT string_split(a, '/')[-1] FROM a WHERE page_id % 5 = 0),
s AS (SELECT page_id, CASE WHEN a = '' THEN [''] ELSE list_transform(range(1, len(string_split(a, '/')) + 1), lambda i: array_to_string(string_split(a, '/')[i:], '/')) END AS x FROM a)
SELECT page_id, arg_max(slug, length(slug)) AS found FROM (SELECT page_id, unnest(x) AS slug FROM s) JOIN known USING (slug) GROUP BY page_id""")
def page_lookup(spark: SparkSession, sf: str) -> DataFrame:
    """Each address to the page whose slug is its longest suffix."""
    p = table(spark, sf, "pages").select("page_id", urls.site_path("url").alias("address"))
    a = p.select("page_id", urls.normalize_address("address").alias("a"))
    known = a.filter("page_id % 3 = 0").select(F.col("a").alias("slug")).union(a.filter("page_id % 5 = 0").select(F.element_at(F.split("a", "/"), -1))).distinct().withColumn("id", F.col("slug"))
    return views.page_lookup(p, known).select("page_id", F.col("id").alias("found"))


@query(r"SELECT page_id, trim(regexp_replace(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '\s+', ' ', 'g')) AS title FROM pages")
def html_title(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "pages").select("page_id", T.collapse(F.regexp_extract("html", r"(?is)<title[^>]*>(.*?)</title>", 1)).alias("title"))


HIDDEN = ["script", "style", "nav", "header", "footer", "noscript", "svg", "title"]


def _stripped() -> str:
    out = "html"
    for t in HIDDEN:
        out = f"regexp_replace({out}, '(?is)<{t}[^>]*>.*?</{t}>', ' ', 'g')"
    return f"trim(regexp_replace(regexp_replace({out}, '(?s)<[^>]*>', ' ', 'g'), '\\s+', ' ', 'g'))"


@query(f"SELECT page_id, md5({_stripped()}) AS body FROM pages")
def html_text(spark: SparkSession, sf: str) -> DataFrame:
    """Visible text by ordered replacements, without leaving the plan."""
    out = F.col("html")
    for t in HIDDEN:
        out = F.regexp_replace(out, f"(?is)<{t}[^>]*>.*?</{t}>", " ")
    return table(spark, sf, "pages").select("page_id", F.md5(T.collapse(F.regexp_replace(out, "(?s)<[^>]*>", " ")).cast("binary")).alias("body"))


@query()
def html_parsed(spark: SparkSession, sf: str) -> DataFrame:
    """Title and marked-up text of every page by the streaming parser."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = [readers.html_parts(h or "") for h in b["html"]]
            yield pd.DataFrame({"page_id": b["page_id"], "title": [t for t, _ in found], "body": [x for _, x in found]})

    return table(spark, sf, "pages").select("page_id", "html").mapInPandas(run, "page_id long, title string, body string")


@query("""SELECT page_id, contains(html, '</body>') AS installed, length(html) + CASE WHEN contains(html, '</body>') THEN length('<!-- assistant:begin --><script src="../assistant.js" defer></script><!-- assistant:end -->') + 1 ELSE 0 END AS n, true AS same FROM pages""")
def widget_install(spark: SparkSession, sf: str) -> DataFrame:
    """Pages with the widget; installing again changes nothing and removing gives the page back."""
    p = table(spark, sf, "pages")
    once = sinks.with_widget(F.col("html"), F.lit("../"))
    rows = p.select("page_id", "html", once.alias("once"))
    same = (sinks.with_widget(F.col("once"), F.lit("../")) == F.col("once")) & (sinks.without_widget(F.col("once")) == F.col("html"))
    return rows.select("page_id", F.contains("once", F.lit(sinks.BEGIN)).alias("installed"), F.length("once").cast("long").alias("n"), same.alias("same"))


@query("""WITH b AS (SELECT 's' || CAST(doc_id AS VARCHAR) AS label, doc_id AS id, CASE WHEN doc_id % 9 = 0 THEN 'hidden' ELSE 'primary' END AS visibility, source AS alias FROM documents)
SELECT id, label, CASE WHEN label = 's1' THEN 0 WHEN starts_with(label, 's1') THEN 1 WHEN contains(label, 's1') THEN 2 ELSE 3 END AS score FROM b WHERE visibility <> 'hidden' AND (contains(label, 's1') OR contains(alias, 's1')) ORDER BY score, label, id LIMIT 9""")
def node_search(spark: SparkSession, sf: str) -> DataFrame:
    nodes = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.concat(F.lit("s"), F.col("doc_id")).alias("label"), F.when(F.col("doc_id") % 9 == 0, "hidden").otherwise("primary").alias("visibility"), F.array("source").alias("aliases"))
    return views.search_box(nodes, "S1 ").select("id", "label", "score")


# ------------------------------------------------------------------ conversations

MEM = """mem AS (SELECT conv_id, turn, text, role, list({'r': role, 'c': text}) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING) AS m FROM conversations),
usr AS (SELECT conv_id, turn, text, list_transform(list_filter(coalesce(m, []), lambda x: x.r IN ('user', 'assistant') AND trim(x.c) <> ''), lambda x: left(trim(x.c), 1200)) AS said FROM mem WHERE role = 'user')"""


@query(f"WITH {MEM} SELECT conv_id, turn, len(said) AS n, md5(array_to_string(said, '|')) AS digest FROM usr")
def short_memory(spark: SparkSession, sf: str) -> DataFrame:
    rows = gate.memory(table(spark, sf, "conversations"))
    return rows.select("conv_id", "turn", F.size("memory").cast("long").alias("n"), F.md5(F.array_join(F.transform("memory", lambda m: m["content"]), "|").cast("binary")).alias("digest"))


@query(f"WITH {MEM} SELECT conv_id, turn, md5(CASE WHEN list_has_any(string_split_regex(lower(text), '\\s+'), ['it', 'this', 'that', 'they', 'them']) AND len(said) > 0 THEN array_to_string(list_append(list_transform(said[-4:], lambda x: left(x, 400)), text), ' ') ELSE text END) AS query FROM usr")
def contextual_query(spark: SparkSession, sf: str) -> DataFrame:
    rows = gate.memory(table(spark, sf, "conversations"))
    return rows.select("conv_id", "turn", F.md5(gate.contextual_query(F.col("text"), F.col("memory")).cast("binary")).alias("query"))


@query(f"WITH {MEM}, t AS (SELECT conv_id, turn, text, said, left('Conversation ' || CAST(conv_id AS VARCHAR), 160) || ' ' AS c FROM usr) SELECT conv_id, turn, md5(c || CASE WHEN list_has_any(string_split_regex(lower(text), '\\s+'), ['it', 'this', 'that', 'they', 'them']) AND len(said) > 0 THEN array_to_string(list_append(list_transform(said[-4:], lambda x: left(x, 400)), text), ' ') ELSE text END) AS query FROM t")
def contextual_query_with_terms(spark: SparkSession, sf: str) -> DataFrame:
    """Context terms stand in front whether or not a question refers back; blank ones count for nothing."""
    rows = gate.memory(table(spark, sf, "conversations"))
    terms = F.array(F.lit("  "), F.concat(F.lit(" Conversation "), F.col("conv_id")))
    return rows.select("conv_id", "turn", F.md5(gate.contextual_query(F.col("text"), F.col("memory"), terms).cast("binary")).alias("query"))


@query(f"SELECT doc_id, md5(CASE WHEN p = '' THEN source ELSE left(p, 600) || ' ' || source END) AS query FROM (SELECT doc_id, source, trim({WS.format('text')}) AS p FROM documents)")
def selected_query(spark: SparkSession, sf: str) -> DataFrame:
    """Questions led by a highlighted passage."""
    return table(spark, sf, "documents").select("doc_id", F.md5(gate.selected_query(F.col("source"), F.col("text")).cast("binary")).alias("query"))


@query("SELECT CAST(row_number() OVER (ORDER BY lang) - 1 AS INTEGER) AS pos, lang AS module, upper(left(lang, 1)) || substring(lang, 2) AS name, count(*) AS chunks FROM documents GROUP BY lang")
def load_chapters(spark: SparkSession, sf: str) -> DataFrame:
    return suggest.load_chapters(chunks(spark, sf))


@query("SELECT count(DISTINCT lang || '/' || source || '/' || CAST(doc_id AS VARCHAR)) AS files, count(*) AS chunks, CAST(NULL AS VARCHAR) AS term, ['md'] AS types, (SELECT count(*) FROM documents WHERE n_chars < 20) AS warnings FROM documents")
def extract_summary(spark: SparkSession, sf: str) -> DataFrame:
    from ..plans import course

    short = table(spark, sf, "documents").filter("n_chars < 20")
    return course.extract_summary(chunks(spark, sf).withColumn("file_type", F.lit("md")), short)


@query("SELECT conv_id, turn, count(*) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 6 PRECEDING AND 1 PRECEDING) AS n FROM conversations")
def client_window(spark: SparkSession, sf: str) -> DataFrame:
    from pyspark.sql import Window

    w = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(-6, -1)
    return table(spark, sf, "conversations").select("conv_id", "turn", F.count("*").over(w).alias("n"))


# ------------------------------------------------------------------ suggestions and summaries


@query("WITH t AS (SELECT lang AS module, source AS file_path, CAST(sum(length(text)) AS BIGINT) AS chars FROM documents GROUP BY ALL) SELECT module, file_path, chars, CAST(row_number() OVER (PARTITION BY module ORDER BY chars DESC, file_path) AS INTEGER) AS rank FROM t QUALIFY rank <= 3")
def longest_pages(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "documents").select(F.col("lang").alias("module"), F.col("source").alias("file_path"), F.col("text").alias("content"))
    return suggest.longest_pages(rows)


@query("WITH n AS (SELECT r_regionkey, row_number() OVER (ORDER BY n_nationkey) - 1 AS i, count(*) OVER () AS c, n_nationkey FROM nation JOIN region ON n_regionkey = r_regionkey), j AS (SELECT CAST(round_even(j * (c - 1) / 6.0, 0) AS BIGINT) AS i FROM (SELECT DISTINCT c FROM n), range(7) t(j)) SELECT n_nationkey AS id FROM n WHERE i IN (SELECT i FROM j)")
def evenly_spaced(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "nation").select(F.col("n_nationkey").alias("id"))
    return suggest.evenly_spaced(rows, 7, "id")


# Sentences between lines that part paragraphs, met by the names of the taxonomy's words; without look-behinds, so what may touch a name is spelled out.
SUMMARY_SQL = rf"""WITH {BASE},
pat AS (SELECT id AS concept, '(?:the[\s\-/]+' || id || '|' || id || 's|' || id || ')' AS p FROM tax),
pg AS (SELECT pos, title, file_path, regexp_replace(replace(replace(content, chr(13) || chr(10), chr(10)), chr(13), chr(10)), '(?s)```.*?```|\$\$.*?\$\$', ' ', 'g') AS c FROM chunks),
pa AS (SELECT pos, title, file_path, list_transform(string_split_regex(c, '(?m)(?:^[^\S\n]*(?:(?:[#|:<!%]|\+\+\+|---|Temporal context:).*)?(?:\n|\z))+'), lambda p: regexp_replace(regexp_replace(regexp_replace(p, '(?m)^[^\S\n]*(?:[-*]|\d+[.)])\s+', '', 'g'), '!?\[([^\]]*)\]\([^)]*\)|\{{[a-z-]+\}}`([^`]*)`', '\1\2', 'g'), '[*_`]{{1,3}}', '', 'g')) AS ps FROM pg),
sl AS (SELECT pos, title, file_path, list_filter(list_transform(flatten(list_transform(ps, lambda p: string_split(regexp_replace(trim(regexp_replace(p, '\s+', ' ', 'g')), '([.!?])\s+([A-Z(])', '\1' || chr(1) || '\2', 'g'), chr(1)))), lambda s: trim(s)), lambda s: length(s) BETWEEN 40 AND 320) AS l FROM pa),
se AS (SELECT pos, title, file_path, unnest(l) AS s, generate_subscripts(l, 1) AS sent FROM sl),
ru AS (SELECT *, lower(s) AS low, unnest(list_distinct(regexp_extract_all(lower(s), '[a-z0-9]+'))) AS run FROM se),
ca AS (SELECT DISTINCT pos, title, file_path, sent, s, low, concept, p FROM ru JOIN al ON run = alias JOIN pat USING (concept)),
va AS (SELECT '[^a-z0-9.][^.]{{0,39}}?\b{summaries.DEFINES}\b' AS verb),
fe AS (SELECT *, regexp_matches(low, '(?:^|[^a-z0-9])' || p || verb) AS defined, length(regexp_extract(low, '(?s)^((?:.*?[^a-z0-9])??)' || p || verb, 1)) AS before,
  regexp_matches(low, '^(?:(?:a|an|the)\s+)?' || p || '(?:[^a-z0-9]|$)') AS first, regexp_matches(low, '^(?:it|this|these|they|that|such|here|in this)\b') AS refers,
  regexp_matches(lower(title), '(?:^|[^a-z0-9])' || p || '(?:[^a-z0-9]|$)') AS titled, regexp_matches(s, '[$\\{{}}<>|=]') AS marked FROM ca, va),
sc AS (SELECT concept, s, file_path, pos, sent, CAST(1 + CASE WHEN NOT defined THEN 0 WHEN before < 45 THEN 4 ELSE 1 END + CASE WHEN first THEN 2 ELSE 0 END - CASE WHEN refers THEN 2 ELSE 0 END + CASE WHEN titled THEN 1 ELSE 0 END
  + CASE WHEN length(s) BETWEEN 60 AND 240 THEN 0.5 ELSE 0 END - CASE WHEN marked THEN 3 ELSE 0 END AS DOUBLE) - CAST(pos AS DOUBLE) * 1e-4 AS score FROM fe)
SELECT concept, s AS summary, file_path AS summary_file FROM sc WHERE score > 0 QUALIFY row_number() OVER (PARTITION BY concept ORDER BY score DESC, pos, sent) = 1"""


@query(SUMMARY_SQL)
def concept_summary(spark: SparkSession, sf: str) -> DataFrame:
    """The best introducing sentence of frequent words, over all documents."""
    return summaries.concept_summaries(chunks(spark, sf), taxonomy(spark, sf))
