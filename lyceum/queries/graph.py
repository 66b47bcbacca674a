"""Graph queries: the taxonomy is made of frequent words, documents are chunks, languages chapters, sources pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

from .. import constants as C
from ..functions import text as T
from ..operators import concepts as K
from ..operators import counts, graph, publications, views
from ..operators.sizes import spread, stored
from .base import CHUNKS_SQL, chunks, query, table

TAXONOMY = 24


def taxonomy(spark: SparkSession, sf: str) -> DataFrame:
    """The most frequent words of four letters or more, each with its plural-like and a two-word alias."""
    best = counts.run_document_counts(spread(chunks(spark, sf).select("id", "content"), "id").select(F.lower("content")), 4).orderBy(F.desc("df"), "term").limit(TAXONOMY)
    # A taxonomy is a small table that people edit: it stands as rows of the plan.
    rows = [(r.term, r.term, r.term[0], [r.term, r.term + "s", "the " + r.term]) for r in best.collect()]
    return spark.createDataFrame(rows, "id string, label string, category string, aliases array<string>")


def mentioned(spark: SparkSession, sf: str, again: bool = False, known: DataFrame | None = None) -> DataFrame:
    """Mentions by chunk; kept (memory, then disk) for a query that reads them ``again``. ``known``: the taxonomy, if it is at hand."""
    rows = K.mentions(spread(chunks(spark, sf).select("module", "section", "id", "title", "content"), "id"), known or taxonomy(spark, sf), ["module", "section", "id"])
    return rows.persist(StorageLevel.MEMORY_AND_DISK) if again else rows


def stop(spark: SparkSession, sf: str, known: DataFrame | None = None) -> DataFrame:
    return (known or taxonomy(spark, sf)).orderBy("id").limit(2).select(F.col("id").alias("concept"))


BASE = f"""{CHUNKS_SQL},
tax AS (SELECT w AS id, count(*) AS df FROM (SELECT id AS d, unnest(list_distinct(regexp_extract_all(lower(content), '[a-z0-9]+'))) AS w FROM chunks) WHERE length(w) >= 4 GROUP BY w ORDER BY df DESC, w LIMIT {TAXONOMY}),
al AS (SELECT id AS concept, id AS alias FROM tax UNION SELECT id, id || 's' FROM tax UNION SELECT id, 'the ' || id FROM tax),
tx AS (SELECT module, section, id, trim(regexp_replace(replace(lower(title || ' ' || section || ' ' || content), '_', ' '), '\\s+', ' ', 'g')) AS t FROM chunks),
dbl AS (SELECT module, section, id, '  ' || regexp_replace(t, '([^a-z0-9])', '\\1\\1', 'g') || '  ' AS t FROM tx),
hit AS (SELECT module, section, id, concept, len(regexp_extract_all(t, '[^a-z0-9]' || replace(alias, ' ', '[\\s\\-/]+') || '[^a-z0-9]')) AS n FROM dbl, al WHERE contains(t, string_split(alias, ' ')[-1])),
men AS (SELECT module, section, id, concept, CAST(sum(n) AS BIGINT) AS n FROM hit WHERE n > 0 GROUP BY ALL),
stp AS (SELECT id AS concept FROM tax ORDER BY id LIMIT 2),
chap AS (SELECT module, 'chapter:' || regexp_replace(regexp_replace(lower(module), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS chapter_id, row_number() OVER (ORDER BY min(pos)) AS pos FROM chunks GROUP BY module)"""
TOPIC = "'topic:' || regexp_replace(regexp_replace(lower({m} || '-' || {s}), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g')"
TID = TOPIC.format(m="module", s="section")
CID = "'chapter:' || regexp_replace(regexp_replace(lower(module), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g')"
KID = "'keyword:' || concept"
EDGES = f"""me AS (SELECT {TID} AS source, {KID} AS target, 'mentions' AS type, '' AS basis, round(least(1.0, 0.45 + ln(1.0 + sum(n)) / 4), 4) AS weight, CAST(sum(n) AS BIGINT) AS mention_count FROM men GROUP BY module, section, concept),
ce AS (SELECT {CID} AS source, {KID} AS target, 'covers' AS type, '' AS basis, round(least(1.0, 0.4 + 0.12 * count(DISTINCT section) + ln(1.0 + sum(n)) / 10), 4) AS weight, CAST(sum(n) AS BIGINT) AS mention_count FROM men GROUP BY module, concept),
ne AS (SELECT DISTINCT {CID} AS source, {TID} AS target, 'contains' AS type, '' AS basis, CAST(1.0 AS DOUBLE) AS weight, CAST(NULL AS BIGINT) AS mention_count FROM chunks),
se AS (SELECT * FROM (SELECT chapter_id AS source, lead(chapter_id) OVER (ORDER BY pos) AS target, 'sequence' AS type, '' AS basis, CAST(0.5 AS DOUBLE) AS weight, CAST(NULL AS BIGINT) AS mention_count FROM chap) WHERE target IS NOT NULL)"""


def pair_sql(rows: str, key: str, member: str) -> str:
    return f"""own AS (SELECT DISTINCT {key} AS k, {member} AS m FROM {rows}), siz AS (SELECT m, count(*) AS n FROM own GROUP BY m),
prs AS (SELECT a.m AS l, b.m AS r, count(*) AS n_shared FROM own a JOIN own b ON a.k = b.k AND a.m < b.m GROUP BY ALL),
par AS (SELECT l, r, n_shared, x.n AS n_l, y.n AS n_r FROM prs JOIN siz x ON x.m = l JOIN siz y ON y.m = r)"""


@query(f"WITH {BASE} SELECT concept, module, section, id, CAST(sum(n) AS BIGINT) AS n FROM men GROUP BY ROLLUP (concept, module, section, id) HAVING concept IS NOT NULL")
def concept_counts(spark: SparkSession, sf: str) -> DataFrame:
    return K.rolled_up(mentioned(spark, sf)).drop("level")


@query(f"WITH {BASE}, one AS (SELECT DISTINCT alias FROM al) SELECT alias, CAST(sum(n) AS BIGINT) AS n FROM (SELECT alias, len(regexp_extract_all(t, '[^a-z0-9]' || replace(alias, ' ', '[\\s\\-/]+') || '[^a-z0-9]')) AS n FROM dbl, one WHERE contains(t, string_split(alias, ' ')[-1])) GROUP BY alias HAVING sum(n) > 0")
def alias_mentions(spark: SparkSession, sf: str) -> DataFrame:
    """How often all texts together mention each alias."""
    c = chunks(spark, sf)
    rows = c.select("id", K.searched(c).alias("_t"))
    return K.alias_counts(rows, K.aliases(taxonomy(spark, sf)), ["id"], c.select("id", F.lower(K.whole()).alias("_t"))).groupBy("alias").agg(F.sum("n").alias("n"))


def _edges(df: DataFrame) -> DataFrame:
    return df.select("source", "target", "type", "basis", "weight", "mention_count")


@query(f"WITH {BASE}, {EDGES} SELECT * FROM me")
def mentions_edges(spark: SparkSession, sf: str) -> DataFrame:
    return _edges(graph.mentions_edges(mentioned(spark, sf, again=True)))


@query(f"WITH {BASE}, {EDGES} SELECT * FROM ce")
def covers_edges(spark: SparkSession, sf: str) -> DataFrame:
    return _edges(graph.covers_edges(mentioned(spark, sf)))


@query(f"WITH {BASE}, {EDGES} SELECT * FROM ne")
def contains_edges(spark: SparkSession, sf: str) -> DataFrame:
    return _edges(graph.contains_edges(chunks(spark, sf)))


@query(f"WITH {BASE}, {EDGES} SELECT * FROM se")
def sequence_edges(spark: SparkSession, sf: str) -> DataFrame:
    return _edges(graph.sequence_edges(graph.chapters(chunks(spark, sf))))


@query(f"WITH {CHUNKS_SQL}, f AS (SELECT module, section, arg_min(title, pos) AS title FROM chunks GROUP BY ALL) SELECT {TID} AS topic_id, title, CAST(row_number() OVER (PARTITION BY module ORDER BY section = 'index', section) - 1 AS INTEGER) AS ord FROM f")
def topic_order(spark: SparkSession, sf: str) -> DataFrame:
    return graph.topics(chunks(spark, sf)).select("topic_id", "title", "ord")


RELATED = f"""{pair_sql('men', "module || chr(31) || section", 'concept')},
cch AS (SELECT DISTINCT a.concept AS l, b.concept AS r FROM men a JOIN men b ON a.id = b.id AND a.concept < b.concept),
rc AS (SELECT l, r, n_shared / sqrt(CAST(n_l AS DOUBLE) * n_r) AS score, n_shared FROM par SEMI JOIN cch USING (l, r) WHERE n_shared / sqrt(CAST(n_l AS DOUBLE) * n_r) >= 0.10)"""
TB = f"""{pair_sql('(SELECT * FROM men ANTI JOIN stp USING (concept))', 'concept', "module || chr(31) || section")},
tb AS (SELECT l, r, n_shared / CAST(n_l + n_r - n_shared AS DOUBLE) AS score, n_shared FROM par WHERE n_shared >= 2 AND n_shared / CAST(n_l + n_r - n_shared AS DOUBLE) >= 0.12 AND string_split(l, chr(31))[1] <> string_split(r, chr(31))[1])"""
CB = f"""{pair_sql('(SELECT * FROM men ANTI JOIN stp USING (concept))', 'concept', 'module')},
cb AS (SELECT l, r, n_shared / CAST(n_l + n_r - n_shared AS DOUBLE) AS score, n_shared FROM par WHERE n_shared >= 3)"""


@query(f"WITH {BASE}, {RELATED} SELECT l, r, round(score, 6) AS score, n_shared FROM rc")
def related_concepts(spark: SparkSession, sf: str) -> DataFrame:
    return graph.related_concepts(mentioned(spark, sf, again=True)).withColumn("score", F.round("score", 6))


@query(f"WITH {BASE}, {TB} SELECT l, r, round(score, 6) AS score, n_shared FROM tb")
def topic_bridges_candidates(spark: SparkSession, sf: str) -> DataFrame:
    known = taxonomy(spark, sf)
    return graph.topic_bridges(mentioned(spark, sf, known=known), stop(spark, sf, known)).withColumn("score", F.round("score", 6))


@query(f"WITH {BASE}, {CB} SELECT l, r, round(score, 6) AS score, n_shared FROM cb")
def chapter_bridges_candidates(spark: SparkSession, sf: str) -> DataFrame:
    known = taxonomy(spark, sf)
    return graph.chapter_bridges(mentioned(spark, sf, known=known), stop(spark, sf, known)).withColumn("score", F.round("score", 6))


@query()
def bridges_greedy(spark: SparkSession, sf: str) -> DataFrame:
    """At most three bridges a page, the best first; checked against a plain loop in tests."""
    known = taxonomy(spark, sf)
    return graph.capped_pairs(graph.topic_bridges(mentioned(spark, sf, known=known), stop(spark, sf, known)).withColumn("score", F.round("score", 6)))


@query(f"""WITH {BASE}, {RELATED}, ev AS (SELECT rc.l, rc.r, CAST(a.id AS VARCHAR) AS k FROM rc JOIN men a ON a.concept = rc.l JOIN men b ON b.concept = rc.r AND b.id = a.id QUALIFY row_number() OVER (PARTITION BY rc.l, rc.r ORDER BY CAST(a.id AS VARCHAR)) <= 8)
SELECT l, r, string_agg(k, '|' ORDER BY k) AS evidence FROM ev GROUP BY l, r""")
def related_evidence(spark: SparkSession, sf: str) -> DataFrame:
    """The first eight chunks that related concepts share."""
    m = mentioned(spark, sf, again=True)
    return graph.with_evidence(graph.related_concepts(m), m, "id", "concept", graph.EVIDENCE).select("l", "r", F.array_join("evidence", "|").alias("evidence"))


@query(f"""WITH {BASE}, {TB}, sp AS (SELECT DISTINCT module || chr(31) || section AS topic, {KID} AS k FROM men ANTI JOIN stp USING (concept))
SELECT l, r, string_agg(a.k, '|' ORDER BY a.k) AS evidence FROM tb JOIN sp a ON a.topic = l JOIN sp b ON b.topic = r AND b.k = a.k GROUP BY l, r""")
def bridge_evidence(spark: SparkSession, sf: str) -> DataFrame:
    """All concepts that similar pages of different chapters share."""
    known = taxonomy(spark, sf)
    m, s = mentioned(spark, sf, again=True, known=known), stop(spark, sf, known)
    rows = m.join(s, "concept", "left_anti").select(F.concat_ws("\x1f", "module", "section").alias("topic"), T.keyword_id(F.col("concept")).alias("keyword"))
    return graph.with_evidence(graph.topic_bridges(m, s), rows, "keyword", "topic").select("l", "r", F.array_join("evidence", "|").alias("evidence"))


MAIN = """ch AS (SELECT concept, module, sum(n) AS n FROM men GROUP BY ALL), mc AS (SELECT concept, module, pos, n FROM ch JOIN chap USING (module) QUALIFY row_number() OVER (PARTITION BY concept ORDER BY n DESC, pos) = 1),
pk AS (SELECT *, row_number() OVER (PARTITION BY module ORDER BY n DESC, concept) AS rank FROM mc ANTI JOIN stp USING (concept) QUALIFY rank <= 3),
ot AS (SELECT pk.concept, string_agg(c.chapter_id, '|' ORDER BY c.pos) FILTER (k <= 4) AS also_in FROM pk JOIN (SELECT ch.concept, ch.module, chap.pos, chapter_id, row_number() OVER (PARTITION BY ch.concept ORDER BY chap.pos) AS k
   FROM ch JOIN chap USING (module) JOIN pk p2 ON p2.concept = ch.concept AND p2.module <> ch.module) c ON c.concept = pk.concept GROUP BY pk.concept),
st AS (SELECT pos, 0 AS rank, chapter_id AS node, chapter_id AS chapter, '' AS also_in FROM chap UNION ALL
   SELECT pk.pos, rank, 'keyword:' || pk.concept, chapter_id, coalesce(also_in, '') FROM pk JOIN chap USING (module) LEFT JOIN ot ON ot.concept = pk.concept)"""


@query(f"WITH {BASE}, {MAIN} SELECT CAST(row_number() OVER (ORDER BY pos, rank) AS INTEGER) AS step, node, chapter, also_in FROM st")
def learning_path(spark: SparkSession, sf: str) -> DataFrame:
    c, known = chunks(spark, sf), taxonomy(spark, sf)
    path = graph.learning_path(mentioned(spark, sf, again=True, known=known), graph.chapters(c), stop(spark, sf, known))
    return path.withColumn("also_in", F.array_join("also_in", "|"))


def built(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    known = taxonomy(spark, sf)
    return graph.build(chunks(spark, sf), known, stop(spark, sf, known))


def plain_edges(spark: SparkSession, sf: str, m: DataFrame | None = None) -> DataFrame:
    """All edges but bridges, stored: what is made of them reads them many times. ``m``: the mentions, if they are at hand."""
    c, m = chunks(spark, sf), m or mentioned(spark, sf, again=True)
    kinds = [graph.contains_edges(c), graph.mentions_edges(m), graph.covers_edges(m), graph.sequence_edges(graph.chapters(c))]
    rel = graph.related_edges(graph.related_concepts(m), "evidence", T.keyword_id(F.col("l")), T.keyword_id(F.col("r")))
    out = rel
    for k in kinds:
        out = out.unionByName(k)
    return stored(out)


ALL_EDGES = f"""{EDGES}, {RELATED}, edge AS (SELECT * FROM ne UNION ALL SELECT * FROM me UNION ALL SELECT * FROM ce UNION ALL SELECT * FROM se UNION ALL
 SELECT 'keyword:' || l, 'keyword:' || r, 'related', 'evidence', round_even(score, 4), NULL FROM rc)"""
NODES = f"""node AS (SELECT chapter_id AS id, 'chapter' AS type, CAST(NULL AS VARCHAR) AS chapter_id FROM chap UNION ALL SELECT DISTINCT {TID}, 'topic', {CID} FROM chunks UNION ALL SELECT DISTINCT {KID}, 'keyword', NULL FROM men)"""


@query(f"WITH {BASE}, {ALL_EDGES} SELECT type, count(*) AS n FROM edge GROUP BY type")
def edge_histogram(spark: SparkSession, sf: str) -> DataFrame:
    return plain_edges(spark, sf).groupBy("type").agg(F.count("*").alias("n"))


@query(f"WITH {BASE}, {ALL_EDGES} SELECT id, count(*) AS degree FROM (SELECT source AS id FROM edge UNION ALL SELECT target FROM edge) GROUP BY id")
def node_degrees(spark: SparkSession, sf: str) -> DataFrame:
    return graph.degrees(plain_edges(spark, sf))


@query("""WITH e AS (SELECT l_orderkey AS emitted, least(l_partkey % 50, l_suppkey % 50) AS a, greatest(l_partkey % 50, l_suppkey % 50) AS b, l_partkey % 50 AS s, l_suppkey % 50 AS t, CASE WHEN l_linenumber % 2 = 0 THEN 'related' ELSE 'covers' END AS type, l_linenumber FROM lineitem)
SELECT CAST(CASE WHEN type = 'related' THEN a ELSE s END AS VARCHAR) AS source, CAST(CASE WHEN type = 'related' THEN b ELSE t END AS VARCHAR) AS target, type, min(emitted) AS emitted FROM e GROUP BY ALL""")
def edge_dedupe(spark: SparkSession, sf: str) -> DataFrame:
    """The first of each edge among line items; ``related`` ones have no direction."""
    li = table(spark, sf, "lineitem")
    edges = li.select((F.col("l_partkey") % 50).cast("string").alias("source"), (F.col("l_suppkey") % 50).cast("string").alias("target"), F.when(F.col("l_linenumber") % 2 == 0, "related").otherwise("covers").alias("type"), F.col("l_orderkey").alias("emitted"))
    d = graph.distinct_edges(edges)
    as_long = lambda c: F.col(c).cast("long")
    low = F.when(as_long("source") <= as_long("target"), F.col("source")).otherwise(F.col("target"))
    high = F.when(as_long("source") <= as_long("target"), F.col("target")).otherwise(F.col("source"))
    related = F.col("type") == "related"
    return d.select(F.when(related, low).otherwise(F.col("source")).alias("source"), F.when(related, high).otherwise(F.col("target")).alias("target"), "type", "emitted")


@query(f"""WITH {BASE}, {ALL_EDGES}, {NODES}, bad AS (SELECT * FROM edge UNION ALL SELECT 'keyword:none', 'chapter:en', 'covers', '', 1.0, NULL UNION ALL SELECT 'chapter:en', 'chapter:en', 'covers', '', 1.0, NULL),
nn AS (SELECT * FROM node UNION ALL SELECT 'keyword:lonely', 'keyword', NULL UNION ALL SELECT 'chapter:en', 'chapter', NULL)
SELECT 'duplicate node' AS problem, id AS subject FROM nn GROUP BY id HAVING count(*) > 1 UNION ALL SELECT 'missing source', source FROM bad WHERE source NOT IN (SELECT id FROM nn)
UNION ALL SELECT 'missing target', target FROM bad WHERE target NOT IN (SELECT id FROM nn) UNION ALL SELECT 'self edge', source FROM bad WHERE source = target
UNION ALL SELECT 'orphan keyword', id FROM nn WHERE type = 'keyword' AND id NOT IN (SELECT source FROM bad UNION SELECT target FROM bad)
UNION ALL SELECT 'duplicate edge', source || ' ' || target || ' ' || type FROM bad GROUP BY source, target, type HAVING count(*) > 1""")
def graph_validate(spark: SparkSession, sf: str) -> DataFrame:
    """The checks over the graph with planted faults."""
    n, _, m = _nodes(spark, sf)
    e = plain_edges(spark, sf, m).select("source", "target", "type")
    faults = spark.createDataFrame([("keyword:none", "chapter:en", "covers"), ("chapter:en", "chapter:en", "covers")], "source string, target string, type string")
    extra = spark.createDataFrame([("keyword:lonely", "keyword", None), ("chapter:en", "chapter", None)], "id string, type string, chunks long")
    return graph.validate(n.select("id", "type", "chunks").unionByName(extra), e.unionByName(faults))


def _nodes(spark: SparkSession, sf: str, known: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The nodes, stored, the chunks and their mentions."""
    c, known = chunks(spark, sf), known or taxonomy(spark, sf)
    m = mentioned(spark, sf, again=True, known=known)
    return stored(graph.nodes(c, known, m, graph.chapters(c))), c, m


@query()
def course_graph_edges(spark: SparkSession, sf: str) -> DataFrame:
    """All edges of the built graph, bridges included."""
    return built(spark, sf)[1].select("source", "target", "type", "basis", "weight", "mention_count")



ADJ = f"""adj AS (SELECT source AS node, target AS other, type, weight, mention_count FROM edge UNION ALL SELECT target, source, type, weight, mention_count FROM edge),
ctr AS (SELECT 'keyword:' || min(id) AS c FROM tax),
nb AS (SELECT other AS id, round(max(coalesce(weight, 0.5) + 0.01 * sqrt(CAST(coalesce(mention_count, 0) AS DOUBLE))), 9) AS weight FROM adj, ctr WHERE node = c AND other <> c GROUP BY other),
nr AS (SELECT nb.id, node.type, weight, CAST(row_number() OVER (PARTITION BY node.type ORDER BY weight DESC, nb.id DESC) AS INTEGER) AS rank FROM nb JOIN node USING (id) QUALIFY rank <= CASE node.type WHEN 'keyword' THEN 8 WHEN 'topic' THEN 6 ELSE 16 END)"""


def center(known: DataFrame) -> str:
    """The node that the views are about: the taxonomy's first concept."""
    return "keyword:" + known.agg(F.min("id")).head()[0]


@query(f"WITH {BASE}, {ALL_EDGES}, {NODES}, {ADJ} SELECT id, type, weight, rank FROM nr")
def neighborhood(spark: SparkSession, sf: str) -> DataFrame:
    known = taxonomy(spark, sf)
    n, _, m = _nodes(spark, sf, known)
    return views.neighbours(n, plain_edges(spark, sf, m), center(known)).select("id", "type", "weight", "rank")


@query(f"""WITH {BASE}, {ALL_EDGES}, {NODES}, {ADJ}, sh AS (SELECT id, type FROM nr UNION ALL SELECT c, 'keyword' FROM ctr),
el AS (SELECT e.*, a.type AS ta, b.type AS tb FROM edge e JOIN sh a ON a.id = e.source JOIN sh b ON b.id = e.target WHERE e.type <> 'sequence' AND source <> target
  QUALIFY row_number() OVER (PARTITION BY least(source, target), greatest(source, target) ORDER BY coalesce(weight, 0.5) DESC, e.type, source) = 1),
ek AS (SELECT *, source = c OR target = c AS own FROM el, ctr), er AS (SELECT *, row_number() OVER (PARTITION BY own ORDER BY (ta = 'chapter' OR tb = 'chapter') DESC, coalesce(weight, 0.5) DESC, source, target) AS k FROM ek)
SELECT source, target, type, weight FROM er WHERE own OR k <= 30""")
def neighborhood_links(spark: SparkSession, sf: str) -> DataFrame:
    known = taxonomy(spark, sf)
    n, _, m = _nodes(spark, sf, known)
    return views.links(n, plain_edges(spark, sf, m), center(known))


NEAR = """adj AS (SELECT source AS node, target AS other, weight, mention_count FROM edge UNION ALL SELECT target, source, weight, mention_count FROM edge),
nb AS (SELECT node, other AS id, round(max(coalesce(weight, 0.5) + 0.01 * sqrt(CAST(coalesce(mention_count, 0) AS DOUBLE))), 9) AS weight FROM adj WHERE node <> other GROUP BY ALL),
ty AS (SELECT id, type FROM node),
nr AS (SELECT nb.node, nb.id, ty.type, nb.weight, CAST(row_number() OVER (PARTITION BY nb.node, ty.type ORDER BY nb.weight DESC, nb.id DESC) AS INTEGER) AS rank FROM nb JOIN ty ON ty.id = nb.id
  QUALIFY rank <= CASE ty.type WHEN 'keyword' THEN 8 WHEN 'topic' THEN 6 ELSE 16 END)"""


@query(f"WITH {BASE}, {ALL_EDGES}, {NODES}, {NEAR} SELECT node, id, type, weight, rank FROM nr")
def neighborhoods(spark: SparkSession, sf: str) -> DataFrame:
    """The neighbourhoods of all nodes."""
    n, _, m = _nodes(spark, sf)
    return views.neighborhoods(n, plain_edges(spark, sf, m))


@query(f"""WITH {BASE}, {ALL_EDGES}, {NODES}, {NEAR}, sh AS (SELECT node, id, type FROM nr UNION ALL SELECT id, id, type FROM ty),
el AS (SELECT a.node, e.source, e.target, e.type, e.weight, a.type = 'chapter' OR b.type = 'chapter' AS ch FROM edge e JOIN sh a ON a.id = e.source JOIN sh b ON b.id = e.target AND b.node = a.node WHERE e.type <> 'sequence' AND e.source <> e.target
  QUALIFY row_number() OVER (PARTITION BY a.node, least(e.source, e.target), greatest(e.source, e.target) ORDER BY coalesce(e.weight, 0.5) DESC, e.type, e.source) = 1),
er AS (SELECT *, source = node OR target = node AS own, row_number() OVER (PARTITION BY node, source = node OR target = node ORDER BY ch DESC, coalesce(weight, 0.5) DESC, source, target) AS k FROM el)
SELECT node, source, target, type, weight FROM er WHERE own OR k <= 30""")
def neighborhoods_links(spark: SparkSession, sf: str) -> DataFrame:
    """The links among each node and its neighbours."""
    n, _, m = _nodes(spark, sf)
    return views.all_links(n, plain_edges(spark, sf, m))


@query(f"WITH {BASE}, {EDGES} SELECT source, target, weight, row_number() OVER (PARTITION BY target ORDER BY weight DESC, source) > 1 AS secondary FROM ce QUALIFY row_number() OVER (PARTITION BY target ORDER BY weight DESC, source) <= 2")
def skeleton_edges(spark: SparkSession, sf: str) -> DataFrame:
    return views.skeleton(graph.covers_edges(mentioned(spark, sf)))


@query(f"""WITH {BASE}, {EDGES}, {MAIN}, sp AS (SELECT CAST(row_number() OVER (ORDER BY pos, rank) AS INTEGER) AS step, node, chapter FROM st), tp AS (SELECT DISTINCT {TID} AS topic, {CID} AS chapter FROM chunks)
SELECT step, topic, CAST(row_number() OVER (PARTITION BY step ORDER BY weight DESC, topic) AS INTEGER) AS rank FROM sp JOIN me ON me.target = sp.node JOIN tp ON tp.topic = me.source AND tp.chapter = sp.chapter WHERE node <> sp.chapter QUALIFY rank <= 3""")
def path_pages(spark: SparkSession, sf: str) -> DataFrame:
    known = taxonomy(spark, sf)
    n, c, m = _nodes(spark, sf, known)
    path = graph.learning_path(m, graph.chapters(c), stop(spark, sf, known))
    return views.path_pages(path, graph.mentions_edges(m), n)


@query(f"""WITH {BASE}, {EDGES}, {NODES} SELECT id, type, chapter_id FROM node""")
def slim_nodes(spark: SparkSession, sf: str) -> DataFrame:
    n, c, _ = _nodes(spark, sf)
    return views.slim(n, graph.contains_edges(c))[0].select("id", "type", "chapter_id")


# ------------------------------------------------------------------ the same joins at scale, over the star schema


@query(f"""WITH bo AS (SELECT DISTINCT o_custkey AS k, p_brand AS m FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey), {pair_sql('bo', 'k', 'm')}
SELECT l, r, n_shared, round(n_shared / sqrt(CAST(n_l AS DOUBLE) * n_r), 6) AS score FROM par WHERE n_shared / sqrt(CAST(n_l AS DOUBLE) * n_r) >= 0.10""")
def brand_similarity(spark: SparkSession, sf: str) -> DataFrame:
    """Brands by the customers they share."""
    li, o, p = (table(spark, sf, t) for t in ("lineitem", "orders", "part"))
    rows = li.join(o, li.l_orderkey == o.o_orderkey).join(p, li.l_partkey == p.p_partkey).select("o_custkey", "p_brand")
    pairs = graph.shared(rows, "o_custkey", "p_brand").withColumn("score", graph.ochiai())
    return pairs.filter(F.col("score") >= C.CONCEPT_SIMILARITY).select("l", "r", "n_shared", F.round("score", 6).alias("score"))


@query("SELECT CAST(l_suppkey AS BIGINT) AS author, count(DISTINCT l_orderkey) AS papers FROM lineitem GROUP BY ALL HAVING count(DISTINCT l_orderkey) >= 3")
def collaborators(spark: SparkSession, sf: str) -> DataFrame:
    """Suppliers as authors of orders, with at least three."""
    rows = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("paper"), F.col("l_suppkey").cast("long").alias("author"))
    return publications.collaborators(rows)


@query("WITH e AS (SELECT DISTINCT l_orderkey AS o, p_brand FROM lineitem JOIN part ON l_partkey = p_partkey) SELECT p_brand AS theme, count(*) AS papers FROM e GROUP BY ALL")
def themes(spark: SparkSession, sf: str) -> DataFrame:
    """Brands as themes of orders."""
    li, p = table(spark, sf, "lineitem"), table(spark, sf, "part")
    rows = li.join(p, li.l_partkey == p.p_partkey).select("l_orderkey", "p_brand").distinct()
    return rows.groupBy(F.col("p_brand").alias("theme")).agg(F.count("*").alias("papers"))


@query("SELECT CAST(c_custkey AS BIGINT) AS id FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders)")
def isolated_nodes(spark: SparkSession, sf: str) -> DataFrame:
    """Customers that an order touches; the isolated ones drop out."""
    o = table(spark, sf, "orders").select(F.col("o_custkey").alias("source"), F.col("o_custkey").alias("target"))
    return publications.connected(table(spark, sf, "customer").select(F.col("c_custkey").cast("long").alias("id")), o)
