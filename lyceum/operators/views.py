"""Views of the graph: neighbourhoods, page lookup, search and projections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import constants as C
from ..functions import urls
from .sizes import broadcast_if_small, checkpointed


def adjacency(edges: DataFrame) -> DataFrame:
    """Every edge from both of its ends: (node, other, type, weight, mention_count)."""
    keep = ["type", "weight", "mention_count"]
    return edges.select(F.col("source").alias("node"), F.col("target").alias("other"), *keep).unionByName(edges.select(F.col("target").alias("node"), F.col("source").alias("other"), *keep))


def neighbours(nodes: DataFrame, edges: DataFrame, center: str, limits: dict[str, int] | None = None) -> DataFrame:
    """(id, type, weight, rank): the best neighbours of each type, by weight and a little by mentions."""
    limits = limits or C.NEIGHBOUR_LIMITS
    weight = F.coalesce("weight", F.lit(0.5)) + 0.01 * F.sqrt(F.coalesce("mention_count", F.lit(0)).cast("double"))
    best = adjacency(edges).filter(F.col("node") == center).groupBy(F.col("other").alias("id")).agg(F.round(F.max(weight), 9).alias("weight"))
    order = Window.partitionBy("type").orderBy(F.desc("weight"), F.desc("id"))
    rows = best.join(nodes.select("id", "type"), "id").withColumn("rank", F.row_number().over(order))
    within = F.lit(False)
    for kind, n in limits.items():
        within = within | ((F.col("type") == kind) & (F.col("rank") <= n))
    return rows.filter(within & (F.col("id") != center))


def links(nodes: DataFrame, edges: DataFrame, center: str, others: int = C.OTHER_LINKS) -> DataFrame:
    """(source, target, type, weight): links among a node and its neighbours; all of the centre's, of the others the best ``others``, those that touch a chapter first.

    Of several edges of a pair the heaviest stays, then the first type. Sequence edges don't show.
    """
    shown = neighbours(nodes, edges, center).select("id", "type").unionByName(nodes.filter(F.col("id") == center).select("id", "type"))
    rows = edges.filter("type <> 'sequence' and source <> target")
    rows = rows.join(F.broadcast(shown.select(F.col("id").alias("source"), F.col("type").alias("_a"))), "source").join(F.broadcast(shown.select(F.col("id").alias("target"), F.col("type").alias("_b"))), "target")
    pair = Window.partitionBy(F.least("source", "target"), F.greatest("source", "target")).orderBy(F.desc(F.coalesce("weight", F.lit(0.5))), "type", "source")
    rows = rows.withColumn("_n", F.row_number().over(pair)).filter("_n = 1")
    own = (F.col("source") == center) | (F.col("target") == center)
    chapter = (F.col("_a") == "chapter") | (F.col("_b") == "chapter")
    order = Window.partitionBy(own).orderBy(F.desc(chapter), F.desc(F.coalesce("weight", F.lit(0.5))), "source", "target")
    return rows.withColumn("_r", F.row_number().over(order)).filter(own | (F.col("_r") <= others)).select("source", "target", "type", "weight")


def neighborhoods(nodes: DataFrame, edges: DataFrame, limits: dict[str, int] | None = None) -> DataFrame:
    """(node, id, type, weight, rank): what ``neighbours`` gives, of every node at once. Node ids are unique; ends that aren't nodes have no type and don't show.

    A node's edges are ranked where they are before they meet, so a node with very many of them sends only its best of each task.
    """
    limits = limits or C.NEIGHBOUR_LIMITS
    weight = F.coalesce("weight", F.lit(0.5)) + 0.01 * F.sqrt(F.coalesce("mention_count", F.lit(0)).cast("double"))
    best = adjacency(edges).filter("node <> other").groupBy("node", F.col("other").alias("id")).agg(F.round(F.max(weight), 9).alias("weight"))
    order = Window.partitionBy("node", "type").orderBy(F.desc("weight"), F.desc("id"))
    rows = best.join(nodes.select("id", "type"), "id").filter(F.col("type").isin(*limits)).withColumn("rank", F.row_number().over(order))
    # The greatest limit alone bounds what a task sends on; each type's own follows.
    rows = rows.filter(F.col("rank") <= max(limits.values()))
    within = F.lit(False)
    for kind, n in limits.items():
        within = within | ((F.col("type") == kind) & (F.col("rank") <= n))
    return rows.filter(within).select("node", "id", "type", "weight", "rank")


def all_links(nodes: DataFrame, edges: DataFrame, others: int = C.OTHER_LINKS) -> DataFrame:
    """(node, source, target, type, weight): what ``links`` gives, of every node at once.

    A link shows in a neighbourhood that holds both of its ends. Each starts from its end that fewer neighbourhoods hold, and these are asked for the
    other end; a link between two nodes that many hold costs as much as the rarer of them, and each of these nodes has few rarer ones than itself.
    """
    edges = checkpointed(edges.select("source", "target", "type", "weight", "mention_count"))
    kinds = nodes.select("id", "type")
    held = neighborhoods(nodes, edges).select("node", "id").unionByName(kinds.select(F.col("id").alias("node"), "id"))
    held = checkpointed(held)
    pair = Window.partitionBy(F.least("source", "target"), F.greatest("source", "target")).orderBy(F.desc(F.coalesce("weight", F.lit(0.5))), "type", "source")
    rows = edges.filter("type <> 'sequence' and source <> target").withColumn("_n", F.row_number().over(pair)).filter("_n = 1").select("source", "target", "type", "weight")
    often = held.groupBy("id").agg(F.count("*").alias("n")).join(kinds, "id")
    for end, letter in (("source", "a"), ("target", "b")):
        rows = rows.join(often.select(F.col("id").alias(end), F.col("n").alias(f"_n{letter}"), F.col("type").alias(f"_{letter}")), end)
    first = F.col("_na") <= F.col("_nb")
    rows = rows.withColumn("_from", F.when(first, F.col("source")).otherwise(F.col("target"))).withColumn("_to", F.when(first, F.col("target")).otherwise(F.col("source")))
    rows = rows.join(held.select("node", F.col("id").alias("_from")), "_from").join(held.select("node", F.col("id").alias("_to")), ["node", "_to"])
    own = (F.col("source") == F.col("node")) | (F.col("target") == F.col("node"))
    chapter = (F.col("_a") == "chapter") | (F.col("_b") == "chapter")
    order = Window.partitionBy("node").orderBy(F.desc(chapter), F.desc(F.coalesce("weight", F.lit(0.5))), "source", "target")
    of_others = rows.filter(~own).withColumn("_r", F.row_number().over(order)).filter(F.col("_r") <= others).drop("_r")
    return rows.filter(own).unionByName(of_others).select("node", "source", "target", "type", "weight")


def page_lookup(addresses: DataFrame, pages: DataFrame, base: str = "") -> DataFrame:
    """(address, id): the page whose slug is the longest suffix of each address below ``base``; the home page's slug is empty.

    ``addresses``: key columns and ``address``; ``pages``: (slug, id).
    """
    prefix = base.strip("/").lower()
    norm = urls.normalize_address("address")
    rest = F.when(norm == prefix, F.lit("")).otherwise(F.regexp_replace(norm, "^" + prefix + "/", "")) if prefix else norm
    rows = addresses.withColumn("slug", F.explode(F.when(rest == "", F.array(F.lit(""))).otherwise(urls.suffixes(rest))))
    keys = addresses.columns
    hit = rows.join(pages, "slug")
    return hit.groupBy(*keys).agg(F.max_by("id", F.struct(F.length("slug"), F.col("id"))).alias("id"))


def search_box(nodes: DataFrame, text: str, limit: int = 9) -> DataFrame:
    """Nodes for what is typed: equal, then prefix, then inside the label, then inside an alias; hidden ones never."""
    q = text.strip().lower()
    label = F.lower("label")
    score = F.when(label == q, 0).when(label.startswith(q), 1).when(label.contains(q), 2).when(F.exists(F.coalesce("aliases", F.array().cast("array<string>")), lambda a: F.lower(a).contains(q)), 3)
    return nodes.filter("coalesce(visibility, '') <> 'hidden'").withColumn("score", score).filter("score is not null").orderBy("score", "label", "id").limit(limit)


def shown(nodes: DataFrame) -> DataFrame:
    """Nodes that aren't hidden; pages of hidden chapters are."""
    hidden = nodes.filter("type = 'chapter' and visibility = 'hidden'").select(F.col("id").alias("chapter_id"))
    return nodes.filter("coalesce(visibility, '') <> 'hidden'").join(broadcast_if_small(hidden), "chapter_id", "left_anti").select(*nodes.columns)


NODE_FIELDS = ["id", "type", "label", "visibility", "category", "mention_count", "chapter_id"]
EDGE_FIELDS = ["source", "target", "type", "weight"]


def slim(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What a browser needs of the graph."""
    file = F.col("source_file") if "source_file" in nodes.columns else F.lit(None).cast("string")
    return nodes.select(*NODE_FIELDS, file.alias("file")), edges.select(*EDGE_FIELDS)


def skeleton(edges: DataFrame, k: int = 2) -> DataFrame:
    """The k heaviest ``covers`` of each concept; from the second on they are secondary."""
    order = Window.partitionBy("target").orderBy(F.desc("weight"), "source")
    rows = edges.filter("type = 'covers'").withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return rows.select("source", "target", "weight", (F.col("rank") > 1).alias("secondary"))


def path_pages(path: DataFrame, edges: DataFrame, nodes: DataFrame, k: int = 3) -> DataFrame:
    """(step, topic, rank): for a concept's step the k pages of its chapter that mention it most."""
    topics = nodes.filter("type = 'topic'").select(F.col("id").alias("topic"), F.col("chapter_id").alias("chapter"))
    hits = edges.filter("type = 'mentions'").select(F.col("source").alias("topic"), F.col("target").alias("node"), "weight")
    rows = path.filter("node <> chapter").join(hits, "node").join(topics, ["topic", "chapter"])
    order = Window.partitionBy("step").orderBy(F.desc("weight"), "topic")
    return rows.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("step", "topic", "rank")


def labels_of(context: DataFrame, nodes: DataFrame, k: int = 4) -> DataFrame:
    """(key, labels): the labels of up to k node ids in their order; unknown ids drop out before the cut."""
    rows = context.select("key", F.posexplode("ids").alias("n", "id")).join(nodes.select("id", "label"), "id")
    return rows.groupBy("key").agg(F.slice(F.transform(F.array_sort(F.collect_list(F.struct("n", "label"))), lambda x: x["label"]), 1, k).alias("labels"))


def cards(nodes: DataFrame, edges: DataFrame, field: str, descending: bool = True, k: int = 6) -> DataFrame:
    """(node, other, rank): each node's neighbours sorted by a field of theirs."""
    rows = adjacency(edges).select("node", F.col("other").alias("id")).distinct().join(nodes.select("id", F.col(field).alias("_f")), "id")
    order = Window.partitionBy("node").orderBy(F.col("_f").desc_nulls_last() if descending else F.col("_f").asc_nulls_last(), "id")
    return rows.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("node", F.col("id").alias("other"), "rank")


def public(nodes: DataFrame) -> DataFrame:
    return nodes.select("id", "type", "label", "visibility")


def center_of(columns: list[Column]) -> Column:
    return F.aggregate(F.array(*columns), F.lit(0.0), lambda a, x: a + x) / len(columns)
