"""The neighbourhoods of all nodes are those of each node, and a node of very many edges stays cheap."""

import random

from lyceum.operators import views

EDGE = "source string, target string, type string, weight double, mention_count long"


def graph_of(spark, hub):
    rng = random.Random(4)
    kinds = {f"k{i}": "keyword" for i in range(20)} | {f"t{i}": "topic" for i in range(12)} | {f"c{i}": "chapter" for i in range(3)} | {f"x{i}": "keyword" for i in range(hub)}
    names = [n for n in kinds if not n.startswith("x")]
    edges = [(*rng.sample(names, 2), rng.choice(["mentions", "covers", "related", "sequence"]), rng.choice([None, 0.25, 0.5, 1.0]), rng.choice([None, 1, 9])) for _ in range(150)]
    edges += [("k0", "k0", "related", 1.0, 1), ("k1", "gone", "covers", 1.0, 1)] + [("k0", f"x{i}", "related", 0.5, i) for i in range(hub)]
    return spark.createDataFrame(list(kinds.items()), "id string, type string"), spark.createDataFrame(edges, EDGE)


def test_all_nodes_at_once(spark):
    nodes, edges = (df.persist() for df in graph_of(spark, 0))
    near, among = views.neighborhoods(nodes, edges).collect(), views.all_links(nodes, edges).collect()
    plain = edges.filter("source <> target").persist()
    for center in ("k0", "k7", "t3", "c1"):
        assert {(r.id, r.type, r.weight, r.rank) for r in near if r.node == center} == {(r.id, r.type, r.weight, r["rank"]) for r in views.neighbours(nodes, plain, center).collect()}
        assert {tuple(r)[1:] for r in among if r.node == center} == {tuple(r) for r in views.links(nodes, plain, center).collect()}
    assert not any(r.id == "gone" or r.node == r.id for r in near)


def test_a_hub(spark):
    """Limits hold for a node with a thousand neighbours, and only its best of each task are sent."""
    nodes, edges = graph_of(spark, 1000)
    near = views.neighborhoods(nodes, edges)
    assert "WindowGroupLimit" in near._jdf.queryExecution().executedPlan().toString()
    of = {}
    for r in near.collect():
        of.setdefault((r.node, r.type), []).append(r["rank"])
    assert all(sorted(v) == list(range(1, len(v) + 1)) for v in of.values()) and len(of["k0", "keyword"]) == 8
    assert views.neighborhoods(nodes.limit(0), edges.limit(0)).count() == 0
