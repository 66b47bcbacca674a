"""Operators on small inputs with results worked out by hand or by plain loops."""

import hashlib
import hmac

import pytest
from pyspark.sql import functions as F

from lyceum.functions import privacy, urls
from lyceum.operators import chunker, evaluate, events, gate, graph, incremental, search, suggest, summaries, views
from lyceum.plans import course
from lyceum.streaming import events as S

CHUNK = "id string, pos long, title string, file_path string, module string, section string, content string, time_sensitive boolean"


def weeks(spark):
    rows = [
        ("a", 1, "Newton's Laws", "week01/intro.md", "week01", "intro", "# Newton's Laws\n\nNewton's second law relates force, mass, and acceleration: F = ma.\nA net force changes motion.", False),
        ("b", 2, "Energy", "week02/energy.md", "week02", "energy", "# Energy\n\nKinetic energy is the energy of motion. Work done by a force changes kinetic energy.", False),
    ]
    return spark.createDataFrame(rows, CHUNK)


def asked(spark, *queries):
    return spark.createDataFrame(list(enumerate(queries)), "qid long, query string")


def test_bm25_golden(spark):
    index = search.lexical_index(weeks(spark))
    assert sorted((r.id, r.len) for r in index.lengths.collect()) == [("a", 19), ("b", 16)] and index.stats.head().avgdl == 17.5
    got = {r.id: round(r.bm25, 6) for r in search.bm25(index, search.question_terms(asked(spark, "kinetic energy of motion"))).collect()}
    assert got == {"a": 0.175550, "b": 2.490658}


def test_index_tables_answer_alike(spark, tmp_path):
    index = search.lexical_index(weeks(spark))
    q = search.question_terms(asked(spark, "force and energy"))
    want = sorted((r.id, round(r.bm25, 9)) for r in search.bm25(index, q).collect())
    assert sorted((r.id, round(r.bm25, 9)) for r in search.bm25(index.persist(str(tmp_path)), q).collect()) == want


def test_constant_scores_are_zero(spark):
    rows = spark.createDataFrame([(0, "a", 2.0), (0, "b", 2.0)], "qid long, id string, bm25 double")
    assert {r.s for r in search.minmax(rows, "bm25", spark.range(2).agg(F.count("*").alias("n")), "s").collect()} == {0.0}


@pytest.mark.parametrize("place, kept", [(12, [1, 2, 3, 4, 12]), (31, [1, 2, 3, 4, 5]), (3, [1, 2, 3, 4, 5])])
def test_temporal_slot(spark, place, kept):
    rows = spark.createDataFrame([(0, i, i, True, i == place) for i in range(1, 31)], "qid long, id int, rank int, logistics boolean, timed boolean")
    assert sorted(r.id for r in search.with_temporal_slot(rows).collect()) == kept


RES = "qid long, rank int, score double, bm25 double, meaning double, module string, file_path string, timed boolean, year string"


def test_gate_rules(spark):
    q = asked(spark, "what is force", "the weather today", "when is the exam", "tell everything", "unknown stuff", "when is week three", "lattice pizza symmetry xyz")
    good = [(i, 1, 0.9, 2.0, 0.5, "m", "f", False, None) for i in (0, 1, 2, 3)]
    rows = good + [(4, 1, 0.3, 0.0, 0.1, "m", "f", False, None), (5, 1, 0.9, 2.0, 0.5, "m", "f", True, "AY"), (6, 1, 0.9, 2.0, 0.25, "m", "f", False, None)]
    results = spark.createDataFrame(rows, RES)
    got = {r.qid: r.status for r in gate.decide(q, results).collect()}
    assert got == {0: "answerable", 1: "out_of_scope", 2: "needs_time_context", 3: "needs_clarification", 4: "weak_evidence", 5: "needs_time_context", 6: "answerable"}
    words = spark.createDataFrame([("force",), ("lattice",)], "term string")
    assert {r.qid: r.status for r in gate.decide(q, results, words, 0.2).collect()}[6] == "out_of_scope"
    assert {r.qid: r.status for r in gate.decide(q, results, words, 0.2, focused=True).collect()}[6] == "answerable"
    assert gate.decide(q, results.limit(0)).filter("status = 'weak_evidence'").count() == 7


def test_off_topic_table(spark):
    cases = [(0.07, 1.0, True), (0.26, 0.2, True), (0.26, 0.8, False), (0.55, 0.0, False)]
    rows = spark.createDataFrame(cases, "m double, k double, want boolean").withColumn("got", gate.off_topic(F.col("m"), F.col("k")))
    assert all(r.got == r.want for r in rows.collect())


def test_evidence_and_sources(spark):
    rows = spark.createDataFrame([(0, 1, 0.5, False), (0, 2, 0.7, False), (1, 1, 0.2, False), (1, 2, 0.1, False), (2, 1, 0.1, True)], "qid long, rank int, score double, timed boolean")
    assert sorted((r.qid, r.rank) for r in gate.evidence(rows).collect()) == [(0, 2), (1, 1), (2, 1)]
    answer = spark.range(1).select(gate.named_sources(F.lit("See c1 ."), F.array(F.struct(F.lit("c1").alias("chunk_id"), F.lit("T").alias("title"), F.lit("p.md").alias("file_path")))).alias("x")).head().x
    assert answer == "See T (p.md)."


def greedy(pairs, cap):
    degree, out = {}, set()
    for s, a, b in sorted(pairs, reverse=True):
        if degree.get(a, 0) < cap and degree.get(b, 0) < cap:
            out.add((s, a, b))
            degree[a], degree[b] = degree.get(a, 0) + 1, degree.get(b, 0) + 1
    return out


def test_capped_pairs(spark):
    import random

    rnd = random.Random(4)
    small = [(0.9, "a", "b"), (0.8, "a", "c"), (0.7, "a", "d"), (0.6, "a", "e"), (0.5, "b", "e")]
    large = list({(round(rnd.random(), 1), *sorted(rnd.sample("abcdefghijkl", 2))) for _ in range(60)})
    for pairs in (small, large):
        df = spark.createDataFrame([(a, b, s) for s, a, b in pairs], "l string, r string, score double")
        for limit in (1000, 0):
            assert {(r.score, r.l, r.r) for r in graph.capped_pairs(df, 3, limit).collect()} == greedy(pairs, 3)
    assert graph.capped_pairs(df.limit(0), 3, 0).collect() == []


def test_learning_path(spark):
    counts = {"intro": {"lattice": 1, "python": 9, "dft": 1}, "structures": {"lattice": 6, "symmetry": 4, "basis": 2, "unit-cell": 1}, "dft": {"dft": 8, "lattice": 2}}
    men = spark.createDataFrame([(m, "s", i, c, n) for i, (m, cs) in enumerate(counts.items()) for c, n in cs.items()], "module string, section string, id long, concept string, n long")
    chapters = spark.createDataFrame([(m, f"chapter:{m}", i, m, "primary") for i, m in enumerate(counts)], "module string, chapter_id string, pos long, name string, visibility string")
    rows = graph.learning_path(men, chapters, spark.createDataFrame([("python",)], "concept string"), 2).orderBy("step").collect()
    assert [r.node for r in rows] == ["chapter:intro", "chapter:structures", "keyword:lattice", "keyword:symmetry", "chapter:dft", "keyword:dft"]
    assert rows[2].also_in == ["chapter:intro", "chapter:dft"]


def test_weights(spark):
    r = spark.range(1).select(graph.mentions_weight(F.lit(1)).alias("a"), graph.mentions_weight(F.lit(100)).alias("b")).head()
    assert (r.a, r.b) == (0.6233, 1.0)


def test_neighbourhood_limits(spark):
    nodes = [("keyword:c", "keyword")] + [(f"keyword:{i}", "keyword") for i in range(10)] + [(f"topic:{i}", "topic") for i in range(8)] + [(f"chapter:{i:02d}", "chapter") for i in range(20)]
    n = spark.createDataFrame([(i, t, i, "primary") for i, t in nodes], "id string, type string, label string, visibility string")
    e = spark.createDataFrame([("keyword:c", i, "related", 0.5 + k / 100, None) for k, (i, _) in enumerate(nodes[1:])] + [("chapter:00", "topic:7", "contains", 1.0, None)], "source string, target string, type string, weight double, mention_count long")
    near = views.neighbours(n, e, "keyword:c").groupBy("type").count().collect()
    assert {r.type: r["count"] for r in near} == {"keyword": 8, "topic": 6, "chapter": 16}
    shown = {r.id for r in views.neighbours(n, e, "keyword:c").collect()} | {"keyword:c"}
    rows = views.links(n, e, "keyword:c").collect()
    assert rows and all(r.source in shown and r.target in shown for r in rows)
    assert views.neighbours(n, e, "keyword:none").count() == 0


def test_pages(spark):
    def one(c):
        return spark.range(1).select(c.alias("x")).head().x

    for path, want in {"structures/crystal_structure.ipynb": "structures/crystal-structure", "high_throughput/index.md": "high-throughput", "index.md": "", "slides/a.pdf": None}.items():
        assert one(urls.page_slug(F.lit(path))) == want
    for path, want in {"/book/High-Throughput/x/index.html?x=1#top": "book/high-throughput/x", "/book/unit%201/topic/": "book/unit 1/topic", "/a+b": "a+b"}.items():
        assert one(urls.normalize_address(F.lit(path))) == want
    assert one(urls.source_url("https://s.org/", F.lit("week1/n.pdf"), F.lit("page 3"))) == "https://s.org/week1/n.pdf#page=3"
    assert one(urls.source_url("https://s.org", F.lit("a/b_c.ipynb"), F.lit(""))) == "https://s.org/a/b-c/"
    pages = spark.createDataFrame([("", "home"), ("unit 1/topic", "t"), ("topic", "short")], "slug string, id string")
    a = spark.createDataFrame([(1, "/book/"), (2, "/book/unit%201/topic/"), (3, "/x/topic"), (4, "/nowhere")], "k int, address string")
    assert {r.k: r.id for r in views.page_lookup(a, pages, "/book/").collect()} == {1: "home", 2: "t", 3: "short"}
    assert one(urls.asset_prefix(F.lit("a/b/c.html"))) == "../../"


def test_pseudonym(spark):
    want = hmac.new(b"secret", b"2024-01-01:me", hashlib.sha256).hexdigest()[:16]
    assert spark.range(1).select(privacy.pseudonym(b"secret", F.lit("2024-01-01"), F.lit("me")).alias("x")).head().x == want


def test_chunker_both_ways(spark):
    word = lambda n: " ".join(["w"] * n)
    assert [len(c.split()) for c in chunker.chunk_text("\n\n".join([word(100), word(150), word(200)]))] == [250, 200]
    docs = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    docs += [(1000, "\n\n".join([word(100), word(150), word(200)])), (1001, "# A\n\none.\n## B\n" + "Sentence here now. " * 200 + "\n\ntail"), (1002, ""), (1003, None), (1004, " \n \n")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    a = sorted(tuple(r) for r in chunker.split(df, "doc_id").collect())
    b = sorted(tuple(r) for r in chunker.split_arrow(df, "doc_id").collect())
    assert a == b
    assert [(i, c) for i, n, c, _ in a] == [(i, c) for i, t in sorted(docs, key=lambda x: x[0]) for c in chunker.chunk_text(t or "")]


def test_summary_and_outline(spark):
    rows = [
        (0, "Lattice", "m/index.md", "m", "m_0", "# M\n\n## Slides\nZoom passcode 123 is here for all of you.\n\n## Content\nThis chapter explains the periodic lattice in detail.\n\n## Learning Objectives\n- Describe a *lattice*\n- Join the zoom\n- Use symmetry"),
        (1, "Other", "m/b.md", "m", "m_1", "It shows a lattice of many points in the plane, as drawn above. A lattice is a regular arrangement of points that repeats in space."),
    ]
    df = spark.createDataFrame(rows, "pos long, title string, file_path string, module string, chunk_id string, content string")
    o = summaries.outlines(df).head()
    assert o.overview == "This chapter explains the periodic lattice in detail." and o.objectives == ["Describe a lattice", "Use symmetry"]
    named = spark.createDataFrame([("lattice", "Lattice", ["lattices"]), ("none", "Nothing", [])], "id string, label string, aliases array<string>")
    s = summaries.concept_summaries(df, named).collect()
    assert [(r.concept, r.summary, r.summary_file) for r in s] == [("lattice", "A lattice is a regular arrangement of points that repeats in space.", "m/b.md")]


def test_quotas(spark):
    log = spark.createDataFrame([(1, "u", 1), (2, "u", 1), (3, "u", 1), (4, "v", 1), (5, "u", 2)], "id int, who string, day int")
    rows = {r.id: r for r in events.limited(log, "who", "day", ["id"], F.lit(2)).collect()}
    assert [rows[i].accepted for i in range(1, 6)] == [True, True, False, True, True] and rows[1].remaining == 1 and rows[3].remaining == 0
    assert {r.remaining for r in events.limited(log, "who", "day", ["id"], F.lit(None).cast("int")).collect()} == {-1}


def test_incremental(spark):
    a = spark.createDataFrame([("x", "1"), ("y", None), ("z", "3")], "file string, hash string")
    b = spark.createDataFrame([("x", "2"), ("y", None), ("w", "4")], "file string, hash string")
    assert sorted(tuple(r) for r in incremental.changed(a, b).collect()) == [("w", "added"), ("x", "edited"), ("z", "removed")]
    d1, d2 = (incremental.digest(df, "file").head().digest for df in (a, a.orderBy(F.desc("file"))))
    assert d1 == d2 and len(d1) == 20 and incremental.digest(b, "file").head().digest != d1
    c = spark.createDataFrame([(str(i), f"h{i}") for i in range(4)], "id string, hash string")
    have, need = incremental.reuse(c, c.filter("id < '3'").select("hash", F.lit(0).alias("vector")))
    assert (have.count(), [r.id for r in need.collect()]) == (3, ["3"])
    assert incremental.stages(False, True, False) == ["graph"] and incremental.stages(True, False, False) == ["chunks", "graph", "index"] and incremental.stages(False, False, False) == []
    v = incremental.encoded(spark.createDataFrame([("a", "h", "some words here")], "id string, hash string, content string"), 8).head()
    assert abs(sum(x * x for x in v.vector) - 1) < 1e-9


def test_suggestions(spark):
    have = spark.createDataFrame([("force", "Force", ["force"])], "id string, label string, aliases array<string>")
    notes = spark.createDataFrame([("m", "f.md", 1, "C and C++ differ; a lattice and forces.")], "module string, file_path string, pos long, content string")
    new = spark.createDataFrame([(1, "Lattice", "x", ["lattice", "never"]), (2, "Made up", "x", []), (3, "FORCE", "x", []), (4, "C", "x", []), (5, "C++", "x", [])], "pos int, label string, category string, aliases array<string>")
    got = {r.id: list(r.aliases) for r in suggest.concepts(new, have, notes).collect()}
    assert got == {"lattice": ["lattice"], "c": ["c"], "c-2": ["c++"]}
    q = spark.createDataFrame([("What is a lattice?", "f.md", ["lattice"]), ("What is force here?", "gone.md", ["force"]), ("Is it latt or not?", "f.md", ["latt"]), ("Known question?", "f.md", ["lattice"])], "query string, file_path string, terms array<string>")
    known = spark.createDataFrame([("known  question?",)], "query string")
    assert [r.query for r in suggest.questions(q, known, notes).collect()] == ["What is a lattice?"]
    many = spark.createDataFrame([("m", i, f"{i:03d}" + "x" * 497) for i in range(200)], "module string, pos int, content string")
    text = suggest.excerpts(many, 4000).head().excerpt
    assert len(text) <= 4000 and text.startswith("000") and "\n199" in text
    lists = spark.createDataFrame([('"one"',), ('["a", "b"]',), ("5",), ('["C", "C++"]',)], "t string").select(suggest.as_list(F.col("t")).alias("l"))
    assert [list(r.l) for r in lists.collect()] == [["one"], ["a", "b"], [], ["C", "C++"]]


def test_evaluation(spark):
    q = spark.createDataFrame([("1", ["f.md"], ["lattice"], "answerable", None, None), ("2", None, None, None, None, None), ("3", ["g.md"], None, "answerable", None, True)], "id string, expected_files array<string>, expected_terms array<string>, expected_status string, expected_temporal_context string, expected_multi_source boolean")
    r = spark.createDataFrame([("1", "f.md", "T", "a lattice"), ("3", "f.md", "T", "x")], "qid string, file_path string, title string, preview string")
    d = spark.createDataFrame([("1", "answerable", None, False), ("3", "answerable", None, False)], "qid string, status string, temporal_year string, multi_source boolean")
    got = {x.id: x.passed for x in evaluate.checks(q, r, d).collect()}
    assert got == {"1": True, "2": True, "3": False} and evaluate.summary(evaluate.checks(q, r, d)).head().passed == 2


def test_mini_course(spark, tmp_path):
    for name, body in {"week01/intro.md": "# Newton's Laws\n\nForce, mass and acceleration. A net force changes motion.", "week02/energy.md": "# Energy\n\nKinetic energy is the energy of motion. Work done by a force changes kinetic energy.", "syllabus.md": "# Syllabus\n\n- Year: AY2026/2027 Semester 1\n\nThe final exam is in week 13."}.items():
        (tmp_path / "notes" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "notes" / name).write_text(body)
    concepts = spark.createDataFrame([("force", "Force", "x", ["force"]), ("kinetic-energy", "Kinetic energy", "x", ["kinetic energy"]), ("motion", "Motion", "x", ["motion"])], "id string, label string, category string, aliases array<string>")
    b = course.build(spark, str(tmp_path / "notes"), concepts, out=str(tmp_path / "build"))
    c = {r.file_path: r for r in b.chunks.collect()}
    assert len(c) == 3 and {r.module for r in c.values()} == {"week01", "week02", "root"} and c["syllabus.md"].temporal_context.academic_year == "AY2026/2027"
    assert b.nodes.filter("id = 'chapter:root'").head().visibility == "hidden" and b.path.filter("node = 'chapter:root'").count() == 0
    results, decisions = course.ask(b.chunks, asked(spark, "what is kinetic energy", "When is the final exam?"))
    status = {r.qid: r for r in decisions.collect()}
    assert status[0].status == "answerable" and status[1].status == "needs_time_context" and status[1].temporal_year == "AY2026/2027"
    assert results.filter("qid = 0 and rank = 1").head().file_path == "week02/energy.md" and results.filter("qid = 1 and file_path = 'syllabus.md'").count() == 1
    events_ = course.answers(b.chunks, asked(spark, "what is kinetic energy")).orderBy("seq").collect()
    assert events_[0].event == "start" and events_[-1].event == "done" and {e.event for e in events_[1:-1]} == {"delta"}
    recorded = spark.createDataFrame([("syllabus.md", "old"), ("gone.md", "x")], "file string, hash string")
    assert {r.file: r.change for r in course.changed_files(spark, str(tmp_path / "notes"), recorded).collect()} == {"syllabus.md": "edited", "gone.md": "removed", "week01/intro.md": "added", "week02/energy.md": "added"}


def test_session_memory_stream(spark, tmp_path):
    rows = spark.createDataFrame([(1, i, "user", f"t{i}") for i in range(9)], "conv_id long, turn long, role string, text string")
    rows.write.parquet(str(tmp_path / "c"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "c"))
    got = S.drained(S.session_memory(stream), "update").collect()
    assert [r.texts for r in got] == [["t5", "t6", "t7", "t8"]]
