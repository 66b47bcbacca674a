"""Published versions, segment logs, and builds that take in only what has changed."""

import pytest
from pyspark.sql import functions as F

from lyceum.operators import graph, incremental, search, segments
from lyceum.plans import course
from lyceum.sources import versions

TAX = [("force", "Force", "x", ["force"]), ("motion", "Motion", "x", ["motion", "moving body"]), ("wave", "Wave", "y", ["wave", "waves"])]


def taxonomy(spark, rows=TAX):
    return spark.createDataFrame(rows, "id string, label string, category string, aliases array<string>")


def notes(root, n=14):
    for i in range(n):
        at = root / f"w{i % 4}" / f"s{i}"
        at.mkdir(parents=True, exist_ok=True)
        (at / "a.md").write_text(f"# Page {i}\n\nForce and motion number {i}. " + ("Waves move. " * (i % 3)) + "A force changes the motion of a body.")
    return str(root)


def rows_of(df, *columns):
    return sorted((tuple(r) for r in (df.select(*columns) if columns else df).collect()), key=repr)


# ------------------------------------------------------------------ versions


def tables_of(b):
    return [rows_of(getattr(b, name)) for name in course.TABLES]


def test_refused_and_killed_builds_change_nothing(spark, tmp_path, monkeypatch):
    root, out = notes(tmp_path / "notes", 3), str(tmp_path / "out")
    old = course.build(spark, root, taxonomy(spark), out=out)
    before = tables_of(old)
    (tmp_path / "notes/w0/s0/a.md").write_text("# New\n\nForce alone.")

    def unchanged():
        assert tables_of(course.opened(spark, out)) == before == tables_of(old)
        assert len(versions.Store(spark, out).names("data")) == len(course.TABLES)

    real = graph.build
    with monkeypatch.context() as m, pytest.raises(ValueError):
        m.setattr(graph, "build", lambda *a: (lambda n, e, p: (n, e.limit(0), p))(*real(*a)))
        course.build(spark, root, taxonomy(spark), out=out)
    unchanged()
    for place in ("commit", "staged"):  # dead before the last step, and while writing
        with monkeypatch.context() as m, pytest.raises(KeyboardInterrupt):
            m.setattr(versions, place, lambda *a, **b: (_ for _ in ()).throw(KeyboardInterrupt()))
            course.build(spark, root, taxonomy(spark), out=out)
        unchanged()
    new = course.build(spark, root, taxonomy(spark), out=out)
    # A reader of the version before goes on; the new one is current for all tables at once.
    assert tables_of(old) == before and tables_of(course.opened(spark, out, 1)) == before
    assert tables_of(course.opened(spark, out)) == tables_of(new) != before
    with pytest.raises(versions.Conflict):
        versions.commit(versions.Store(spark, out), {}, base=old.version)


def test_versions_expire_unless_pinned(spark, tmp_path):
    store = versions.Store(spark, str(tmp_path))
    made = None
    for i in range(5):
        made = versions.commit(store, {"t": [versions.staged(store, spark.range(i + 1), "t")]}, base=made)
    held = versions.pin(store, versions.opened(store, 2))
    loose = versions.staged(store, spark.range(9), "t")
    assert len(versions.expire(store)) == 2 and len(store.names("data")) == 6  # young folders stay
    gone = versions.expire(store, loose_seconds=0)
    assert loose in gone and [n.split(".")[0].lstrip("0") for n in store.names("manifests")] == ["2", "4", "5"]
    assert [versions.table(store, versions.opened(store, n), "t").count() for n in (2, 4, 5)] == [2, 4, 5]
    versions.release(store, held)
    versions.expire(store, keep=1, loose_seconds=0)
    assert store.names("manifests") == [f"{5:012d}.json"] and len(store.names("data")) == 1 and versions.table(store, versions.current(store), "t").count() == 5


# ------------------------------------------------------------------ segments


def test_a_log_against_a_dictionary(spark, tmp_path):
    """Appends and deaths in any order, with merges, read as a plain dictionary would have them."""
    store = versions.Store(spark, str(tmp_path))
    log = segments.Log(store, "t", "owner", lambda c: c, buckets=4)
    want = {}
    for step in range(6):
        own = {f"o{(step * 7 + k) % 9}": [(step, k, i) for i in range(1 + k)] for k in range(3)}
        dead = {*own, f"o{step % 9}"} if step % 2 else set(own)
        want = {o: v for o, v in want.items() if o not in dead} | own
        rows = spark.createDataFrame([(o, str(x)) for o, v in own.items() for x in v], "owner string, v string")
        log.append(rows, spark.createDataFrame([(o,) for o in dead], "owner string"))
        assert rows_of(log.read(), "owner", "v") == sorted((o, str(x)) for o, v in want.items() for x in v)
    assert len(log.state["segments"]) < 6 and any(s["number"] != i + 1 for i, s in enumerate(log.state["segments"]))
    some = spark.createDataFrame([("o1",), ("none",)], "owner string")
    assert rows_of(log.read(owners=some), "owner", "v") == sorted(("o1", str(x)) for x in want.get("o1", []))
    again = segments.Log(store, "t", "owner", lambda c: c, state=log.state)
    assert rows_of(again.read(), "owner", "v") == rows_of(log.read(), "owner", "v")


# ------------------------------------------------------------------ incremental builds


def contents(state):
    i = state.index()
    kept = {"chunks": ["id", "content", "title"], "mentions": ["module", "section", "id", "concept", "n"], "topic_edges": ["source", "target", "weight", "mention_count", "evidence"]}
    return [rows_of(x) for x in (i.postings, i.lengths, i.stats.select("n", F.round("avgdl", 9)), i.terms.select("term", "df", F.round("idf", 9)))] + [rows_of(state.table(t), *c) for t, c in kept.items()]


def test_an_edited_file_costs_its_share(spark, tmp_path):
    root, out, tax = notes(tmp_path / "notes"), str(tmp_path / "out"), taxonomy(spark)
    first, changed = course.refresh(spark, root, out, tax)
    assert changed.count() == 14 and first.version.number == 1
    (tmp_path / "notes/w1/s5/a.md").write_text("# Other\n\nWaves and a moving body, and nothing else besides.")
    opened = []
    with pytest.MonkeyPatch.context() as m:
        parse = course.files.parse
        m.setattr(course.files, "parse", lambda df: (opened.append(df.inputFiles()), parse(df))[1])
        second, changed = course.refresh(spark, root, out, tax)
    assert rows_of(changed) == [("w1/s5/a.md", "edited")] and [[p.rsplit("notes/")[1] for p in x] for x in opened] == [["w1/s5/a.md"]]
    for name in ("chunks", "lengths", "postings", "mentions", "topic_edges"):
        log, before = second.log(name), {f for f in first.log(name).folders()}
        new = [s for s in log.state["segments"] if s["path"] not in before]
        # What was written before stays and is named again; one segment is new and holds rows of the file or its topic alone.
        assert before <= set(log.folders()) and len(new) == 1 and len(new[0]["buckets"]) == 1, name
        owner = "topic" if name == "topic_edges" else "file_path"
        assert {r[0] for r in log._of(log.paths(None, new)).select(owner).distinct().collect()} == {"w1\x1fs5" if owner == "topic" else "w1/s5/a.md"}
        # Reading one owner opens the files of one bucket.
        one = log.read(owners=spark.createDataFrame([("w1\x1fs5" if owner == "topic" else "w1/s5/a.md",)], f"{owner} string"))
        data = [f for f in one.inputFiles() if "-dead-" not in f]
        assert 0 < len(data) and {f.split("_bucket=")[1].split("/")[0] for f in data} == {str(new[0]["buckets"][0])}
    whole, _ = course.refresh(spark, root, str(tmp_path / "whole"), tax)
    assert contents(second) == contents(whole)
    q = spark.createDataFrame([(1, "force and waves"), (2, "moving body")], "qid int, query string")
    found = [rows_of(search.bm25(s.index(), search.question_terms(q)).withColumn("bm25", F.round("bm25", 9))) for s in (second, whole)]
    assert found[0] == found[1] != []
    # The version before can still be read.
    assert len(contents(first)[4]) == 14


def test_failure_removal_and_another_taxonomy(spark, tmp_path, monkeypatch):
    root, out, tax = notes(tmp_path / "notes", 4), str(tmp_path / "out"), taxonomy(spark)
    first, _ = course.refresh(spark, root, out, tax)
    store = versions.Store(spark, out)
    before = store.names("data")
    (tmp_path / "notes/w2/s2/a.md").unlink()
    (tmp_path / "notes/w9").mkdir()
    (tmp_path / "notes/w9/b.md").write_text("# Added\n\nA wave.")
    with monkeypatch.context() as m, pytest.raises(RuntimeError):
        m.setattr(incremental.graph, "mentions_edges", lambda *a: (_ for _ in ()).throw(RuntimeError()))
        course.refresh(spark, root, out, tax)
    # What was staged is taken back, and the next update finds the same changes.
    assert store.names("data") == before and versions.current(store).number == 1
    state, changed = course.refresh(spark, root, out, tax)
    assert rows_of(changed) == [("w2/s2/a.md", "removed"), ("w9/b.md", "added")]
    # Another taxonomy makes mentions and edges anew and leaves the postings.
    other = taxonomy(spark, TAX[:2] + [("body", "Body", "z", ["body"])])
    state, changed = course.refresh(spark, root, out, other, trust_times=False)
    assert changed.count() == 0 and state.log("postings").folders()[0] == first.log("postings").folders()[0]
    whole, _ = course.refresh(spark, root, str(tmp_path / "whole"), other)
    assert contents(state) == contents(whole)


def test_an_empty_folder(spark, tmp_path):
    (tmp_path / "notes").mkdir()
    (tmp_path / "notes/x.bin").write_text("no")
    state, changed = course.refresh(spark, str(tmp_path / "notes"), str(tmp_path / "out"), taxonomy(spark))
    assert changed.count() == 0 and state.index().postings.count() == 0 and state.index().stats.head().n == 0


def test_a_chunk_is_one_row_of_the_postings(spark, tmp_path):
    """The log of postings moves and keeps a row for each chunk, and nothing that an update held for itself stays."""
    rows = spark.createDataFrame([("m/a.md", "m", "s", 1, "t", "force wave force"), ("m/b.md", "m", "s", 2, "t", ""), ("m/b.md", "m", "s", 3, "t", None)], "file_path string, module string, section string, id long, title string, content string")
    store = versions.Store(spark, str(tmp_path / "out"))
    state = incremental.advance(incremental.opened(store), rows, rows.select("file_path").limit(0), taxonomy(spark))
    log = state.table("postings")
    assert rows_of(log, "id", "len") == [(1, 3), (2, 0), (3, 0)]
    assert rows_of(state.index().postings) == [(1, 3, "force", 2), (1, 3, "wave", 1)] and rows_of(state.index().lengths) == [(1, 3), (2, 0), (3, 0)]
    assert not [x for x in store.names("data") if x.startswith("passing")]
