"""Phrases from places: equal to substrings of the texts, without reading them again."""

import random

import pytest

from lyceum.operators import positions, search


def texts_of(spark, rows):
    return spark.createDataFrame(rows, "id int, t string")


def pats_of(spark, pats):
    return spark.createDataFrame([(p,) for p in pats], "pattern string")


def found(places, patterns):
    return {(r.id, r.pattern) for r in positions.occurrences(places, patterns).collect()}


@pytest.mark.parametrize("block", [1024, 4])
def test_places_give_substrings(spark, monkeypatch, block):
    monkeypatch.setattr(positions, "BLOCK", block)
    rng = random.Random(3)
    rows = [(i, "".join(rng.choice("ab c ") for _ in range(60))) for i in range(40)] + [(98, "x" * 5000 + " b"), (99, None), (100, ""), (101, " ")]
    pats = ["a b", "b a b", "ab  c", "c a", "a b c a", "a b a b a b", " a", "b ", " ", "  ", "zz a", "x b", "", None, "a b"]
    places = positions.placed(texts_of(spark, rows), "id", "t", keep=True)
    want = {(i, p) for i, t in rows for p in set(pats) - {"", None} if p in (t or "")}
    assert found(places, pats_of(spark, pats)) == want and len(want) > 60
    assert max(len(r["at"]) for r in places.postings.collect()) <= block
    assert {r.id for r in positions.containing(places, "bc").collect()} == {i for i, t in rows if "bc" in (t or "")}


def test_a_stored_index_answers_the_same(spark, tmp_path):
    rows = [(i, f"the net force of motion {i}" if i % 3 else "magnet forces") for i in range(30)]
    places = positions.placed(texts_of(spark, rows), "id", "t").persist(str(tmp_path))
    pats = ["net force", "force of motion", "of motion 7", "net force of motion 1"]
    assert found(places, pats_of(spark, pats)) == {(i, p) for i, t in rows for p in pats if p in t}


def test_nothing_asked_nothing_there_and_single_pieces(spark):
    some, none = texts_of(spark, [(1, "a b")]), texts_of(spark, [])
    assert found(positions.placed(some, "id", "t"), pats_of(spark, [])) == set()
    assert found(positions.placed(none, "id", "t"), pats_of(spark, ["a b"])) == set()
    with pytest.raises(ValueError):
        positions.occurrences(positions.placed(some, "id", "t"), pats_of(spark, ["a"]))
    with pytest.raises(ValueError):
        positions.containing(positions.placed(some, "id", "t"), "a b")


def test_boosts_read_no_text(spark, tmp_path):
    """Over a stored index the boosts' plan scans no content."""
    rows = [(i, f"force and motion {i}. A comparison" if i % 2 else "net force in motion", "T", f"m/{i}.md", i % 5 == 0) for i in range(40)]
    spark.createDataFrame(rows, "id int, content string, title string, file_path string, time_sensitive boolean").write.parquet(str(tmp_path / "chunks"))
    chunks = spark.read.parquet(str(tmp_path / "chunks"))
    features = search.question_features(spark.createDataFrame([(1, "compare net force"), (2, "when is force and motion due")], "qid int, query string"))
    out = search.boosts(chunks, features, places=search.text_places(chunks))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "content" not in plan and "ReadSchema: struct<id:int,time_sensitive:boolean>" in plan
    got = {(r.qid, r.id): round(r.boost, 6) for r in out.collect()}
    want = {}
    for qid, phrases, compares, logistics in ((1, ["compare net", "net force", "compare net force"], True, False), (2, ["force and motion", "force motion", "motion due", "force and", "and motion"], False, True)):
        asked = features.filter(f"qid = {qid}").head()["phrases"]
        assert set(phrases) & set(asked)
        for i, text, title, path, timed in rows:
            whole = f"{title} {path} {text}".lower().replace("/", " ")
            boost = sum(0.10 * (p in whole) + 0.18 * (p in f"{title} {path}".lower().replace("/", " ")) for p in asked) + 0.14 * (compares and "comparison" in whole) + 0.25 * (logistics and timed)
            if boost:
                want[qid, i] = round(boost, 6)
    assert got == want
