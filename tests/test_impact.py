"""The best chunks by blocks of impacts against scores of everything."""

import random

import pytest
from pyspark.sql import functions as F

from lyceum.operators import impact, search


def corpus(spark, n=400, seed=3):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(200)]
    rows = []
    for i in range(n):
        body = ["the"] * rng.randrange(0, 6) + rng.choices(words, [1 / (k + 1) for k in range(200)], k=rng.randrange(1, 60))
        rows.append((i, " ".join(body)))
    rows += [(1000 + i, "w150 w151 the") for i in range(9)] + [(2000, ""), (2001, None)]  # ties
    return spark.createDataFrame(rows, "id long, content string")


QUESTIONS = [(1, "w150 w151 the"), (2, "w3 w90 w199 the w3"), (3, "unknown words"), (4, "w1 w2 w5"), (5, "w0"), (6, ""), (7, " ".join(f"w{i}" for i in range(0, 200, 5)))]


def rows_of(df):
    return sorted((r.qid, r["rank"], r.id, round(r.score, 6)) for r in df.collect())


@pytest.mark.parametrize("block", [4, 128])
def test_as_scoring_everything(spark, monkeypatch, block):
    monkeypatch.setattr(impact, "BLOCK", block)
    index = search.lexical_index(corpus(spark), keep=True)
    q = search.question_terms(spark.createDataFrame(QUESTIONS, "qid int, query string"))
    plain = search.topk(search.bm25(index, q).withColumnRenamed("bm25", "score"), 5)
    assert rows_of(impact.best(impact.blocked(index), q, 5)) == rows_of(plain) != []


def test_blocks_and_terms_are_skipped(spark, monkeypatch):
    """A rare term decides: the common term makes no candidate, and most postings aren't touched."""
    monkeypatch.setattr(impact, "BLOCK", 8)
    index = search.lexical_index(corpus(spark, 800), keep=True)
    blocks = impact.blocked(index)
    q = search.question_terms(spark.createDataFrame([(1, "w150 w151 w0"), (2, "w0")], "qid int, query string"))
    planned = impact.plan(blocks, q, 5)
    assert {r.term: r.makes for r in planned.filter("qid = 1").collect()}["w0"] is False
    touched = impact.used(blocks, planned).filter("qid = 1").agg(F.sum(F.size("entries"))).head()[0]
    asked = index.postings.filter("term in ('w150', 'w151', 'w0')").count()
    assert 0 < touched < asked / 3
    # Where one term decides, its blocks that add too little are skipped.
    own = impact.used(blocks, planned).filter("qid = 2").count()
    assert 0 < own < blocks.blocks.filter("term = 'w0'").count() / 2


def test_nothing(spark):
    index = search.lexical_index(corpus(spark).limit(0), keep=True)
    q = search.question_terms(spark.createDataFrame(QUESTIONS, "qid int, query string"))
    assert impact.best(impact.blocked(index), q).count() == 0
    full = search.lexical_index(corpus(spark, 5), keep=True)
    assert impact.best(impact.blocked(full), q.limit(0)).count() == 0


def test_an_index_of_asked_terms(spark):
    """It has no posting of another term, and the weights of the index of all terms."""
    c = spark.createDataFrame([(1, "force wave force"), (2, "wave mass"), (3, ""), (4, None)], "id long, content string")
    q = spark.createDataFrame([(1, "wave", 1), (2, "wave", 2), (2, "absent", 1)], "qid long, term string, qtf long")
    full, own = search.lexical_index(c), search.lexical_index(c, asked=q)
    every = lambda df: sorted(tuple(r) for r in df.collect())
    assert every(own.postings) == every(full.postings.filter("term = 'wave'")) != []
    assert every(own.terms) == every(full.terms.filter("term = 'wave'")) and every(own.stats) == every(full.stats)
    assert rows_of(impact.best(impact.blocked(own), q, 5)) == rows_of(impact.best(impact.blocked(full), q, 5)) != []
