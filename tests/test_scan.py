"""Scores by passes over the chunks equal those by joins with postings."""

import random

import numpy as np
from pyspark.sql import functions as F

from lyceum.operators import counts, norms, scan, search


def course(spark, n=60):
    r = random.Random(5)
    words = ["force", "mass", "the", "of", "energy", "comparison", "é1", "x_y", "a.b", "3.14", "week"] + [f"w{i}" for i in range(40)]
    rows = [(i, " ".join(r.choices(words, k=r.randint(0, 40))), r.choice(words), r.choice(["figures", "en"]), f"en/{i}.md", r.random() < 0.1) for i in range(n)]
    rows += [(n + i, rows[7][1], *rows[7][2:]) for i in range(5)] + [(n + 5, None, None, None, None, None), (n + 6, "", "", "en", "b.md", False)]
    return spark.createDataFrame(rows, "id long, content string, title string, module string, file_path string, time_sensitive boolean")


def asked(spark):
    rows = [(1, "when is force mass of energy"), (2, "compare w1 w2 w3"), (3, "figure w4 é1 x_y"), (4, "unknown"), (5, None), (6, rows_like())]
    return spark.createDataFrame(rows, "qid long, query string")


def rows_like():
    return " ".join(f"w{i} mass" for i in range(40))


def same(a, b, *cols):
    of = lambda df: sorted(tuple(r) for r in df.select(*[F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in df.select(*cols).dtypes]).collect())
    got = of(a)
    assert got == of(b)
    return got


def test_bm25(spark):
    c, q = course(spark), asked(spark)
    plain = search.topk(search.bm25(search.lexical_index(c), search.question_terms(q)).withColumnRenamed("bm25", "score"), 5)
    assert same(scan.bm25_best(c, q, 5), plain, "qid", "id", "score", "rank")


def test_tfidf(spark):
    c, q = course(spark), asked(spark)
    plain = search.topk(search.tfidf(search.tfidf_index(c), q).withColumnRenamed("meaning", "score"), 5)
    assert same(scan.tfidf_best(c, q, 5), plain, "qid", "id", "score", "rank")


def test_minmax(spark):
    c, q = course(spark), asked(spark)
    plain = search.minmax(search.bm25(search.lexical_index(c), search.question_terms(q)), "bm25", c.agg(F.count("*").alias("n")), "scaled")
    assert same(scan.bm25_scaled(c, q), plain, "qid", "id", "scaled")


def test_fusion(spark):
    c, q = course(spark), asked(spark)
    stored = search.hybrid(c, q, index=search.lexical_index(c), vectors=search.tfidf_index(c))
    assert same(search.hybrid(c, q), stored, *stored.columns)


def test_blocks_of_questions_and_nothing_to_find(spark, monkeypatch):
    c, q = course(spark), asked(spark)
    whole = scan.bm25_best(c, q, 3)
    monkeypatch.setattr(scan, "ASKED", 2)
    monkeypatch.setattr(scan, "PRODUCTS", 10)
    monkeypatch.setattr(counts, "SLICE", 7)
    same(scan.bm25_best(c, q, 3), whole, "qid", "id", "score", "rank")
    assert scan.bm25_best(c, q.limit(0), 3).count() == 0
    assert scan.bm25_best(c.limit(0), q, 3).count() == 0
    assert search.hybrid(c.limit(0), q).count() == 0


def test_text_ids(spark):
    c, q = course(spark), asked(spark)
    names = c.withColumn("id", F.concat(F.lit("c"), F.lpad(F.col("id").cast("string"), 3, "0")))
    got = scan.bm25_best(names, q, 4).withColumn("id", F.substring("id", 2, 3).cast("long"))
    same(got, scan.bm25_best(c, q, 4), "qid", "id", "score", "rank")


def test_counting_moves_no_row(spark):
    rows = course(spark).select("id", F.split("content", " ").alias("words"))
    assert "Exchange" not in counts.postings(rows)._jdf.queryExecution().executedPlan().toString()
    plain = rows.select("id", F.size("words").alias("len"), F.explode("words").alias("term")).groupBy("id", "len", "term").agg(F.count("*").alias("tf"))
    same(counts.postings(rows), plain, "id", "len", "term", "tf")


def test_phrase_boost_stores_no_index_of_places(spark, monkeypatch):
    from lyceum.queries import search as queries

    monkeypatch.setattr(queries, "chunks", lambda *_: course(spark))
    monkeypatch.setattr(queries, "questions", lambda *_: asked(spark))
    monkeypatch.setattr(search, "text_places", None)
    features = search.question_features(asked(spark)).withColumn("logistics", F.lit(False)).withColumn("compares", F.lit(False))
    assert same(queries.phrase_boost(spark, ""), search.boosts(course(spark), features).filter("boost > 0"), "qid", "id", "boost")


def test_sums_of_nothing_take_boosts():
    none = np.array([], dtype=np.int64)
    sums = scan.Weights(np.zeros(1, dtype=np.int64), none, np.array([])).times(none, none, np.array([]), 2, 3)
    sums += 0.25
    assert sums.tolist() == [[0.25] * 3] * 2


def test_norms_move_no_row_for_each_chunk_and_term(spark, monkeypatch):
    """What is moved for the norms is packed by slices and ranges of terms; ids of any type, repeated or null, count as rows."""
    monkeypatch.setattr(norms, "SLICE", 50)
    monkeypatch.setattr(norms, "ROWS", 7)
    monkeypatch.setattr(norms, "RANGE", 400)
    c = course(spark).select(F.when(F.col("id") != 3, F.concat(F.lit("c"), F.col("id") % 50)).alias("id"), "content")
    n, size = scan.measured(c)
    rows = scan.meaning_rows(c)
    plain = search.tfidf_index(c).norms
    assert same(norms.norms(rows, n, size).fillna("none"), plain.fillna("none"), "id", "norm")
    parts = norms.packed(rows, 5)
    assert 0 < parts.count() < counts.word_and_pair_counts(rows).count() / 10
    assert "Window" not in norms.norms(rows, n, size)._jdf.queryExecution().executedPlan().toString()
    assert norms.norms(rows.limit(0), 0, 0).count() == 0


def test_numbers_of_terms_come_back():
    x = np.sort(np.array([0, 1, 1 << 40, (1 << 64) - 1, 1 << 63, (1 << 63) + 5], dtype=np.uint64))
    assert (norms.unstepped(norms.steps(x)) == x).all()
    assert len(norms.unstepped(norms.steps(x[:0]))) == 0


def test_rows_of_terms_come_back():
    row, sizes = np.array([3, 9, 65_535, 0, 1, 65_535, 7], dtype=np.uint16), np.array([3, 3, 1], dtype=np.uint32)
    gap = norms.unsqueezed(norms.squeezed(norms.gaps(row, np.array([0, 3, 6]))), np.uint16)
    assert (norms.ungapped(gap, sizes) == row).all()


def test_a_task_gives_back_one_sum_a_chunk(spark, monkeypatch):
    """What comes back from the ranges grows with chunks and tasks, not with chunks times ranges."""
    monkeypatch.setattr(norms, "RANGE", 40)
    c = course(spark)
    n, size = scan.measured(c)
    ranges = -(-size // norms.RANGE)
    tasks = norms.TASKS * spark.sparkContext.defaultParallelism
    assert ranges > 10 * tasks
    added, seen = norms.added, spark.sparkContext.accumulator(0)

    def counted(batches, ids):
        for b in added(batches, ids):
            seen.add(sum(len(x) // 8 for x in b.column("sums").to_pylist()))
            yield b

    monkeypatch.setattr(norms, "added", counted)
    got = norms.norms(scan.meaning_rows(c), n, size)
    assert same(got, search.tfidf_index(c).norms, "id", "norm")
    assert 0 < seen.value <= 2 * n * tasks  # the plan is run twice at most
    for held in (0, 5):
        monkeypatch.setattr(norms, "HELD", held)
        assert same(norms.norms(scan.meaning_rows(c), n, size), search.tfidf_index(c).norms, "id", "norm")


def test_pairs_of_frequent_words_move_few_bytes(spark):
    r = random.Random(3)
    texts = [[f"w{min(int(r.expovariate(0.02)), 2000)}" for _ in range(400)] + [f"x{i}"] for i in range(200)]
    rows = spark.createDataFrame(list(enumerate(texts)), "id long, words array<string>").coalesce(1)
    book = norms.book_of(rows, 1)
    assert "w0" in book and "x7" not in book
    moved = lambda df: sum(len(r[c]) for r in df.collect() for c in (*norms.NUMBERED, "sizes", "rows", "tfs"))
    assert moved(norms.packed(rows, 3, book)) < moved(norms.packed(rows, 3)) / 2


def test_any_book_gives_the_same_norms(spark, monkeypatch):
    c = course(spark)
    n, size = scan.measured(c)
    rows = scan.meaning_rows(c)
    plain = search.tfidf_index(c).norms
    for book in ([], ["mass", "w3"], [f"w{i}" for i in range(40)] + ["the", "of", "é1", "nowhere"]):
        monkeypatch.setattr(norms, "book_of", lambda *_, book=book: book)
        assert same(norms.norms(rows, n, size), plain, "id", "norm")
    first, second = np.array([0, 0, 1, norms.BOOK - 1, norms.BOOK - 1]), np.array([0, 300, 0, 0, norms.BOOK - 1])
    every = norms.places(first, second)
    assert len(np.unique(every)) == len(every) and every.max() < 1 << 32
    assert len(np.unique(norms.places(np.full(norms.BOOK, 5), np.arange(norms.BOOK)))) == norms.BOOK


def test_kept_rows_are_packed(spark):
    row, code, tf = np.array([1, 1, 1, 3, 3]), np.array([0, 127, 70_000, 5, 6]), np.array([1, 128, 20_000, 1, 1 << 31])
    codes, tfs = scan.packed(row, scan.steps(row, code), 5), scan.packed(row, tf, 5)
    for low, n in ((0, 5), (1, 3), (3, 2), (4, 1), (5, 0)):
        own = (row >= low) & (row < low + n)
        for got, want in ((scan.numbers(codes.slice(low, n)), code), (scan.unpacked(tfs.slice(low, n)), tf)):
            assert got[0].tolist() == (row[own] - low).tolist() and got[1].tolist() == want[own].tolist()
    c, q = course(spark), asked(spark)
    terms = scan.Terms.of(search.question_terms(q).withColumnRenamed("qid", "_n"))
    kept = scan.kept_terms(scan.lexical_rows(c, None), terms, pairs=False)
    assert sum(len(r.codes) + len(r.tfs) for r in kept.collect()) <= 2 * counts.postings(scan.lexical_rows(c, None)).count()


def test_a_stored_table_leaves_no_shuffle(spark):
    from lyceum.operators import sizes

    jvm = spark.sparkContext._jvm
    shuffled = lambda: {f.getName() for f in jvm.scala.jdk.javaapi.CollectionConverters.asJava(jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()) if f.getName().startswith("shuffle_")}
    before = shuffled()
    df = sizes.stored(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count())
    assert not shuffled() - before
    assert df.count() == 7 and spark.conf.get(sizes.CLEANED) == "false"
