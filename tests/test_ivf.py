"""The inverted file against the exact search."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lyceum.operators import ivf, search

KIND = "id long, vector array<double>"


def clustered(n=3000, dims=16, groups=30, seed=3):
    r = np.random.default_rng(seed)
    middle = r.normal(size=(groups, dims))
    of = np.where(r.random(n) < 0.34, 0, r.integers(0, groups, n))  # a third of all rows in one group
    return [(int(i), v.tolist()) for i, v in enumerate(middle[of] + 0.35 * r.normal(size=(n, dims)))]


def rows(df):
    return sorted(tuple(r) for r in df.select("qid", "id", "score", "rank").collect())


@pytest.mark.parametrize("sf", ["0.01", "0.1"])
def test_recall_on_the_tables(spark, sf):
    v = spark.read.parquet(f"/root/testdata/sf{sf}/embeddings.parquet").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    asked = v.filter("id % 20 = 0").withColumnRenamed("id", "qid")
    index = ivf.indexed(v)
    assert index.rows.count() == v.count() and len(index.centres) > 10
    found = ivf.search(index, asked, 10, ivf.probes_for(index, v, asked, 10))
    r = ivf.recall(found, search.dense(v, asked, 10)).head()
    assert r.expected == 10 * asked.count() and r.found >= 0.9 * r.expected


def test_all_probes_are_the_exact_search_and_few_find_most(spark, monkeypatch):
    monkeypatch.setattr(ivf, "ROWS", 30)  # a cell has 55 rows on average
    monkeypatch.setattr(ivf, "ASKED", 40)
    v = spark.createDataFrame(clustered(), KIND)
    asked = v.filter("id % 20 = 0").withColumnRenamed("id", "qid")
    index, exact = ivf.indexed(v), search.dense(v, asked, 10)
    cells = len(index.centres)
    assert index.sizes.agg(F.max("pieces")).head()[0] > 1 and index.rows.select("id").distinct().count() == 3000
    assert rows(ivf.search(index, asked, 10, cells)) == rows(exact)
    probes = ivf.probes_for(index, v, asked, 10)
    r = ivf.recall(ivf.search(index, asked, 10, probes), exact).head()
    assert probes < cells / 2 and r.found >= 0.9 * r.expected
    assert ivf.recall(ivf.search(index, asked, 10, 1), exact).head().found < r.found
    small = ivf.indexed(v, sample=400)  # the sample is bounded, the index is not
    assert 1 <= len(small.centres) <= 400 // ivf.PER_CELL and small.rows.count() == 3000


def test_awkward_rows(spark):
    odd = [(9000, None), (9001, [float("nan")] * 16), (9002, [0.0] * 16), (9003, [1.0, 2.0]), (9004, [2.0, 1.0]), (9005, []), (5, [1.0] * 16), (5, [1.0] * 16), (None, [1.0] * 16)]
    v = spark.createDataFrame(clustered(400) + odd, KIND).withColumn("cell", F.lit("x"))
    asked = spark.createDataFrame([(1, [1.0, 1.0]), (2, None), (3, [1.0] * 16), (4, [0.0] * 16), (5, [1.0] * 3), (3, [1.0] * 16)], "qid long, vector array<double>").withColumn("lot", F.lit(1))
    index = ivf.indexed(v)
    assert index.rows.count() == 400 + len(odd) - 3
    assert rows(ivf.search(index, asked, 4, len(index.centres)).na.fill(-1)) == rows(search.dense(v, asked, 4).na.fill(-1))
    assert ivf.search(index, asked.limit(0), 4, 3).count() == 0
    none = ivf.indexed(v.limit(0))
    assert none.rows.count() == 0 and ivf.search(none, asked, 4, ivf.probes_for(none, v.limit(0), asked, 4)).count() == 0
