"""Queries against statements of their whole job where the registered SQL states a part of it."""

import pytest

from lyceum.operators import events, search
from lyceum.queries import QUERIES
from tests.compare import differences

SF = "/root/testdata/sf0.001"


def test_every_twentieth_vector_asks(spark):
    sql = """WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings), n AS (SELECT vec_id, e, sqrt(list_dot_product(e, e)) AS m FROM v),
s AS (SELECT q.vec_id AS qid, n.vec_id AS id, round(list_dot_product(n.e, q.e) / CASE WHEN n.m > 0 THEN n.m ELSE 1 END / CASE WHEN q.m > 0 THEN q.m ELSE 1 END, 6) AS score FROM n, n q WHERE q.vec_id % 20 = 0)
SELECT qid, id, score, CAST(row_number() OVER (PARTITION BY qid ORDER BY score DESC, id DESC) AS INTEGER) AS rank FROM s QUALIFY rank <= 10"""
    assert differences(QUERIES["vector_topk"](spark, SF), SF, sql) is None


def test_themes_of_all_parts(spark):
    sql = "SELECT p_brand AS theme, count(DISTINCT l_orderkey) AS papers FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY p_brand"
    assert differences(QUERIES["themes"](spark, SF), SF, sql) is None


ROSTER = """usage AS (SELECT CASE WHEN user_id % 13 = 0 THEN 'address:' || CAST(user_id AS VARCHAR) ELSE 'u' || CAST(user_id AS VARCHAR) || '@example.org' END AS email, count(*) AS questions FROM events GROUP BY ALL),
roster AS (SELECT 'u' || CAST(c_custkey AS VARCHAR) || '@example.org' AS email, c_name AS name FROM customer)"""


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_all_customers_are_students(spark, sf):
    at = f"/root/testdata/{sf}"
    sql = f"WITH {ROSTER} SELECT r.email, name, CAST(coalesce(sum(questions), 0) AS BIGINT) AS questions FROM roster r LEFT JOIN usage u ON u.email = r.email GROUP BY ALL"
    assert differences(QUERIES["students_report"](spark, at), at, sql) is None
    sql = f"WITH {ROSTER} SELECT email, CAST(sum(questions) AS BIGINT) AS questions FROM usage WHERE email NOT LIKE 'address:%' AND email NOT IN (SELECT email FROM roster) GROUP BY email"
    assert differences(QUERIES["unknown_users"](spark, at), at, sql) is None


def test_an_unlisted_user_is_unknown(spark):
    roster = spark.createDataFrame([("u1@example.org", "One")], "email string, name string")
    usage = spark.createDataFrame([("u1@example.org", 2), ("u9@example.org", 1), ("u9@example.org", 3), ("address:4", 5)], "email string, questions int")
    assert [tuple(r) for r in events.unknown_users(roster, usage).select("email", "questions").collect()] == [("u9@example.org", 4)]


def test_dense_on_awkward_vectors(spark, monkeypatch):
    """Ties go to the greater id, blocks don't matter, and vectors without a score are left out."""
    monkeypatch.setattr(search, "ASKED", 2)
    rows = [(i, [1.0, 0.0]) for i in range(6)] + [(6, [0.0, 0.0]), (7, None), (8, [1.0, None]), (9, [1.0]), (10, [-2.0, 0.0]), (11, [float("nan"), 1.0])]
    vectors = spark.createDataFrame(rows, "id long, vector array<double>").repartition(3)
    asked = vectors.filter("id in (1, 2, 6, 7, 9)").withColumnRenamed("id", "qid")
    out = {}
    for r in sorted(search.dense(vectors, asked, 3).collect(), key=lambda r: r.rank):
        out.setdefault(r.qid, []).append((r.id, r.score))
    assert out == {1: [(5, 1.0), (4, 1.0), (3, 1.0)], 2: [(5, 1.0), (4, 1.0), (3, 1.0)], 6: [(10, 0.0), (6, 0.0), (5, 0.0)], 9: [(9, 1.0)]}
    assert search.dense(vectors.limit(0), asked, 3).count() == 0 and search.dense(vectors, asked.limit(0), 3).count() == 0
