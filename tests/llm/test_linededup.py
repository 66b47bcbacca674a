"""Operator 13 against a plain loop, and its runs over time."""

import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from lyceum.llm import linededup, queries
from tests.compare import differences
from tests.llm.fixtures import SF

DOCS = "doc_id long, text string, key string, hashes int, _id int, n_lines int"
SPACE = " \t\n\x0b\x0c\r"


def by_loops(rows, least, min_chars=1):
    """Sorted (doc_id, lines, dropped, text left) of rows (doc_id, text)."""
    low = lambda s: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s.strip(SPACE))
    lines = [(t or "").split("\n") for _, t in rows]
    docs = {}
    for of in lines:
        for k in {low(x) for x in of}:
            docs[k] = docs.get(k, 0) + 1
    gone = {k for k, n in docs.items() if n >= least and len(k) >= min_chars}
    return sorted(((i, len(of), sum(low(x) in gone for x in of), "\n".join(x for x in of if low(x) not in gone)) for (i, _), of in zip(rows, lines)), key=repr)


def awkward(seed=3):
    rng = random.Random(seed)
    pool = ["Menu", "menu ", "\tMENU\r", "É menu", "é menu", "", " ", "\x0b\x0c", " menu", "x", "X", "İ", "i̇", "end.", "a b", "a  b"]
    rows = [(i, "\n".join(rng.choice(pool) for _ in range(rng.choice([1, 2, 5, 30])))) for i in range(60)]
    rows += [(5, rows[5][1]), (5, rows[5][1]), (None, "menu\nown"), (None, None), (70, None), (71, ""), (72, "\n"), (73, "\n\nmenu\n"), (74, "long " * 9000 + "\nmenu"), (75, "a\r\nb\rc")]
    rows += [(80 + i, "the same\ntext") for i in range(25)]
    return rows


@pytest.mark.parametrize(("least", "min_chars", "batches"), [(10, 1, 4), (2, 3, 7), (1, 1, 1)])
def test_as_by_loops(spark, least, min_chars, batches):
    df = spark.createDataFrame([(*r, "k", 1, 2, 3) for r in awkward()], DOCS).repartition(3)
    got, done = linededup.cut(df, least=least, min_chars=min_chars, batches=batches)
    assert got.columns == ["doc_id", "key", "hashes", "_id", "text", "n_lines", "n_dropped"]
    assert sorted(((r.doc_id, r.n_lines, r.n_dropped, r.text) for r in got.collect()), key=repr) == by_loops(awkward(), least, min_chars)
    assert got.filter("key <> 'k' or hashes <> 1 or _id <> 2").count() == 0
    done()
    assert not [t.name for t in spark.catalog.listTables() if t.name.startswith("line_run_")]


def test_empty_table(spark):
    assert linededup.cut(spark.createDataFrame([], DOCS))[0].count() == 0


def batch(spark, *texts):
    return linededup.hashed(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string"))


def test_runs_merge_geometrically(spark, tmp_path):
    at = str(tmp_path / "runs")
    shapes = []
    for b in range(7):
        runs = linededup.Runs(spark, at, 3)  # each batch by a new job
        runs.add(b, batch(spark, "always", f"once {b}", "twice\ntwice" if b < 2 else "other"))
        shapes.append([r[:2] for r in runs.live()])
        runs.close()
    assert shapes == [[(0, 0)], [(0, 1)], [(0, 1), (2, 2)], [(0, 3)], [(0, 3), (4, 4)], [(0, 3), (4, 5)], [(0, 3), (4, 5), (6, 6)]]
    assert sorted(p.name.rsplit("-", 1)[0] for p in Path(at).iterdir()) == ["0-3", "4-5", "6-6"]
    runs = linededup.Runs(spark, at, 3)
    of = {h: k for k in ("always", "twice", "other") for (h,) in spark.range(1).select(F.md5(F.lit(k))).collect()}
    assert {of[r.key] for r in runs.frequent().collect()} == {"always", "other"}
    # Known as frequent since the run 0-3, so later runs don't hold it again.
    assert all(of.get(r.key) != "always" for *_, path in runs.live()[1:] for r in runs.read(path).collect())
    runs.add(3, batch(spark, "always"))  # there already
    with pytest.raises(ValueError):
        runs.add(9, batch(spark, "x"))
    runs.close()


def test_a_job_that_dies_leaves_a_right_state(spark, tmp_path, monkeypatch):
    """Dead between the merged run and the removal of its parts, and dead while writing."""
    at = str(tmp_path / "runs")
    runs = linededup.Runs(spark, at, 2)
    runs.add(0, batch(spark, "a", "b"))
    with monkeypatch.context() as m:
        real = linededup.remove
        m.setattr(linededup, "remove", lambda s, p: 1 / 0 if p.endswith(f"0-0-{runs.buckets}") else real(s, p))
        with pytest.raises(ZeroDivisionError):
            runs.add(1, batch(spark, "a", "c"))
    assert [r[:2] for r in runs.live()] == [(0, 1)] and len(runs._listed()) == 3
    broken = Path(at) / f"2-2-{runs.buckets}"
    broken.mkdir()
    (broken / "part-0.parquet").write_bytes(b"half")
    again = linededup.Runs(spark, at, 2)
    again.add(1, batch(spark, "a", "c"))
    again.add(2, batch(spark, "c"))
    assert again.frequent().count() == 2
    again.close()


def test_merging_runs_shuffles_nothing(spark, tmp_path):
    runs = linededup.Runs(spark, str(tmp_path / "runs"), 2)
    runs.add(0, batch(spark, *[f"line {i}" for i in range(50)]))
    a = runs.read(runs.live()[0][3])
    b = runs.read(runs.live()[0][3]).withColumnRenamed("docs", "n")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = a.join(b, "key", "full_outer")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "SortMergeJoin" in plan and "Exchange" not in plan
    runs.close()


def test_query_as_sql_and_native(spark):
    df = queries.op13_line_dedup(spark, SF)
    assert differences(df, SF, queries.OP13_SQL) is None
    left, _ = linededup.cut(spark.read.parquet(f"{SF}/documents.parquet"))
    plan = left._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
