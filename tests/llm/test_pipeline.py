"""Every stage of the pipeline on its own input, against the brute-force versions, and on awkward rows."""

import itertools

import numpy as np
import pytest

import corpus_pipeline
from tests.llm.fixtures import DOCS, PASSAGE, SF, documents, sentence
from tests.llm.test_others import slow_fingerprint
from tests.llm.test_similar import alike, slow_set
from tests.llm.test_suffixdedup import brute

COLUMNS = corpus_pipeline.COLUMNS


def five_word_fingerprint(text):
    return slow_fingerprint((text or "").encode(), 5)


def near_copies_are_out(before, after):
    """Of two near copies (five words, 0.8, or fingerprints within two bits) one stays at most; what goes leads to a lesser id that stays."""
    sets = {i: slow_set(t) for i, t in before}
    fps = {i: five_word_fingerprint(t) for i, t in before}
    linked = {i: set() for i in sets}
    for a, b in itertools.combinations(sorted(sets), 2):
        if alike(sets[a], sets[b]) or (fps[a] ^ fps[b]).bit_count() <= 2:
            linked[a].add(b)
            linked[b].add(a)
    assert not [(a, b) for a, b in itertools.combinations(sorted(after), 2) if b in linked[a]]
    for i in set(sets) - set(after):
        seen, todo = {i}, [i]
        while todo:
            for j in linked[todo.pop()] - seen:
                seen.add(j)
                todo.append(j)
        assert min(seen) < i and min(seen) in after


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select(*COLUMNS)
    labels = {r.doc_id: r for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        before = {r.doc_id: r for r in docs.collect()}
        stage(spark, docs, SF).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        after = {r.doc_id: r for r in docs.collect()}
        assert len(after) == docs.count() and set(after) <= set(before)
        if name != "packing":
            assert docs.columns == COLUMNS
        if name in ("toxicity", "quality"):
            assert all(after[i] == before[i] for i in after)
            clean = {i for i in before if i in labels and labels[i].quality == 1 and labels[i].toxic == 0}
            assert len(clean - set(after)) <= 0.1 * len(clean)
        if name == "near_copies":
            near_copies_are_out([(i, r.text) for i, r in before.items()], after)
            assert all(after[i] == before[i] for i in after)
        if name == "repeats":
            want = {i: removed for i, _, removed, _, _ in brute([(i, r.text) for i, r in before.items()])}
            assert set(after) == set(before)
            for i, r in after.items():
                # Bytes of characters that a cut splits go as well: at most three at each end of a run.
                assert r.n_chars == len(r.text) and len(before[i].text.encode()) - want[i] - len(r.text.encode()) in range(0, 200)
                assert want[i] or r.text == before[i].text
        if name == "packing":
            assert set(after) == set(before)
        kept[name] = len(after)
    assert kept["packing"] == kept["repeats"] > 0 and kept["toxicity"] < 200


def test_run_is_the_stages(spark):
    rows = corpus_pipeline.run(spark, SF)
    assert rows.count() > 0 and {"doc_id", "bucket", "batch_id", "place"} <= set(rows.columns)


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES)
def test_awkward_rows(spark, name, stage):
    """Nulls in any column, empty and long texts, repeated rows, other columns of clashing names."""
    rows = [(*r, "x", 1, 2) for r in documents()] + [(40, sentence(40, 50), None, None, None, None, None, None), (41, PASSAGE * 3, "en", "s", 5, "y", 3, 4)]
    odd = spark.createDataFrame(rows, DOCS + ", _id string, h long, score long")
    out = stage(spark, odd, SF).collect()
    ids = [r.doc_id for r in out]
    assert set(ids) <= {r[0] for r in rows} and 41 in ids
    if name in ("repeats", "packing"):
        assert sorted(ids, key=str) == sorted((r[0] for r in rows), key=str)
    if name == "near_copies":
        # Texts without words are one group, of which the least id stays; one id may have several texts.
        assert {2, 3, 12} & set(ids) == {2} and ids.count(9) == 1 and None in ids and len(out) == len(rows) - 4
    if name != "packing":
        assert list(out[0].__fields__) == COLUMNS


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES)
def test_empty_table(spark, name, stage):
    assert stage(spark, spark.createDataFrame([], DOCS), SF).collect() == []


def test_the_fit_leaves_the_scan_its_tasks(spark, tmp_path, monkeypatch):
    """Operator 5's sample is joined where the texts are scanned, in as many tasks as the scan has."""
    from pyspark import TaskContext

    from lyceum.llm import toxicity

    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    docs.repartition(9).write.parquet(str(tmp_path / "docs"))
    real, seen = toxicity.counted_features, str(tmp_path / "seen")

    def noted(batches, real=real, seen=seen):
        import os

        os.makedirs(seen, exist_ok=True)
        open(f"{seen}/{TaskContext.get().partitionId()}", "w").close()
        yield from real(batches)

    monkeypatch.setattr(toxicity, "counted_features", noted)
    spark.conf.set("spark.sql.files.openCostInBytes", str(1 << 30))
    try:
        model = toxicity.fit(spark.read.parquet(str(tmp_path / "docs")), spark.read.parquet(f"{SF}/labels.parquet"))
    finally:
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert model.weight is not None and len(list((tmp_path / "seen").iterdir())) == 9


def test_the_fit_goes_downhill():
    """The ordinal likelihood's optimum has no numerical slope: no weight or threshold moved a little does better."""
    from lyceum.llm import toxicity

    rng = np.random.default_rng(5)
    n, k = 60, 4
    rows, cols = np.repeat(np.arange(n), 2), rng.integers(0, k, 2 * n)
    vals, grade, weight = rng.random(2 * n), rng.integers(0, 3, n), rng.random(n) + 0.5
    w, theta = toxicity.ordinal_fit(rows, cols, vals, grade, weight, k, rounds=4000, n_grades=3)

    def loss(w, theta):
        x = np.zeros((n, k))
        np.add.at(x, (rows, cols), vals)
        above = 1 / (1 + np.exp(-((x @ w)[:, None] - theta[None, :])))
        p = np.concatenate([np.ones((n, 1)), above, np.zeros((n, 1))], axis=1)
        return -(weight / weight.sum() * np.log(p[np.arange(n), grade] - p[np.arange(n), grade + 1])).sum() + toxicity.L2 / 2 * (w * w).sum()

    for e in np.eye(k + 2) * 1e-3:
        for sign in (1, -1):
            assert loss(w + sign * e[:k], theta + sign * e[k:]) >= loss(w, theta) - 1e-7
