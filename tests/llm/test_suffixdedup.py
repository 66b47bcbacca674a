import hashlib

import numpy as np
import pytest

from lyceum.llm import suffixdedup
from tests.llm.fixtures import SF, documents, frame


def brute(rows, width=50):
    """Result rows by a dictionary of every window's least id."""
    low = -(2**63)
    first = {}
    data = [(low if i is None else i, (t or "").encode()) for i, t in rows]
    for i, b in data:
        for p in range(len(b) - width + 1):
            w = b[p : p + width]
            if first.get(w, i) >= i:
                first[w] = i
    out = []
    for i, b in data:
        gone = np.zeros(len(b) + 1, dtype=bool)
        for p in range(len(b) - width + 1):
            if first[b[p : p + width]] < i:
                gone[p : p + width] = True
        gone[len(b)] = False
        kept = bytes(np.frombuffer(b, dtype=np.uint8)[~gone[: len(b)]])
        runs = int(np.count_nonzero(gone[1:] < gone[:-1]))
        out.append((None if i == low else i, len(b), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def result(df):
    return sorted((tuple(r) for r in suffixdedup.cut(df, full=False).collect()), key=str)


def test_fixture(spark):
    assert result(frame(spark)) == brute([r[:2] for r in documents()])


@pytest.mark.parametrize("batch", [1 << 18, 500])
def test_table(spark, batch, monkeypatch):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    monkeypatch.setattr(suffixdedup, "BATCH", batch)
    assert result(spark.read.parquet(f"{SF}/documents.parquet")) == brute(rows)


@pytest.mark.parametrize("size", [50, 400, 10**6])
def test_levels_agree_in_any_order(size, monkeypatch):
    """The family marks what a dictionary of least documents marks, whatever the batches."""
    monkeypatch.setattr(suffixdedup, "BATCH", size)
    rng = np.random.default_rng(size)
    n = 3000
    c = rng.integers(0, 400, n).astype(np.uint64) << np.uint64(24)
    doc = rng.integers(0, 60, n)
    whole = suffixdedup.Records(c=c, x=np.zeros(n, dtype=np.uint32), doc=doc, uid=np.arange(n).astype(np.uint64), start=np.zeros(n, dtype=np.uint32), length=np.zeros(n, dtype=np.uint8))
    family, found = suffixdedup.LevelFamily(), []
    for at in np.array_split(rng.permutation(n), max(1, n // size)):
        found += [u for r in family.add(suffixdedup.Records.array([whole.take(at)])) for u in r[0].tolist()]
    least = {}
    for k, d in zip(c.tolist(), doc.tolist()):
        least[k] = min(d, least.get(k, d))
    assert sorted(found) == [i for i in range(n) if doc[i] > least[int(c[i])]]
    sizes = [len(x) for x in family.levels if x is not None]
    assert sum(sizes) == n - len(found)


def records(c, x, doc):
    n = len(doc)
    return suffixdedup.Records(c=np.array(c, dtype=np.uint64), x=np.array(x, dtype=np.uint32), doc=np.array(doc), uid=np.arange(n).astype(np.uint64), start=np.zeros(n, dtype=np.uint32), length=np.zeros(n, dtype=np.uint8))


def test_a_lesser_document_evicts_its_own_span_only():
    whole = records([7, 7, 7], [1, 2, 1], [10, 3, 5])
    family = suffixdedup.LevelFamily()
    assert family.add(suffixdedup.Records.array([whole.take(np.array([0, 1]))])) == []
    assert [u for r in family.add(whole.take(np.array([2]))) for u in r[0].tolist()] == [0]


@pytest.mark.parametrize("size", [7, 50, 400, 10**6])
def test_levels_tell_spans_of_equal_c_apart(size, monkeypatch):
    """Several x under one c, whatever the batches: marks and what stays are those of a dictionary."""
    monkeypatch.setattr(suffixdedup, "BATCH", size)
    rng = np.random.default_rng(size)
    n = 3000
    whole = records(rng.integers(0, 40, n), rng.integers(0, 12, n), rng.integers(0, 60, n))
    family, found = suffixdedup.LevelFamily(), []
    for at in np.array_split(rng.permutation(n), max(1, n // size)):
        found += [u for r in family.add(suffixdedup.Records.array([whole.take(at)])) for u in r[0].tolist()]
    keys, docs, least = list(zip(whole.c.tolist(), whole.x.tolist())), whole.doc.tolist(), {}
    for k, d in zip(keys, docs):
        least[k] = min(d, least.get(k, d))
    repeats = [i for i in range(n) if docs[i] > least[keys[i]]]
    assert sorted(found) == repeats
    left = [u for level in family.levels if level is not None for u in level.uid.tolist()]
    assert sorted(left) == sorted(set(range(n)) - set(repeats))
    for level in family.levels:
        if level is not None:
            pairs = list(zip(level.c.tolist(), level.x.tolist()))
            assert pairs == sorted(pairs)


def test_empty_and_rewriting(spark):
    empty = frame(spark, [])
    assert result(empty) == []
    assert suffixdedup.cut_texts(empty).collect() == []
    df = frame(spark).withColumnRenamed("lang", "kept")
    out = suffixdedup.cut_texts(df)
    assert out.columns == df.columns
    kept = {(r.doc_id, r.kept, len(r.text)) for r in out.collect()}
    assert len(kept) >= 17 and all(k == "en" for _, k, _ in kept)
    spans = [r for r in suffixdedup.cut(df).collect() if r.removed]
    assert spans and all(sum(s.end - s.start for s in r.removed) == r.n_removed for r in spans)


def test_packed_arrays():
    arrays = [np.arange(1000, dtype=np.uint32), np.zeros(0, dtype=np.int64), np.random.default_rng(1).integers(0, 255, 77).astype(np.uint8)]
    for a, b in zip(arrays, suffixdedup.load(suffixdedup.dump(*arrays)), strict=True):
        assert a.dtype == b.dtype and (a == b).all()
